"""Edit distances of many pairs of words at once, bit-parallel over arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np

KEPT = 200_000  #: distances that a worker remembers
_known: dict[tuple[str, str], int] = {}


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, lengths


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edit distance of each a and its b. A column of the table of a pair is two words of 64 bits, its steps up and
    down; all pairs take a character of their b at a time. Where a has over 64 characters, the table's rows are kept."""
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= 64 for x in a], bool)
    for k in np.flatnonzero(~short).tolist():
        out[k] = _by_rows(a[k], b[k])
    at = np.flatnonzero(short)
    at = at[np.argsort([len(b[k]) for k in at.tolist()], kind="stable")[::-1]] if len(at) else at  # pairs that are done fall off the end
    left, n = codes([a[k] for k in at.tolist()])
    right, m = codes([b[k] for k in at.tolist()])
    one = np.uint64(1)
    last = one << np.maximum(n - 1, 0).astype(np.uint64)
    up, down, score = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64), n.copy()
    for j in range(right.shape[1]):
        live = int(np.searchsorted(-m, -j, side="left"))  # b is longer than j
        same = np.zeros((live, 64), bool)
        same[:, : left.shape[1]] = (left[:live] == right[:live, j : j + 1]) & (np.arange(left.shape[1]) < n[:live, None])
        equal = np.packbits(same, axis=1, bitorder="little").view(np.uint64).ravel()
        vp, vn, top = up[:live], down[:live], last[:live]
        with np.errstate(over="ignore"):
            zero = (((equal & vp) + vp) ^ vp) | equal | vn
        plus, minus = vn | ~(zero | vp), vp & zero
        score[:live] += ((plus & top) != 0).astype(np.int64) - ((minus & top) != 0)
        plus, minus = (plus << one) | one, minus << one
        up[:live], down[:live] = minus | ~(zero | plus), plus & zero
    out[at] = np.where(n == 0, m, score)
    return out


def _by_rows(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_distance(a: str, b: str) -> int:
    """Of one pair: remembered, or counted now."""
    if (d := _known.get((a, b))) is None:
        d = _known[a, b] = _by_rows(a, b)
        if len(_known) > KEPT:
            _known.clear()
    return d


def remember(words: Iterable[str], others: Iterable[str], share: float) -> None:
    """Counts at once what edit_distance() will be asked for: words and others with one first letter, of which the lengths differ by
    at most share of the longer."""
    by_letter: dict[str, list[str]] = defaultdict(list)
    for o in set(others):
        if o:
            by_letter[o[0]].append(o)
    asked = [(w, o) for w in set(words) if w for o in by_letter.get(w[0], ()) if abs(len(w) - len(o)) <= int(share * max(len(w), len(o)))]
    pairs = [p for p in asked if p not in _known]
    if pairs and len(_known) + len(pairs) > KEPT:
        _known.clear()
        pairs = asked  # all that the next calls ask for
    if pairs:
        _known.update(zip(pairs, edit_distances([w for w, _ in pairs], [o for _, o in pairs]).tolist(), strict=True))
