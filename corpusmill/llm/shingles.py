"""Hashed word shingles of whole texts, by arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64  #: bytes; longer words are hashed one by one


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: hash, start and end of each word (in the texts joined by line feeds) and the first word of each text, with the end. between: the bytes that part words.

    A word's hash mixes its length and its bytes, eight at a time; every step is a bijection, so that two words get one
    hash only by chance, 1 in 2**64.
    """
    data = b"\n".join([*texts, b""]).translate(_LOWER)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = np.frombuffer(b"\0" + data.translate((~between).tobytes()) + b"\0", np.bool_)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    length = ends - starts
    eight = np.ndarray(len(data) + 1, np.uint64, data + bytes(8), strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        h = mixed(length.astype(np.uint64) * _MIX[3])
        live = np.flatnonzero(length <= LONG_WORD)
        done = 0
        while len(live):
            h[live] = mixed(h[live] * _MIX[2] ^ (eight[starts[live] + done] & _MASK[np.minimum(length[live] - done, 8)]))
            done += 8
            live = live[length[live] > done]
        long = np.flatnonzero(length > LONG_WORD)
        if len(long):
            whole = memoryview(data)
            h[long] = mixed(np.array([xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]], seed=20240229) for i in long.tolist()], np.uint64))
    return h, starts, ends, first


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, in order."""
    out = np.zeros(len(words) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * _MIX[2] + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return out


def shingle_sets(texts: list[str | None], k: int = 3) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence; without words, none."""
    words, _, _, first = word_hashes([(t or "").encode() for t in texts])
    rows = combined(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(rows[a : b - k + 1])
        elif b > a:
            yield combined(words[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def names_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit names of a set, from its size and sums over its members; 0 and 0 without members."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        sums = np.array([s.sum(dtype=np.uint64), mixed(s ^ _MIX[3]).sum(dtype=np.uint64)])
        one, two = mixed(sums * _MIX[2] + np.uint64(len(s))).view(np.int64).tolist()
    return one, two
