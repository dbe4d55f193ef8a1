"""Ids of a byte-level BPE tokenizer for whole batches of texts, by arrays; each distinct word is encoded by the library once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

from .shingles import _MASK, _MIX, LONG_WORD, mixed

LETTER, NUMBER, OTHER, SPACE, BETWEEN, UNKNOWN = range(6)
SEGMENT = 1 << 20  #: characters that are encoded at once
MOST_WORDS = 1 << 20  #: distinct words that are remembered
_CUT = re.compile(r"(?<=[^\s]) ")  #: a space after another character starts a word


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: bijections of length and bytes, eight at a time, so equal by chance only."""
    length = ends - starts
    eight = np.ndarray(len(data) + 1, np.uint64, data + bytes(8), strides=(1,))
    with np.errstate(over="ignore"):
        h = mixed(length.astype(np.uint64) * _MIX[3])
        live, done = np.flatnonzero(length <= LONG_WORD), 0
        while len(live):
            h[live] = mixed(h[live] * _MIX[2] ^ (eight[starts[live] + done] & _MASK[np.minimum(length[live] - done, 8)]))
            done += 8
            live = live[length[live] > done]
        if len(long := np.flatnonzero(length > LONG_WORD)):
            whole = memoryview(data)
            h[long] = mixed(np.array([xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]], seed=20240229) for i in long.tolist()], np.uint64))
    return h


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE start: contractions; runs of letters, of digits or of other characters, with a space
    before them; runs of white space, without the last of it before other text. kind: the kind of each code point."""
    n = len(points)
    runs = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1] if n else np.zeros(0, np.int64)
    ends = np.r_[runs[1:], n]
    start = np.zeros(n + 3, bool)
    start[runs] = True
    before_text = (kind[runs] == SPACE) & (np.append(kind[runs[1:]], np.uint8(BETWEEN)) < SPACE)
    last = ends[before_text] - 1
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    at = np.flatnonzero(points == 39)
    at = at[start[at]]
    one, two = (np.where(at + k < n, points[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
    short = np.isin(one, [*map(ord, "stmd")])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return np.flatnonzero(start[:n])


def letters() -> list[int]:
    """The character that stands for each byte in the vocabulary: itself where it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [b if b in shown else next(spare) for b in range(256)]


class Words:
    """Numbers of words by their 64-bit hashes: an open table in arrays, asked and filled for many at once."""

    def __init__(self, most: int):
        self.keys, self.values, self.n = np.zeros(2 * most, np.uint64), np.zeros(2 * most, np.int32), 0  # most: a power of two
        self.mask, self.most = 2 * most - 1, most

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        out, at = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(at):
            key = self.keys[slot]
            hit = key == hashes
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            at, hashes, slot = at[on], hashes[on], (slot[on] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that are not here take the next numbers."""
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # of several that want one place, the last has it
            own = self.keys[slot] == hashes
            self.values[slot[own]] = numbers[own]
            hashes, numbers, slot = hashes[~own], numbers[~own], (slot[~own] + 1) & self.mask


class Codec:
    """The ids that tokenizers gives, special strings included, without ids added around a text.

    Which characters are letters, digits or white space is asked of the library, once a character, and so are the ids of
    each distinct word. Words are known by 64-bit hashes; at most MOST_WORDS of them, then all are forgotten.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(letters()))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.words, self.n_ids = Words(MOST_WORDS), 0
        self.ids, self.sizes, self.places = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def kind(self, point: int) -> int:
        alone = lambda x: len(self.library.pre_tokenizer.pre_tokenize_str(x + chr(point))) == 1
        return LETTER if alone("a") else NUMBER if alone("1") else OTHER if alone("!") else SPACE

    def remember(self, hashes: np.ndarray, words: list[bytes]) -> None:
        tokenize = self.library.model.tokenize
        coded = [[t.id for t in tokenize(w.decode("latin-1").translate(self.letters))] for w in words]
        new, sizes = self.words.n, np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(sizes.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while new + len(coded) > len(self.sizes):
            self.sizes, self.places = np.r_[self.sizes, np.zeros_like(self.sizes)], np.r_[self.places, np.zeros_like(self.places)]
        self.sizes[new : new + len(coded)] = sizes
        self.places[new : new + len(coded)] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + total] = [i for ids in coded for i in ids]
        self.n_ids += total
        self.words.add(hashes)

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of words, new ones learnt."""
        hashes = np.maximum(span_hashes(data, starts, ends), 1)
        found = self.words.find(hashes)
        if len(new := np.flatnonzero(found < 0)):
            fresh, sample = np.unique(hashes[new], return_index=True)
            if self.words.n + len(fresh) > self.words.most and self.words.n:
                self.forget()
                return self.numbers(data, starts, ends)
            if len(fresh) > self.words.most:
                self.words = Words(1 << int(len(fresh)).bit_length())
            self.remember(fresh, [data[starts[k] : ends[k]] for k in new[sample].tolist()])
            found[new] = self.words.find(hashes[new])
        return found

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings."""
        joined = "\n".join([*texts, ""])
        points, data = np.frombuffer(joined.encode("utf-32-le"), np.uint32), joined.encode()
        after = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # behind each text's line feed
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            for p in np.unique(points[kind == UNKNOWN]).tolist():
                self.kinds[p] = self.kind(p)
            kind = self.kinds[points]
        kind[after - 1] = BETWEEN
        starts = word_starts(points, kind)
        ends = np.r_[starts[1:], len(points)]
        ours = kind[starts] != BETWEEN
        starts, ends = starts[ours], ends[ours]
        first = np.searchsorted(starts, np.r_[0, after])
        if len(data) > len(points):
            byte = np.r_[np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)]  # where each character starts
            starts, ends = byte[starts], byte[ends]
        entries = self.numbers(data, starts, ends)
        sizes = self.sizes[entries]
        to = np.r_[0, np.cumsum(sizes)]
        out = self.ids[np.repeat(self.places[entries] - to[:-1], sizes) + np.arange(to[-1])]
        return [out[to[a] : to[b]] for a, b in zip(first[:-1], first[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        coded = iter(self.plain([t for k, t in enumerate(texts) if k not in odd]))
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if k in odd else next(coded) for k, t in enumerate(texts)]

    def long(self, text: str, size: int = SEGMENT) -> Iterator[np.ndarray]:
        """The ids of one text in turn, by segments of about size characters that start with words."""
        if any(s in text for s in self.special):
            yield self.encode([text])[0]
            return
        at = 0
        while len(text) - at > size and (cut := _CUT.search(text, at + size)):
            yield self.plain([text[at : cut.start()]])[0]
            at = cut.start()
        yield self.plain([text[at:]])[0]
