"""Windows of bytes by arrays: runs of neighbours that share an anchor, and their leading digits.

A window's anchor is the least of the hashes of the GRAM-byte strings inside it. Neighbouring windows mostly share
it, so a run of them travels as one record; two equal windows, wherever they are, have equal anchors. A leading digit
is a hash of the first bytes of a window.

Hashes mix eight bytes at a time, or GRAM-byte strings by their hashes, and every step is a bijection of what came in
last: two strings of one length get one hash only by chance, 1 in 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .shingles import mixed

GRAM = 16  #: bytes of an anchor
PIECE = 1 << 18  #: bytes handled together; a longer text is cut into pieces that overlap by a window less a byte
LONG_RUN = 1024  #: bytes; longer runs are hashed one by one

_M = [np.uint64(x) for x in (0xD1342543DE82EF95, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Windows:
    """The windows of width bytes of some texts (UTF-8), joined without a separator; none crosses two texts."""

    def __init__(self, texts: list[bytes], width: int, runs: bool = True):
        self.width = width
        self.whole = b"".join([*texts, bytes(8)])
        size = len(self.whole) - 8
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        n = max(size - width + 1, 0)
        self.starts = self.ends = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if not n:
            return
        valid = np.ones(n, bool)
        for k in range(1, width):  # a window that starts fewer than width bytes before a text's end crosses it
            at = first - k
            valid[at[(at >= 0) & (at < n)]] = False
        eight = np.ndarray(size + 1, np.uint64, self.whole, strides=(1,))  # the eight bytes from each place on
        with np.errstate(over="ignore"):
            self.grams = h = mixed(mixed(eight[: size - GRAM + 1] * _M[0]) + eight[8 : size - GRAM + 9] * _M[1])
        if not runs:
            self.starts = np.flatnonzero(valid)
            return
        grams, reach = width - GRAM + 1, 1
        while reach * 2 <= grams:
            h = np.minimum(h[:-reach], h[reach:])
            reach *= 2
        if grams > reach:
            h = np.minimum(h[: len(h) - (grams - reach)], h[grams - reach :])
        edge = np.r_[True, (h[1:] != h[:-1]) | ~valid[1:] | ~valid[:-1]]
        edge[first[first < n]] = True
        starts = np.flatnonzero(edge)
        ends = np.r_[starts[1:], n]
        kept = valid[starts]
        self.starts, self.ends = starts[kept], ends[kept]  #: runs of windows with one anchor
        self.anchor = mixed(h[self.starts])  # least hashes crowd near 0; mixed again, they spread evenly over buckets

    def chained(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings of at least GRAM bytes at starts: their grams side by side, the last one at the end."""
        with np.errstate(over="ignore"):
            h = mixed(self.grams[starts] + lengths.astype(np.uint64) * _M[2])
            live, done = np.flatnonzero(lengths > GRAM), GRAM
            while len(live):
                at = starts[live] + np.minimum(done, lengths[live] - GRAM)
                h[live] = mixed(h[live] * _M[2] + self.grams[at])
                done += GRAM
                live = live[lengths[live] > done]
        return h

    def leading(self, depth: int) -> np.ndarray:
        """A hash of the first depth bytes of each window."""
        return self.chained(self.starts, np.full(len(self.starts), depth))

    def spans(self) -> np.ndarray:
        """A hash of all bytes of each run."""
        lengths = self.ends - self.starts + self.width - 1
        if not len(lengths):
            return np.zeros(0, np.uint64)
        short = np.minimum(lengths, LONG_RUN)
        h = self.chained(self.starts, short)
        for i in np.flatnonzero(lengths > LONG_RUN).tolist():
            a = int(self.starts[i])
            h[i] = xxhash.xxh3_64_intdigest(self.whole[a : a + int(lengths[i])], seed=77001)
        return h
