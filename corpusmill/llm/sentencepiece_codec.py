"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character. An agenda holds the adjacent pairs whose joined string is a piece,
ordered by score and then by place from the left; the best pair merges, its neighbours enter the agenda, and
so on until no pair is left. What is then no piece falls back to bytes.

No piece holds another character before a space mark, and none holds a line feed beside another character, so
no merge crosses such a place: the text is cut there and each distinct part of an Arrow batch is encoded once.
Both conditions are checked against the vocabulary; a model that breaks one has its texts encoded whole. The
agendas of all parts advance together, as arrays of pair ranks; a part of more than LONG symbols has a heap
of its own. Each distinct part is checked against the sentencepiece library within its Arrow batch; the agenda's ids stay where they differ.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text, rows

SPACE = "▁"
LONG = 200  #: symbols; a longer part gets a heap, so that work stays n log n
CHUNK = 1 << 20  #: characters of text that are encoded together
NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder for one model file; the sentencepiece library reads the vocabulary, checks and decodes."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.get_piece_size()
        self.piece_id = {lib.id_to_piece(i): i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.score = {p: -lib.get_score(i) for p, i in self.piece_id.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.cuttable = not any("\n" in p and len(p) > 1 for p in self.piece_id) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece_id)
        self.lead = lib.encode("\n") if self.cuttable else []
        self.symbols = size + 0x110000  #: symbols from size on are characters that are no piece
        self.char_symbol = np.arange(size, self.symbols, dtype=np.int32)
        for p, i in self.piece_id.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        symbol = lambda s: int(self.char_symbol[ord(s)]) if len(s) == 1 else self.piece_id.get(s)
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        table = [(a * self.symbols + b, ranks[self.score[p]], i) for p, i in self.piece_id.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        table.sort()
        self.pair_key, self.pair_rank, self.pair_id = (np.array([x[k] for x in table], dtype) for k, dtype in enumerate((np.int64, np.int32, np.int32)))

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (0 is best) and joined symbol of pairs; NONE where the joined string is no piece."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def agenda(self, part: str) -> list[int]:
        """Symbols of one part by merging the best-scored adjacent pair again and again."""
        symbols: list[str | None] = list(part)
        n, score = len(symbols), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(s, i, pair) for i in range(n - 1) if (s := score.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(q := pair + symbols[k])) is not None:
                    heapq.heappush(heap, (s, i, q))
            if (h := before[i]) >= 0 and (s := score.get(q := symbols[h] + pair)) is not None:
                heapq.heappush(heap, (s, h, q))
        return [int(self.char_symbol[ord(x)]) if len(x) == 1 else self.piece_id[x] for x in symbols if x is not None]

    def agendas(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many parts, a merge of each at a time. points: the parts' characters; returns all symbols and their counts by part."""
        symbol, part = self.char_symbol[points], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(symbol), NONE)
        joined = np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner], joined[inner] = self.looked_up(symbol[inner], symbol[inner + 1])
        done_symbols, done_parts = [], []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            counts = np.diff(np.r_[starts, len(part)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NONE, counts)
            if over.any():
                done_symbols.append(symbol[over])
                done_parts.append(part[over])
                left = ~over
                symbol, part, rank, joined, best, counts = symbol[left], part[left], rank[left], joined[left], best[best != NONE], counts[best != NONE]
                if not len(symbol):
                    break
            found = np.flatnonzero(rank == np.repeat(best, counts))
            at = found[np.r_[True, part[found][1:] != part[found][:-1]]]  # the leftmost of the best
            symbol[at] = joined[at]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            symbol, part, rank, joined = symbol[kept], part[kept], rank[kept], joined[kept]
            at = at - np.arange(len(at))
            for i in (at, at - 1):
                i = i[(i >= 0) & (i < len(symbol) - 1)]
                same = part[i] == part[i + 1]
                r, j = self.looked_up(symbol[i], symbol[i + 1])
                rank[i], joined[i] = np.where(same, r, NONE), j
            if len(symbol):
                rank[-1] = NONE
                last = at[(at == len(symbol) - 1) | (part[np.minimum(at + 1, len(symbol) - 1)] != part[at])]
                rank[last] = NONE
        parts = np.concatenate(done_parts) if done_parts else np.zeros(0, np.int32)
        order = np.argsort(parts, kind="stable")
        return np.concatenate(done_symbols)[order] if done_symbols else np.zeros(0, np.int32), np.bincount(parts, minlength=len(lengths))

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of distinct parts, their counts by part, and the parts where the library disagrees."""
        lengths = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        long = np.flatnonzero(lengths > LONG)
        texts = parts.to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if len(long):
            points = points[np.repeat(lengths <= LONG, lengths)]
        symbols, counts = self.agendas(points, np.where(lengths > LONG, 0, lengths))
        fixed: dict[int, list[int]] = {int(k): self.agenda(texts[k]) for k in long}
        size = self.symbols - 0x110000
        odd = np.flatnonzero(symbols >= size)
        if len(odd):
            starts = np.cumsum(counts) - counts
            for k in np.unique(np.searchsorted(starts + counts, odd, side="right")):
                fixed[int(k)] = symbols[starts[k] : starts[k] + counts[k]].tolist()
        for k, own in fixed.items():
            fixed[k] = [i for s in own for i in ([s] if s < size else [self.bytes[b] for b in chr(s - size).encode()] if self.bytes else [self.unknown])]
        if fixed:
            symbols, counts = spliced(symbols, counts, fixed)
        lead = len(self.lead)
        checks = self.library.encode([f"\n{p}" for p in texts] if self.cuttable else [p[1:] for p in texts], num_threads=1)
        check_counts = np.fromiter(map(len, checks), np.int64, len(checks))
        flat = np.fromiter(itertools.chain.from_iterable(checks), np.int32, int(check_counts.sum()))
        starts = np.cumsum(check_counts) - check_counts
        if lead:
            kept = np.ones(len(flat), bool)
            for k in range(lead):
                kept[starts + k] = False
            flat, check_counts = flat[kept], check_counts - lead
        if len(flat) == len(symbols) and (check_counts == counts).all() and (flat == symbols).all():
            return symbols, counts, []
        own, lib = np.split(symbols, np.cumsum(counts)[:-1]), np.split(flat, np.cumsum(check_counts)[:-1])
        return symbols, counts, [k for k in range(len(texts)) if not np.array_equal(own[k], lib[k])]

    def encode_chunk(self, texts: list[str | None]) -> tuple[pa.Array, list[int], list[bool], np.ndarray]:
        """For whole texts: each part's ids as decimal text, parts by text, whether agenda and library agreed, and ids by part (flat, offsets)."""
        marked = [(SPACE + t.replace(" ", SPACE)).encode() if t else b"" for t in texts]
        data = b"".join(marked)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        starts = cuts(np.frombuffer(data, np.uint8), ends - sizes, self.cuttable)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data))
        coded = parts.dictionary_encode()
        ids, counts, differ = self.encode_parts(coded.dictionary)
        offsets = np.r_[0, np.cumsum(counts)]
        index = coded.indices.to_numpy(zero_copy_only=False)
        by_text = np.searchsorted(starts, np.r_[0, ends]).tolist()
        bad = np.isin(index, differ) if differ else None
        agrees = [bad is None or not bad[a:b].any() for a, b in itertools.pairwise(by_text)]
        return ids, offsets, index, by_text, agrees


@lru_cache(1)
def codec_of(model_path: str) -> Codec:
    """One codec a Python worker, which serves many tasks."""
    return Codec(model_path)


def cuts(data: np.ndarray, starts: np.ndarray, cuttable: bool) -> np.ndarray:
    """Starts of parts: of each text, of each run of space marks, of each line feed and after it."""
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    if cuttable and len(data) > 3:
        mark = np.zeros(len(data) + 3, bool)
        mark[3 : len(data) + 1] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)  # at i + 3: a mark starts at i
        is_mark, follows = mark[3:], mark[: len(data)]
        begins[: len(data)] |= is_mark & ~follows
        feed = data == 10
        begins[: len(data)] |= feed
        begins[1:] |= feed
    return np.flatnonzero(begins[: len(data)])


def spliced(symbols: np.ndarray, counts: np.ndarray, fixed: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """symbols with the parts in fixed replaced."""
    ends = np.cumsum(counts)
    pieces, at = [], 0
    for k in sorted(fixed):
        pieces += [symbols[at : ends[k] - counts[k]], np.array(fixed[k], np.int32)]
        at = ends[k]
    counts = counts.copy()
    counts[list(fixed)] = [len(x) for x in fixed.values()]
    return np.concatenate([*pieces, symbols[at:]]), counts


def taken(ids: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of parts index, one after another."""
    counts = offsets[index + 1] - offsets[index]
    ends = np.cumsum(counts)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[index] - (ends - counts), counts)]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids_as_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, agrees: every whole text encoded and decoded again.

    Without begin or end ids and without sampling. ids is array<int>, or the decimal ids joined by commas with
    ids_as_text. A null or empty text has no ids and decodes to ''. agrees is false where agenda and library
    differed; the ids are the agenda's. Null ids, repeated rows and ties stay as they are: one row out for each row in; an empty table
    gives an empty table. Other columns of df, whatever their names, are not read. Narrow: no shuffle.
    """
    kind = pa.string() if ids_as_text else pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", kind), ("decoded", pa.string()), ("agrees", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)

        def made(held: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
            ids, offsets, index, by_text, agrees = codec.encode_chunk([t for _, t in held])
            own = [taken(ids, offsets, index[a:b]) for a, b in itertools.pairwise(by_text)]
            if ids_as_text:
                written = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids).cast(pa.string())), ",").take(pa.array(index))
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), written), ",")
            else:
                out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in own])], pa.int32()), pa.array(np.concatenate(own), pa.int32()))
            decoded = [codec.library.decode(x.tolist()) if len(x) else "" for x in own]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([len(x) for x in own], pa.int64()), out.cast(kind), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], schema=schema)

        held, weight = [], 0
        for batch in it:
            for row in rows(batch):
                held.append(row)
                weight += len(row[1] or "")
                if weight >= CHUNK:
                    yield made(held)
                    held, weight = [], 0
        if held:
            yield made(held)

    ids_type = "string" if ids_as_text else "array<int>"
    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, ids {ids_type}, decoded string, agrees boolean")
