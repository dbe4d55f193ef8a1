"""Lexical retrieval packing: token windows of neighbouring documents.

A document fills windows of its own as far as it can; what is left of it, its rest, is packed. Rests are dealt to shards by
their weightiest words, so that lexical neighbours meet, and each shard holds a BM25 inverted index of its rests over the
ids as terms, with document frequencies of the whole corpus. A seed, the first rest that is unused, asks the index; its
unused neighbours, best first, fill its window. One that doesn't fit is cut, and what is over of it stays unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SEGMENT, Codec
from .common import Scratch, batches, chunks, id_text, packed, unpacked, written

WINDOW, SHARD = 1024, 1024  #: ids of a sequence; rests of a shard, which one task packs at a time
K1, B = 1.2, 0.75

REST = "doc_id long, n long, crcs binary, rest binary"
_REST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.binary()), ("rest", pa.binary())])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


@lru_cache(1)
def codec(path: str) -> Codec:
    """One a Python worker: tasks that follow each other share the words it knows."""
    return Codec(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, in order, and how often; np.unique takes several times as long for so few."""
    ids = np.sort(ids)
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    first = np.flatnonzero(new)
    count = np.full(len(first), len(ids))
    count[:-1] = first[1:]
    return ids[first], count - first


def heaviest(ids: np.ndarray, weight: np.ndarray, most: int) -> list[int]:
    """The ids that weigh most, of equal ones the smallest first."""
    if len(ids) > most:
        some = np.flatnonzero(weight >= np.partition(weight, len(ids) - most)[len(ids) - most])
        ids, weight = ids[some], weight[some]
    return ids[np.lexsort((ids, -weight))[:most]].tolist()


def tokenised(documents: DataFrame, path: str, end: int = 0, window: int = WINDOW) -> DataFrame:
    """doc_id, n (ids, with the end id), crcs of the full windows, rest (the ids behind them), packed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        last = np.array([end], np.uint32)

        def row(doc: int | None, parts: Iterator[np.ndarray]) -> tuple:
            """One document; no more of a long one is held than a segment."""
            n, crcs, held = 0, [], np.zeros(0, np.uint32)
            for part in parts:
                n += len(part)
                held = np.concatenate([held, part]) if len(held) else part
                full = len(held) // window
                crcs += [crc(held[k * window : (k + 1) * window]) for k in range(full)]
                held = held[full * window :]
            return doc, n, packed(np.array(crcs, np.uint32)), packed(held)

        def out() -> Iterator[tuple]:
            for held in chunks(it, SEGMENT):
                short = [(doc, text or "") for doc, text in held if len(text or "") <= SEGMENT]
                for (doc, _), ids in zip(short, own.encode([t for _, t in short]), strict=True):
                    yield row(doc, iter([np.concatenate([ids, last])]))
                for doc, text in ((doc, text) for doc, text in held if len(text or "") > SEGMENT):
                    yield row(doc, (x for part in (own.long(text), [last]) for x in part))

        yield from batches(out(), _REST)

    return id_text(documents).mapInArrow(run, REST)


def frequencies(rests: DataFrame) -> tuple[np.ndarray, int, float]:
    """In how many rests each id is, the number of rests, their mean length. The driver gets a row an id of the vocabulary."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in it:
            for data in batch.column(0):
                ids, _ = distinct(own := unpacked(data.as_py(), np.uint32))
                count, total = count + (len(own) > 0), total + len(own)
                if len(ids) and ids[-1] >= len(seen):
                    seen = np.r_[seen, np.zeros(int(ids[-1]) + 1 - len(seen), np.int64)]
                seen[ids] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[count, total, seen[some]])], schema=schema)

    got = {r.id: r.n for r in rests.select("rest").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    count, total = got.pop(-1, 0), got.pop(-2, 0)
    out = np.zeros(max(got, default=-1) + 1, np.int64)
    out[list(got)] = list(got.values())
    return out, count, total / max(count, 1)


def idf_of(seen: np.ndarray, count: int) -> np.ndarray:
    """Robertson's weight of each id; ids in half of all rests or more have none."""
    return np.maximum(np.log((count - seen + 0.5) / (seen + 0.5)), 0)


def keyed(rests: DataFrame, idf: np.ndarray, terms: int = 3) -> DataFrame:
    """rests with key: the ids that weigh most in a rest, by which a range sort brings like rests together."""
    shared: Broadcast = rests.sparkSession.sparkContext.broadcast(idf)  # a number an id of the vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = []
            for data in batch.column("rest"):
                ids, tf = distinct(unpacked(data.as_py(), np.uint32))
                keys.append(heaviest(ids, shared.value[ids] * tf / (tf + K1), terms))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*batch.schema.names, "key"])

    return rests.mapInArrow(run, f"{REST}, uid long, key array<int>")


class Index:
    """BM25 inverted index of a shard's rests."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(rests)
        lengths = np.fromiter(map(len, rests), np.int64, len(rests))
        pairs = np.repeat(np.arange(self.size, dtype=np.int64), lengths) | np.concatenate([*rests, np.zeros(0, np.uint32)]).astype(np.int64) << 32
        pairs, tf = np.unique(pairs, return_counts=True)  # by term, then by rest
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean, 1e-9)))
        some = weight > 0
        term, doc, weight = term[some], doc[some], weight[some]
        self.number = np.cumsum(np.r_[False, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)  # of the term
        self.n_terms = int(self.number[-1]) + 1 if len(term) else 0
        order = np.argsort(doc, kind="stable")  # the terms of each rest
        self.terms, self.from_ = self.number[order], np.searchsorted(doc[order], np.arange(self.size + 1))
        self.listed(doc, weight)

    def listed(self, doc: np.ndarray, weight: np.ndarray) -> None:
        """Each term's list of rests and weights."""
        self.doc, self.weight = doc, weight
        self.count = np.bincount(self.number, minlength=self.n_terms)
        self.first = np.cumsum(self.count) - self.count

    def forget(self, used: np.ndarray) -> None:
        """Leaves rests that are used up out of the lists; the others' scores stay."""
        some = ~used[self.doc]
        self.number = self.number[some]
        self.listed(self.doc[some], self.weight[some])

    def scores(self, seed: int) -> np.ndarray:
        """Of all rests in the lists, for the terms of the seed's."""
        terms = self.terms[self.from_[seed] : self.from_[seed + 1]]
        if not len(terms):
            return np.zeros(self.size)
        first, end = self.first[terms].tolist(), (self.first[terms] + self.count[terms]).tolist()
        own = list(map(slice, first, end))
        return np.bincount(np.concatenate([self.doc[s] for s in own]), np.concatenate([self.weight[s] for s in own]), self.size)


def windows(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (rest, start in it, length). All are full, but for the last ids of the shard: their sequences
    are as long as the powers of two that add up to them, so that nothing is padded."""
    index = Index(rests, idf, mean)
    left = np.fromiter(map(len, rests), np.int64, len(rests))
    done = np.zeros_like(left)
    listed = len(rests)
    for seed in range(len(rests)):
        while left[seed]:
            out, space = [], window
            ranked = iter([seed])
            neighbours = None
            while space:
                doc = next(ranked, None)
                if doc is None and neighbours is None:  # the seed is in; now its neighbours
                    unused = np.flatnonzero(left)
                    if 2 * len(unused) <= listed:
                        index.forget(left == 0)
                        listed = len(unused)
                    neighbours = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
                    ranked = iter(neighbours.tolist())
                    continue
                if doc is None:
                    break
                take = min(space, int(left[doc]))
                out.append((doc, int(done[doc]), take))
                done[doc], left[doc], space = done[doc] + take, left[doc] - take, space - take
            if not space:
                yield out
                continue
            total = window - space
            for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
                own = []
                while size:
                    doc, start, length = out.pop(0)
                    take = min(size, length)
                    own.append((doc, start, take))
                    size -= take
                    if take < length:
                        out.insert(0, (doc, start + take, length - take))
                yield own


def filled(dealt: DataFrame, idf: np.ndarray, mean: float, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """The pieces of dealt rests: each task packs its rows, in their order, shard by shard."""
    shared: Broadcast = dealt.sparkSession.sparkContext.broadcast(idf)  # a number an id of the vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40

        def of(held: list[tuple]) -> Iterator[tuple]:
            nonlocal sequence
            rests = []
            for doc, n, crcs, rest in held:
                for k, c in enumerate(unpacked(crcs, np.uint32).tolist()):
                    yield doc, k * window, window, c, n, sequence, 0
                    sequence += 1
                rests.append(unpacked(rest, np.uint32))
            for pieces in windows(rests, shared.value, mean, window):
                offset = 0
                for k, start, length in pieces:
                    doc, n = held[k][:2]
                    yield doc, n - len(rests[k]) + start, length, crc(rests[k][start : start + length]), n, sequence, offset
                    offset += length
                sequence += 1

        def out() -> Iterator[tuple]:
            held = []
            for batch in it:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    if len(held) == shard:
                        yield from of(held)
                        held = []
            yield from of(held)

        yield from batches(out(), _PIECE, every_rows=10_000)

    return dealt.select("doc_id", "n", "crcs", "rest").mapInArrow(run, PIECE)


def pack(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 0, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every id of every document in one piece.

    A null or empty text is the end id alone. Rows that share an id, or have none, are documents of their own; of equal
    scores the rest that comes first in the shard counts. An empty table gives no piece. Other columns are not read.
    Lost executors cost a task: rests and pieces are written tables.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    own = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rests = scratch.written(tokenised(own, path, end, window).withColumn("uid", F.monotonically_increasing_id()), "rests")
    seen, count, mean = frequencies(rests)
    idf = idf_of(seen, count)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.get("key", F.lit(k)) for k in range(3)), F.col("uid")]
    dealt = keyed(rests, idf).repartitionByRange(parts, *order).sortWithinPartitions(*order)  # uid splits equal keys
    out = written(filled(dealt, idf, mean, window, shard), "pieces")
    scratch.close()
    return out
