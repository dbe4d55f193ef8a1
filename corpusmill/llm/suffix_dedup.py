"""Removal of byte strings that an earlier document has, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first WIDTH bytes, most significant digit first: a pass orders by the first
DEPTHS[0] bytes and sets aside what stands alone, the next orders the rest through DEPTHS[1], up to all WIDTH. Equal groups at
full depth are exactly the repeated windows, and each knows the smallest document that holds it.

Before the passes a sieve spares most suffixes the sort. Neighbouring windows share an anchor, the least hash of any GRAM
bytes in them; a run of windows with one anchor travels as one record (anchor, hash of the run's bytes, smallest
document). An anchor that one record has shows that none of its windows is repeated; one whose records all have equal
bytes shows the smallest document of every window at once. Only runs that differ under one anchor are ordered.

Documents stay in blocks. A block sends a digit, or a run, once, however often it has it, and the bucket of a digit
sorts what blocks send as arrays and answers for each: so a window that a third of all documents hold costs a bucket
one record a block. Digits are hashes of the bytes that they stand for: at full depth of 64 bits; a run is known by 48
bits of its anchor and 40 of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, packed, unpacked
from .windows import GRAM, PIECE, Windows

WIDTH = 50
DEPTHS = (32, 50)  #: bytes through which each pass orders; the last is WIDTH
BLOCK, MOST = 2 << 20, 256 << 20  #: bytes of a block: it grows with the root of the input, so that what a block sends to a bucket stays a fair piece
GROWTH = 20_000
SHORT = np.uint64(2**64 - 2**16)  #: anchors and digits short of full depth have 48 bits, since only what follows them decides
SPANS = 64  #: different runs of one anchor that a block sends; it orders the others without asking

REQUEST = "bucket long, block long, level int, digits binary, spans binary, holders binary"
REPLY = "block long, level int, bucket long, kinds binary, holders binary"
_REQUEST = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("digits", pa.binary()), ("spans", pa.binary()), ("holders", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("kinds", pa.binary()), ("holders", pa.binary())])
ALONE, EQUAL, DEEPER = 0, 1, 2


def five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def sent(block: int, level: int, buckets: int, digits: np.ndarray, spans: np.ndarray | None, holders: np.ndarray | None) -> Iterator[tuple]:
    """Records, sorted by digit, as a request to each bucket."""
    to = ((digits >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(np.r_[-1, to, -1]))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(to[a]), block, level, packed(np.diff(digits[a:b], prepend=np.uint64(0))), b"" if spans is None else five(spans[a:b]), b"" if holders is None else packed(holders[a:b])


def received(replies: list[dict], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the records that were sent, in their order, and the smallest holder of those that are not alone."""
    own = sorted((r for r in replies if r["level"] == level), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.uint8), *(unpacked(r["kinds"], np.uint8) for r in own)]), np.concatenate([np.zeros(0, np.int64), *(unpacked(r["holders"], np.int64) for r in own if r["holders"])])


class Sieve:
    """Texts of a block (UTF-8) by document: their runs, and the distinct (anchor, run) with the smallest holder of each."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.width = ids[order].astype(np.int64), width
        texts = [texts[k] for k in order]
        self.data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        at, ends, digits, spans = [], [], [], []
        for base, parts in pieces(texts, self.first, width):
            w = Windows(parts, width)
            at.append(w.starts + base)
            ends.append(w.ends + base)
            digits.append(w.anchor & SHORT)
            spans.append(w.spans() & np.uint64(2**40 - 1))
        self.at, self.ends = joined(at, np.int64), joined(ends, np.int64)
        digits, spans = joined(digits, np.uint64), joined(spans, np.uint64)
        self.owner = self.ids[np.searchsorted(self.first, self.at, side="right") - 1] if len(self.at) else np.zeros(0, np.int64)
        order = np.lexsort((self.owner, spans, digits))
        digits, spans = digits[order], spans[order]
        new = np.ones(len(order), bool)
        new[1:] = (digits[1:] != digits[:-1]) | (spans[1:] != spans[:-1])
        self.record = np.empty(len(order), np.int64)
        self.record[order] = np.cumsum(new) - 1
        self.digits, self.spans, self.holders, self.example = digits[new], spans[new], self.owner[order][new], order[new]
        start = np.flatnonzero(np.r_[True, self.digits[1:] != self.digits[:-1]]) if len(self.digits) else np.zeros(0, np.int64)
        self.asks = np.arange(len(self.digits)) - np.repeat(start, np.diff(np.r_[start, len(self.digits)])) < SPANS

    def requests(self, block: int, buckets: int) -> Iterator[tuple]:
        return sent(block, 0, buckets, self.digits[self.asks], self.spans[self.asks], self.holders[self.asks])

    def answered(self, replies: list[dict]) -> None:
        kinds, lowest = received(replies, 0)
        self.kinds, self.lowest = np.full(len(self.digits), DEEPER, np.uint8), self.holders.copy()
        self.kinds[self.asks] = kinds
        self.lowest[np.flatnonzero(self.asks)[kinds != ALONE]] = lowest
        self.taken = np.flatnonzero((self.kinds == DEEPER) & (self.lowest == self.holders))  # runs whose smallest holder is here

    def runs(self) -> tuple[list[bytes], np.ndarray]:
        """The bytes of the runs that this block has to order, and their smallest holders."""
        own = self.example[self.taken]
        return [self.data[a : b + self.width - 1] for a, b in zip(self.at[own].tolist(), self.ends[own].tolist(), strict=True)], self.holders[self.taken]

    def repeated(self, of_runs: np.ndarray) -> np.ndarray:
        """For each place, whether the window there starts in a smaller document too. of_runs: that of the runs' windows, one run after another."""
        whole = self.lowest[self.record] < self.owner
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, self.at[whole], 1)
        np.add.at(step, self.ends[whole], -1)
        out = np.cumsum(step[:-1]) > 0
        sizes = (self.ends - self.at)[self.example[self.taken]]
        place = np.full(len(self.holders), -1)
        place[self.taken] = np.cumsum(sizes) - sizes
        part = np.flatnonzero(~whole & (place[self.record] >= 0))
        size = self.ends[part] - self.at[part]
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(self.at[part], size) + shift] = of_runs[np.repeat(place[self.record[part]], size) + shift]
        return out


class Suffixes:
    """The suffixes of a block's runs, ordered pass by pass by their own first bytes. Windows stand one run after another."""

    def __init__(self, runs: list[bytes], holders: np.ndarray, width: int, depths: tuple[int, ...]):
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        first = np.cumsum(sizes) - sizes
        by_depth: list[list[np.ndarray]] = [[] for _ in depths]
        for _, parts in pieces(runs, first, width):
            w = Windows(parts, width, runs=False)
            for held, depth in zip(by_depth, depths, strict=True):
                held.append(w.leading(depth) if depth == width else w.leading(depth) & SHORT)
        self.digits = [joined(d, np.uint64) for d in by_depth]
        self.owner = np.repeat(holders, np.maximum(sizes - width + 1, 0))
        self.lowest = self.owner.copy()
        self.open = np.ones(len(self.owner), bool)

    def records(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct digits of the open suffixes, and the smallest holder of each."""
        self.own = np.flatnonzero(self.open)
        digits, owner = self.digits[level][self.own], self.owner[self.own]
        order = np.lexsort((owner, digits))
        digits = digits[order]
        new = np.r_[True, digits[1:] != digits[:-1]] if len(digits) else np.zeros(0, bool)
        self.record = np.empty(len(order), np.int64)
        self.record[order] = np.cumsum(new) - 1
        return digits[new], owner[order][new]

    def answered(self, level: int, replies: list[dict], last: bool) -> None:
        """A digit that no other block has, and one suffix here, is alone. At full depth equal digits are equal windows."""
        _, holders = self.records(level)
        kinds, lowest = received(replies, level + 1)
        if last:
            holders[kinds != ALONE] = lowest
            self.lowest[self.own] = holders[self.record]
        else:
            alone = (kinds == ALONE) & (np.bincount(self.record, minlength=len(kinds)) == 1)
            self.open[self.own[alone[self.record]]] = False

    def repeated(self) -> np.ndarray:
        return self.lowest < self.owner


def joined(x: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(x) if x else np.zeros(0, dtype)


def pieces(texts: list[bytes], first: np.ndarray, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place, texts) of about PIECE bytes; a longer text is cut into pieces that overlap by a window less a byte, so that each window is in one."""
    group: list[bytes] = []
    weight = base = 0
    for k, t in enumerate(texts):
        if group and (weight >= PIECE or len(t) > PIECE):
            yield base, group
            group, weight = [], 0
        if len(t) > PIECE:
            for a in range(0, len(t) - width + 1, PIECE):
                yield int(first[k]) + a, [t[a : a + PIECE + width - 1]]
            continue
        if not group:
            base = int(first[k])
        group.append(t)
        weight += len(t)
    if group:
        yield base, group


def answers(bucket: int, requests: pa.Table) -> Iterator[tuple]:
    """Order one bucket's records by digit, then run, and answer each block in the order of its records."""
    rows = requests.to_pylist()
    digits = [np.cumsum(unpacked(r["digits"], np.uint64)) for r in rows]
    sizes = [len(d) for d in digits]
    digit = np.concatenate(digits)
    holder = np.concatenate([unpacked(r["holders"], np.int64) for r in rows]) if rows[0]["holders"] else np.zeros(len(digit), np.int64)
    span = np.concatenate([from_five(r["spans"]) for r in rows]) if rows[0]["spans"] else np.zeros(len(digit), np.uint64)
    order = np.lexsort((holder, span, digit))
    d, s = digit[order], span[order]
    new_digit = np.r_[True, d[1:] != d[:-1]]
    new_span = new_digit | np.r_[True, s[1:] != s[:-1]]
    group, run = np.cumsum(new_digit) - 1, np.cumsum(new_span) - 1
    members, runs = np.bincount(group), np.bincount(group, weights=new_span)
    kinds, lowest = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    kinds[order] = np.where(members[group] == 1, ALONE, np.where(runs[group] == 1, EQUAL, DEEPER))
    lowest[order] = holder[order][new_span][run]
    end = 0
    for r, size in zip(rows, sizes, strict=True):
        own = slice(end, end + size)
        end += size
        yield r["block"], r["level"], bucket, packed(kinds[own]), packed(lowest[own][kinds[own] != ALONE]) if r["holders"] else b""


def compressed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, null as empty: they are dealt out once and read three times."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    for batch in it:
        data = pa.array([zip_((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["block", "doc_id", "data"])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>>, kept binary: what stays of each text, as UTF-8 bytes.

    A byte goes if a string of width bytes over it also starts in a document with a smaller id; strings are judged
    on the input. spans are the maximal removed runs, in bytes. A null or empty text has none; a row with a null id
    keeps its text and takes no part. Rows with the same id do not affect each other. An empty table gives an empty one.
    The last of depths has to be width, the others less; depths and width are GRAM at least.
    """
    docs = id_text(documents, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / min(MOST, max(BLOCK, math.isqrt(total * GROWTH)))))
    tasks = max(blocks, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would deal the texts out once more
    dealt = docs.filter("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text")
    held = dealt.mapInArrow(compressed, "block long, doc_id long, data binary").repartition(tasks, "block")
    block_of = lambda t: t.column("block")[0].as_py()

    def sieve(docs: pa.Table) -> Sieve:
        unzip = zstandard.ZstdDecompressor().decompress
        return Sieve(docs.column("doc_id").to_numpy(), [unzip(x.as_py()) for x in docs.column("data")], width)

    def first_asked(docs: pa.Table) -> pa.Table:
        return table_of(list(sieve(docs).requests(block_of(docs), blocks)), _REQUEST)

    def to_order(docs: pa.Table, replies: pa.Table) -> pa.Table:
        """The runs of a block, as one row: their sizes and bytes, and their holders."""
        if not docs.num_rows:
            return _REPLY.empty_table()
        own = sieve(docs)
        own.answered(replies.to_pylist())
        runs, holders = own.runs()
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        return table_of([(block_of(docs), -1, len(runs), zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(runs)), packed(holders))], _REPLY)

    def suffixes(rows: list[dict], passes: int) -> tuple[int, Suffixes] | None:
        """A block's suffixes after so many passes."""
        row = next((r for r in rows if r["level"] == -1), None)
        if row is None:
            return None
        data = zstandard.ZstdDecompressor().decompress(row["kinds"])
        sizes = np.frombuffer(data, np.int64, row["bucket"])
        ends = 8 * row["bucket"] + np.cumsum(sizes)
        own = Suffixes([data[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], unpacked(row["holders"], np.int64), width, depths)
        for level in range(passes):
            own.answered(level, rows, level + 1 == len(depths))
        return row["block"], own

    def later_asked(level: int):
        def run(rows: pa.Table) -> pa.Table:
            if (own := suffixes(rows.to_pylist(), level)) is None:
                return _REQUEST.empty_table()
            digits, holders = own[1].records(level)
            return table_of(list(sent(own[0], level + 1, blocks, digits, None, holders if level + 1 == len(depths) else None)), _REQUEST)

        return run

    def ordered(rows: pa.Table) -> pa.Table:
        """Whether each of a block's suffixes is repeated, as one row."""
        if (own := suffixes(rows.to_pylist(), len(depths))) is None:
            return _REPLY.empty_table()
        return table_of([(own[0], -2, len(own[1].owner), zstandard.ZstdCompressor(level=1).compress(np.packbits(own[1].repeated()).tobytes()), b"")], _REPLY)

    def answered(key: tuple, requests: pa.Table) -> pa.Table:
        return table_of(list(answers(key[0].as_py(), requests)), _REPLY)

    def replied(requests: DataFrame) -> DataFrame:
        return requests.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answered, REPLY).repartition(tasks, "block")

    first_replies = replied(held.groupBy("block").applyInArrow(first_asked, REQUEST))
    known = held.groupBy("block").cogroup(first_replies.groupBy("block")).applyInArrow(to_order, REPLY).repartition(tasks, "block")
    for level in range(len(depths)):
        known = known.unionByName(replied(known.groupBy("block").applyInArrow(later_asked(level), REQUEST)))
    result = known.groupBy("block").applyInArrow(ordered, REPLY).repartition(tasks, "block")

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        own, rows = sieve(docs), replies.to_pylist()
        own.answered(rows)
        found = next((r for r in rows if r["level"] == -2), None)
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(found["kinds"]), np.uint8), count=found["bucket"]).astype(bool) if found else np.zeros(0, bool)
        windows = own.repeated(bits)
        step = np.zeros(len(windows) + width + 1, np.int32)
        at = np.flatnonzero(windows)
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
        gone = np.cumsum(step)[: len(windows)] > 0
        data = np.frombuffer(own.data, np.uint8)
        rows = []
        for doc, a, b in zip(own.ids.tolist(), own.first.tolist(), [*own.first[1:].tolist(), len(data)], strict=True):
            here = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, here, False].view(np.int8)))
            rows.append((doc, b - a, [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], data[a:b][~here].tobytes()))
        return table_of(rows, out)

    kept = held.groupBy("block").cogroup(first_replies.unionByName(result).groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    unnamed = docs.filter("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return kept.unionByName(unnamed)
