"""Target-distribution importance resampling: documents drawn by how much their word n-grams look like those of a target.

Each Spark task holds a DuckDB connection in memory. Its SQL takes the words of a batch of texts apart, unnests them,
makes the n-grams by windows, and counts them by bucket with a registered zlib CRC. The counts of every document go to
Parquet, and one row of totals a task. Spark merges the totals, and scores, sorts and ranks the documents.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, chunks, forget, id_text, packed, unpacked, written

BUCKETS, ORDERS = 10_000, 3  #: n-grams of 1 to ORDERS words
SEGMENT = 1 << 20  #: characters of a batch, and of a piece of a text that is longer
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_ANY_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPILL = "doc_id long, n_words long, n_features long, buckets binary, counts binary, is_total boolean"
_SPILL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary()), ("is_total", pa.bool_())])


def counting_sql(orders: int = ORDERS) -> str:
    """SQL from pieces (rid, text, more) to rid, bucket, n. more holds the words of the same text that follow a piece: they
    end n-grams that start in the piece, and start none. Bucket -1 counts the piece's words."""
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '{WORD}')"
    leads = ", ".join(f"lead(w1, {k}) OVER following AS w{k + 1}" for k in range(1, orders))
    grams = ", ".join(" || ' ' || ".join(f"w{j}" for j in range(1, k + 1)) for k in range(1, orders + 1))  # null where a word is missing
    return f"""
        WITH listed AS (SELECT rid, {words("text")} AS own, {words("more")} AS next FROM pieces),
        words AS (SELECT rid, len(own) AS n_own, unnest(own || next) AS w1, generate_subscripts(own || next, 1) AS i FROM listed),
        led AS (SELECT rid, n_own, i, w1{", " if leads else ""}{leads} FROM words WINDOW following AS (PARTITION BY rid ORDER BY i)),
        grams AS (SELECT rid, unnest([{grams}]) AS gram FROM led WHERE i <= n_own),
        hashed AS (SELECT rid, bucket(gram) AS bucket FROM grams WHERE gram IS NOT NULL),
        counted AS (SELECT rid, bucket, count(*) AS n FROM hashed GROUP BY ALL UNION ALL SELECT rid, -1, len(own) FROM listed)
        SELECT rid, bucket, n FROM counted ORDER BY rid, bucket"""


def connection(buckets: int = BUCKETS):
    """DuckDB in this task's memory: one thread, nothing on disk, bucket(text) registered."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1})
    con.execute("SET temp_directory = ''")

    def bucket(column):
        texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        texts = texts.cast(pa.binary()).to_numpy(zero_copy_only=False)
        return pa.array(np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts)) % buckets, pa.int32())

    con.create_function("bucket", bucket, [con.sqltype("VARCHAR")], con.sqltype("INTEGER"), type="arrow")
    return con


def pieces_of(text: str, size: int, orders: int = ORDERS) -> Iterator[tuple[str, str]]:
    """(piece, the orders - 1 words after it) of a text: cut between words only, at about size characters."""
    at = 0
    while len(text) - at > size and (cut := _NOT_WORD.search(text, at + size)):
        after = [m for _, m in zip(range(orders - 1), _ANY_WORD.finditer(text, cut.start()), strict=False)]
        yield text[at : cut.start()], " ".join(m[0] for m in after)
        at = cut.start()
    yield text[at:], ""


def counted(documents: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, segment: int = SEGMENT, each: bool = True) -> DataFrame:
    """A row a document (if each) with its bucket counts, and a row of totals a task."""
    sql = counting_sql(orders)
    top = np.iinfo(np.int32).max

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection(buckets)
        totals = np.zeros(buckets, np.int64)

        def of(ids: list[int], pieces: list[tuple[int, str, str]]) -> Iterator[tuple]:
            """Rows of the documents ids, whose pieces carry their places in ids."""
            con.register("pieces", pa.table({"rid": pa.array([p[0] for p in pieces], pa.int32()), "text": pa.array([p[1] for p in pieces], pa.string()), "more": pa.array([p[2] for p in pieces], pa.string())}))
            got = con.sql(sql).fetchnumpy()
            con.unregister("pieces")
            rid, bucket, n = (np.asarray(got[c]).astype(np.int64) for c in ("rid", "bucket", "n"))
            ends = np.searchsorted(rid, np.arange(len(ids) + 1))
            for k, doc in enumerate(ids):
                yield doc, bucket[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]

        def rows_of() -> Iterator[tuple]:
            for held in chunks(it, segment):
                short = [(doc, text or "") for doc, text in held if len(text or "") <= segment]
                yield from of([doc for doc, _ in short], [(k, text, "") for k, (_, text) in enumerate(short)])
                for doc, text in ((doc, text) for doc, text in held if len(text or "") > segment):
                    sums, words = np.zeros(buckets, np.int64), 0
                    for piece, more in pieces_of(text, segment, orders):
                        for _, bucket, n in of([doc], [(0, piece, more)]):
                            words += int(n[bucket < 0].sum())
                            sums[bucket[bucket >= 0]] += n[bucket >= 0]
                    yield doc, np.r_[-1, np.flatnonzero(sums)], np.r_[words, sums[sums > 0]]

        def out() -> Iterator[tuple]:
            for doc, bucket, n in rows_of():
                own = bucket >= 0
                words, bucket, n = int(n[~own].sum()), bucket[own], n[own]
                totals[bucket] += n  # a bucket is in a row once
                if each:
                    yield doc, words, int(n.sum()), packed(np.diff(bucket, prepend=0).astype(np.uint32)), packed(np.minimum(n, top).astype(np.uint32)), False
            some = np.flatnonzero(totals)
            yield None, 0, int(totals.sum()), packed(some.astype(np.uint32)), packed(totals[some]), True

        yield from batches(out(), _SPILL)
        con.close()

    return id_text(documents).mapInArrow(run, SPILL)


def merged(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The totals of all tasks, summed by Spark: at most `buckets` rows come to the driver."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(b, np.uint32).astype(np.int32)), pa.array(unpacked(n, np.int64))], schema=schema)

    out = np.zeros(buckets, np.int64)
    for r in rows.filter("is_total").select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln(its smoothed share of the target / that of the source)), in doubles."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, from the id alone; a null id draws as the empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document of counted()."""
    shared: Broadcast = rows.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in it:
                for doc, words, features, buckets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    weight = int(shared.value[np.cumsum(unpacked(buckets, np.uint32), dtype=np.int64)] @ unpacked(counts, np.uint32).astype(np.int64))
                    yield doc, words, features, weight, weight + noise(doc, seed)

        yield from batches(out(), schema)

    return rows.filter("not is_total").select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows with rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows of least_words words, ties
    to the smaller doc_id (null first); null for the rest. No row meets another outside its range of scores: a range sort
    deals rows out, a place is the rows of the ranges before plus the place in its own."""
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    keyed = rows.withColumns({"_able": able, "_row": F.monotonically_increasing_id()})
    keyed = written(keyed, "scored")  # _row parts equal rows, and must not change between the sample and the sort
    order = [F.desc("_able"), F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(dealt.drop("_row"), "ranked")
    forget(spark, keyed)
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r.n, r.able) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.count_if("_able").alias("able")).collect())  # a row a range
    drawn, before, starts = percent * sum(x[2] for x in sizes) // 100, 0, []
    for p, n, _ in sizes:
        starts.append((p, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))  # a row a range
    rank = F.col("_before") + place + 1
    return placed.withColumn("_part", part).join(first, "_part", "left").withColumn("rank", F.when(F.col("_able") & (rank <= drawn), rank)).drop("_part", "_before", "_place", "_able")


def resample(documents: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Features are all runs of 1 to 3 words in a row, counted with their repeats by bucket. Null and empty texts have none,
    and weight 0. A null id draws its noise as the empty one; rows that share an id share its noise, and each counts. An
    empty target or table gives weights from the smoothing alone. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession)
    own = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spilled = scratch.written(counted(own, segment=segment), "counts")
    wanted = counted(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), segment=segment, each=False)
    gain = gains(merged(spilled), merged(wanted))
    out = ranked(scored(spilled, gain, seed), least_words, percent)
    scratch.close()
    return out
