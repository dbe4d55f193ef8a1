"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import shared_folder, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names, so that extra columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text) one by one; a batch is never turned into Python objects as a whole."""
    ids, texts = batch.column(0), batch.column(1)
    for k in range(batch.num_rows):
        yield ids[k].as_py(), texts[k].as_py()


def batches(rows_out: Iterable[tuple], schema: pa.Schema, every_rows: int = 2000, every_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded size."""
    held: list[tuple] = []
    weight = 0
    for row in rows_out:
        held.append(row)
        weight += sum(len(x) if isinstance(x, (str, bytes, list)) else 8 for x in row)
        if len(held) >= every_rows or weight >= every_bytes:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def chunks(it: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[list[tuple[int | None, str | None]]]:
    """(doc_id, text) rows in lists of about size characters."""
    held, weight = [], 0
    for batch in it:
        for row in rows(batch):
            held.append(row)
            weight += len(row[1] or "") + 8
            if weight >= size:
                yield held
                held, weight = [], 0
    if held:
        yield held


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel() if len(planes) else np.zeros(0, dtype)


def store_dir(spark: SparkSession) -> str:
    """A fresh folder that the executors share."""
    return f"{shared_folder(spark)}/corpusmill-{uuid.uuid4().hex}"


class Scratch:
    """Written tables of one job in a folder of its own, which close() deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, store_dir(spark), 0

    def written(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df as a written table: cuts lineage and outlives a lost executor."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.path)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a written table in the shared folder, for results that outlive the job; forget() deletes it."""
    path = f"{store_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a written table."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(spark, f)
