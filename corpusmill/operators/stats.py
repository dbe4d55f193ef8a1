"""Counts and distributions of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_non_content

#: (label, sizes below); the last takes the rest.
BUCKETS = (("< 1K", 1000), ("1K-5K", 5000), ("5K-10K", 10_000), ("10K-100K", 100_000), ("100K-1M", 1_000_000), ("> 1M", None))


def histogram(rows: DataFrame, text: str) -> DataFrame:
    """bucket, rank, n by length, in the order of size."""
    size, label, rank = F.length(text), F.lit(BUCKETS[-1][0]), F.lit(len(BUCKETS))
    for k, (name, below) in reversed(list(enumerate(BUCKETS[:-1], 1))):
        label, rank = F.when(size < below, name).otherwise(label), F.when(size < below, k).otherwise(rank)
    return rows.groupBy(label.alias("bucket"), rank.cast("int").alias("rank")).agg(F.count("*").alias("n")).orderBy("rank")


def progress(chunks: DataFrame, column: str = "subject") -> DataFrame:
    done = F.count(column)
    return chunks.agg(F.count("*").alias("total"), done.alias("classified"), (F.count("*") - done).alias("unclassified"), F.when(F.count("*") == 0, 0).otherwise(F.round(100 * done / F.count("*"))).cast("long").alias("percent"))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def longest(chunks: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """The k longest chunks with their documents; the id settles ties. Only k rows meet the documents."""
    top = chunks.select("id", "document_id", F.length("text").cast("long").alias("size"), preview(F.col("text")).alias("preview")).orderBy(F.desc("size"), "id").limit(k)
    return top.join(documents.select(F.col("id").alias("document_id"), "source_id"), "document_id").select("id", "source_id", "size", "preview")


def health(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """connected, documents, chunks, chunks that retrieval would read."""
    read = (F.col("subject").isNull() | (F.col("subject") != "low_confidence")) & ~is_non_content(F.col("source"), F.col("text"))
    return documents.agg(F.count("*").alias("n_documents")).join(chunks.agg(F.count("*").alias("n_chunks"), F.count_if(read).alias("n_content"))).select(F.lit(True).alias("connected"), "n_documents", "n_chunks", "n_content")


def average_size(documents: DataFrame, text: str) -> DataFrame:
    """avg_size: the mean length, rounded."""
    return documents.agg(F.round(F.avg(F.length(text))).cast("long").alias("avg_size"))


def extents(rows: DataFrame, kind: Column) -> DataFrame:
    """category, n of each kind of source."""
    return rows.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def folder_counts(files: DataFrame, folder: Column) -> DataFrame:
    """folder, n of the files in each folder, and of all as total."""
    return files.select(folder.alias("folder")).rollup("folder").agg(F.count("*").alias("n")).select(F.coalesce("folder", F.lit("total")).alias("folder"), "n")


def ingest_summary(pieces: DataFrame) -> DataFrame:
    """status, n, chars of pieces (status, text)."""
    return pieces.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
