"""Exact duplicates by source and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(documents: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """key, n, keep_id of keys with more than one document. Aggregates combine before the shuffle; ids are not gathered."""
    return documents.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("keep_id")).filter("n > 1")


def duplicate_ids(documents: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Ids that removal takes: all but the least of a key."""
    return documents.join(groups(documents, key, id_col).select(key, "keep_id"), key).filter(F.col(id_col) != F.col("keep_id")).select(id_col)


def survivors(documents: DataFrame, content: str, id_col: str = "id") -> DataFrame:
    """One document of each content."""
    hashed = documents.withColumn("_md5", F.md5(content))
    return documents.join(duplicate_ids(hashed, "_md5", id_col), id_col, "left_anti")


def report(documents: DataFrame, source: str, content: str, id_col: str = "id") -> DataFrame:
    """One row: groups by source, groups by content among what those leave, and distinct duplicates of both."""
    firsts = documents.groupBy(source).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))  # combines before the shuffle, so a large source is one row a task
    sources = firsts.agg(F.count_if((F.col("n") > 1) & F.col(source).isNotNull()).alias("source_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("source_duplicates"))
    kept = documents.select(F.col(id_col).alias("first_id"), F.md5(content).alias("md5")).join(firsts.select("first_id"), "first_id", "left_semi")
    rest = kept.groupBy("md5").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("content_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("content_duplicates"))
    return sources.join(rest).select("source_groups", "content_groups", (F.col("source_duplicates") + F.col("content_duplicates")).alias("duplicates"))
