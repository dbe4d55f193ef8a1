"""Subjects by a model, in batches: labels, a dead-letter table, and retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_subjects
from . import store

PREVIEW = 1000  #: characters that a model sees


def classified(chunks: DataFrame, classify: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """id, subject, error: a subject for each chunk from its first characters. classify maps texts to (subject, error)
    frames; the default takes the first keyword subject."""
    text = F.substring("text", 1, PREVIEW)
    if classify is None:
        return chunks.select("id", F.element_at(keyword_subjects(text), 1).alias("subject"), F.lit(None).cast("string").alias("error"))
    run = F.pandas_udf(classify, "subject string, error string")
    return chunks.select("id", run(text).alias("r")).select("id", "r.subject", "r.error")


def next_page(chunks: DataFrame, last_id: int, size: int = 3, subject: str | None = None) -> DataFrame:
    """Unclassified chunks (or those of a subject) after last_id."""
    pending = F.col("subject").isNull() if subject is None else F.col("subject") == subject
    return chunks.filter(pending & (F.col("id") > last_id)).orderBy("id").limit(size)


def applied(chunks: DataFrame, failures: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Subjects into chunks; errors into failures; what succeeded leaves failures."""
    good, bad = results.filter("error is null"), results.filter("error is not null")
    left = store.delete_ids(failures, good.select("id"), "chunk_id")
    return store.update_by_id(chunks, good.select("id", "subject"), "subject"), store.dead_letter(left, bad.select(F.col("id").alias("chunk_id"), F.col("error").alias("error_message")), now)


def recent_failures(failures: DataFrame, chunks: DataFrame, k: int = 100) -> DataFrame:
    """The last k failures that still have a chunk, with its preview."""
    joined = failures.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    return joined.orderBy(F.desc("failed_at"), "chunk_id").limit(k).select("chunk_id", "error_message", "failed_at", "retry_count", F.substring("text", 1, 200).alias("preview"))


def retry_page(failures: DataFrame, chunks: DataFrame, size: int = 15) -> DataFrame:
    """The failures to try next: least often tried, then oldest."""
    joined = failures.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    return joined.orderBy("retry_count", "failed_at", "chunk_id").limit(size).select("chunk_id", "retry_count", "failed_at", "text")


def retried(chunks: DataFrame, failures: DataFrame, classify: Callable | None, now: Column, size: int = 15) -> tuple[DataFrame, DataFrame]:
    """One retry pass over a page of failures."""
    page = retry_page(failures, chunks, size).select(F.col("chunk_id").alias("id"), "text")
    return applied(chunks, failures, classified(page, classify), now)
