"""Incremental ingest and classification: what is new since the last run, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk_table
from ..operators.enrich import classified


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, separator: str = r"\n\s*\n") -> None:
    """Chunk the Parquet files that appeared under source since the last call, into target (source, index, text).

    schema has source_id, content and pdf_url. Files count once: the checkpoint remembers them; each batch writes
    its own folder, overwritten if the batch runs again.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_table(batch.dropDuplicates(["source_id"]), separator).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run(spark.readStream.schema(schema).parquet(source), write, checkpoint)


def classify(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, model: Callable | None = None) -> None:
    """Label the chunks that appeared under source since the last call, into target (id, subject, error)."""

    def write(batch: DataFrame, number: int) -> None:
        classified(batch, model).withColumn("labelled", F.lit(True)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run(spark.readStream.schema(schema).parquet(source), write, checkpoint)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
