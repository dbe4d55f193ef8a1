"""Keyed changes and incremental runs."""

from pyspark.sql import functions as F

from corpusmill.operators import store
from corpusmill.streaming import incremental


def test_dead_letter_counts_and_cuts(spark):
    old = spark.createDataFrame([(1, 7, "a", None, 0)], store.FAILURES)
    new = spark.createDataFrame([(7, "b" * 2000), (8, "c")], "chunk_id long, error_message string")
    got = {r.chunk_id: (len(r.error_message), r.retry_count) for r in store.dead_letter(old, new, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).collect()}
    assert got == {7: (1000, 1), 8: (1, 0)}


def test_evolution_adds_once(spark):
    df = spark.range(1)
    assert store.evolved(store.evolved(df, "subject", "string"), "subject", "string").columns == ["id", "subject"]


def test_incremental_ingest_reads_files_once(spark, tmp_path):
    schema = "source_id string, content string, pdf_url string"
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("a", "one\n\ntwo", None)], schema).write.parquet(source)
    incremental.ingest(spark, source, target, mark, schema)
    incremental.ingest(spark, source, target, mark, schema)
    assert spark.read.parquet(target).count() == 1
    spark.createDataFrame([("b", "three", None)], schema).write.mode("append").parquet(source)
    incremental.ingest(spark, source, target, mark, schema)
    assert {r.source for r in spark.read.parquet(target).collect()} == {"a", "b"}
