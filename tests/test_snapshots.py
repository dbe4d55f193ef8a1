"""A store whose changes take effect in one step or not at all."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import snapshots, store

def now():
    return F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))


@pytest.fixture
def own(spark, tmp_path):
    s = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=16)
    docs = spark.range(100).select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.lit("old").alias("content"))
    parts = spark.range(300).select("id", (F.col("id") % 100).alias("document_id"), F.lit("t").alias("text"), (F.col("id") / 100).cast("int").alias("chunk_index"))
    s.begin().load("documents", docs).load("chunks", parts).load("failed_classifications", parts.filter("id < 50").select("id", F.col("id").alias("chunk_id"), F.lit(0).alias("retry_count"))).commit()
    return s


def test_only_touched_buckets_are_rewritten(spark, own):
    before = own.manifest(1)["tables"]["documents"]
    updates = spark.createDataFrame([("s7", "new"), ("s1000", "new")], "source_id string, content string").withColumns({"pdf_url": F.lit(None).cast("string"), "name": F.lit("n"), "source_type": F.lit("file")})
    own.begin().upsert_documents(updates, now()).commit()
    after = own.manifest(2)["tables"]["documents"]
    touched = {str(r.b) for r in updates.select(own.bucket(F.col("source_id")).alias("b")).collect()}
    assert {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)} == touched and len(touched) <= 2 < len(before)
    assert {r.source_id for r in own.read("documents").filter("content = 'new'").collect()} == {"s7", "s1000"}
    assert own.read("documents").count() == 101 and own.read("documents", 1).filter("content = 'new'").count() == 0


def test_a_second_writer_gets_a_conflict(spark, own):
    one, two = own.begin(), own.begin()
    ids = spark.createDataFrame([(3,)], "id long")
    one.delete_documents(ids).commit()
    two.clear("documents")
    with pytest.raises(snapshots.Conflict):
        two.commit()
    assert own.version() == 2 and own.read("documents").count() == 99 and own.read("chunks").count() == 297 and own.read("failed_classifications").filter("chunk_id = 3").isEmpty()


def test_a_writer_that_dies_leaves_the_old_version(spark, own):
    change = own.begin()
    change.clear("chunks").reset("documents", "content")
    del change  # never committed: its files are there, but no manifest names them
    assert own.version() == 1 and own.read("chunks").count() == 300 and own.read("documents").filter("content = 'old'").count() == 100
    own.vacuum()
    assert own.read("chunks").count() == 300


def test_vacuum_keeps_what_is_named(spark, own):
    own.begin().update_subjects(spark.createDataFrame([(1, "events"), (101, None)], "id long, subject string")).commit()
    own.begin().replace_chunks(spark.createDataFrame([(2,)], "document_id long"), spark.createDataFrame([(900, 2, 0, "x"), (901, 500, 0, "y")], "id long, document_id long, chunk_index int, text string")).commit()
    own.vacuum(keep=1)
    rows = own.read("chunks")
    assert own.versions() == [3] and rows.count() == 299 and rows.filter("subject = 'events'").count() == 1
    assert {(r.document_id, r.text) for r in rows.filter("text <> 't'").collect()} == {(2, "x"), (500, "y")}


def test_dead_letters_and_empty_changes(spark, own):
    new = spark.createDataFrame([(5, "bad"), (700, "bad")], "chunk_id long, error_message string")
    own.begin().dead_letter(new, now()).delete_failures(spark.createDataFrame([], "chunk_id long")).commit(cursor=9)
    got = {r.chunk_id: r.retry_count for r in own.read("failed_classifications").filter("error_message = 'bad'").collect()}
    assert got == {5: 1, 700: 0} and own.manifest(2)["ledger"] == {"cursor": 9}
    assert own.begin().clear("documents").commit() == 3 and own.read("documents").isEmpty() and own.read("documents").schema == store.DOCUMENTS


def test_compact_brings_files_together(spark, own):
    rows = spark.range(400).select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id")).repartition(12)
    own.begin().load("documents", rows).commit()
    count = lambda: sum(n.endswith(".parquet") for p in own.manifest(own.version())["tables"]["documents"].values() for n in own.files.names(f"{own.folder}/{p}"))
    assert count() > 100
    own.begin().compact("documents", files=2).commit()
    assert count() <= 32 and {r.id for r in own.read("documents").collect()} == set(range(400))
