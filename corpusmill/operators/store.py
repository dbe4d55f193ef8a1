"""Keyed changes to tables, as functions from frames to frames; writing them is the caller's step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _i, _t = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()
DOCUMENTS = T.StructType([T.StructField(n, k) for n, k in (("id", _l), ("source_id", _s), ("source_type", _s), ("name", _s), ("content", _s), ("pdf_url", _s), ("created_at", _t), ("updated_at", _t))])
CHUNKS = T.StructType([T.StructField(n, k) for n, k in (("id", _l), ("document_id", _l), ("text", _s), ("chunk_index", _i), ("source", _s), ("pdf_url", _s), ("subject", _s), ("created_at", _t))])
FAILURES = T.StructType([T.StructField(n, k) for n, k in (("id", _l), ("chunk_id", _l), ("error_message", _s), ("failed_at", _t), ("retry_count", _i))])
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "failed_classifications": FAILURES}
ERROR_CHARS = 1000


def merge(target: DataFrame, updates: DataFrame, key: str, change: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """target with updates merged on key: matched rows take change, new keys insert; other columns keep the target's
    value, or the update's for a new key. In change and insert, t.x and u.x name the two sides. One shuffle a side."""
    t, u = target.alias("t"), updates.alias("u")
    both = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
    matched, new = F.col(f"t.{key}").isNotNull() & F.col(f"u.{key}").isNotNull(), F.col(f"t.{key}").isNull()

    def value(c: str) -> Column:
        old = F.col(f"t.{c}")
        fresh = insert.get(c, F.col(f"u.{c}") if c in updates.columns else F.lit(None))
        return F.when(new, fresh).when(matched, change[c]).otherwise(old) if c in change else F.when(new, fresh).otherwise(old)

    return both.select(*(value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def upsert_documents(target: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New documents by source_id; known ones take content, pdf_url, name and updated_at, and keep the rest."""
    u = {c: F.col(f"u.{c}") for c in ("content", "pdf_url", "name")}
    return merge(target, updates, "source_id", u | {"updated_at": now}, {"created_at": now, "updated_at": now, "id": F.xxhash64("u.source_id")})


def replace_chunks(chunks: DataFrame, document_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks without those of document_ids, and fresh ones."""
    return chunks.join(document_ids, "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def update_by_id(rows: DataFrame, values: DataFrame, column: str, key: str = "id") -> DataFrame:
    """rows with column replaced where values (key, column) has a row; a null there counts as no value."""
    new = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return rows.join(new, rows[key] == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias("_k")), rows[key] == F.col("_k"), "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, failures: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents go, with their chunks and those chunks' failures."""
    gone = chunks.join(ids.select(F.col(ids.columns[0]).alias("document_id")), "document_id", "left_semi").select("id")
    return delete_ids(documents, ids), delete_ids(chunks, ids, "document_id"), delete_ids(failures, gone, "chunk_id")


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def reset(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.lit(None).cast(rows.schema[column].dataType))


def dead_letter(failures: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Failures with new ones (chunk_id, error_message): a known chunk takes the message and one more retry."""
    message = F.substring(F.col("u.error_message"), 1, ERROR_CHARS)
    return merge(failures, new, "chunk_id", {"error_message": message, "retry_count": F.col("t.retry_count") + 1, "failed_at": now}, {"id": F.xxhash64("u.chunk_id"), "error_message": message, "retry_count": F.lit(0), "failed_at": now})


def only_new(documents: DataFrame, stored: DataFrame, key: str = "source_id") -> DataFrame:
    return documents.join(stored.select(key).distinct(), key, "left_anti")


def merge_stores(documents: DataFrame, chunks: DataFrame, target_documents: DataFrame, target_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Another store's rows into this one: (documents, chunks, map of old to new document ids).

    A known source_id keeps this store's id; others get one from their name. Chunks follow the map; those without a
    document, or whose place is taken, are left out.
    """
    known = target_documents.select(F.col("id").alias("_known"), "source_id")
    mapped = documents.join(known, "source_id", "left").withColumn("new_id", F.coalesce("_known", F.xxhash64("source_id")))
    ids = mapped.select(F.col("id").alias("old_id"), "new_id")
    added = mapped.filter("_known is null").withColumn("id", F.col("new_id")).drop("_known", "new_id")
    moved = chunks.join(ids, chunks["document_id"] == ids["old_id"]).withColumn("document_id", F.col("new_id")).drop("old_id", "new_id")
    fresh = moved.join(target_chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti").withColumn("id", F.xxhash64("document_id", "chunk_index"))
    return target_documents.unionByName(added, allowMissingColumns=True), target_chunks.unionByName(fresh, allowMissingColumns=True), ids


def remap_failures(failures: DataFrame, chunks: DataFrame, ids: DataFrame, target_chunks: DataFrame, target_failures: DataFrame) -> DataFrame:
    """Another store's failures that this one lacks, on this store's chunk ids, by (document, chunk index)."""
    old = failures.join(chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("old_id"), "chunk_index"), "chunk_id").join(ids, "old_id")
    place = target_chunks.select(F.col("id").alias("new_chunk"), F.col("document_id").alias("new_id"), "chunk_index")
    return old.join(place, ["new_id", "chunk_index"]).withColumn("chunk_id", F.col("new_chunk")).select(*failures.columns).join(target_failures.select("chunk_id"), "chunk_id", "left_anti")


def bootstrap(spark: SparkSession, database: str) -> list[str]:
    """Create the store's tables where they are missing; returns those it made."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = [name for name in SCHEMAS if not spark.catalog.tableExists(f"{database}.{name}")]
    for name in made:
        spark.createDataFrame([], SCHEMAS[name]).write.saveAsTable(f"{database}.{name}", format="parquet")
    return made


def evolved(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """rows with a nullable column, if it lacks it."""
    return rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))


def has_rows(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def read_store(spark: SparkSession, table: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A store's table: Parquet under path, or over JDBC with the caller's options."""
    return spark.read.format("jdbc").options(**jdbc, dbtable=table).load() if jdbc else spark.read.parquet(f"{path}/{table}.parquet")
