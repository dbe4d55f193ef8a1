"""Tables that change in one step: buckets of rows by key, and a manifest that names the files of every bucket.

A change writes new files for the buckets that hold its keys and leaves the others; its manifest then takes the next
number by a rename that fails where another writer has it. Readers see the last manifest, or the one they ask for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

BUCKETS = 64
#: Keys by which the engine's tables are dealt to buckets.
KEYS = {"documents": "source_id", "chunks": "document_id", "failed_classifications": "chunk_id"}


class Conflict(RuntimeError):
    """Another change took the next version."""


class Files:
    """The few calls to a shared file system that manifests need."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.jvm, self.gateway, self.path = jvm, spark.sparkContext._gateway, jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(folder).toUri(), spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        """Whether source is target now; false where target is there already."""
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(source), self.path(target), options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class SnapshotStore:
    """The tables of a folder. schemas and keys say what they hold; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType] | None = None, keys: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schemas, self.keys, self.buckets = spark, folder.rstrip("/"), schemas or store.SCHEMAS, keys or KEYS, buckets
        self.files = Files(spark, self.folder)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/versions/{version:08d}.json")) if version else {"tables": {}, "ledger": {}}

    def version(self) -> int:
        return max(self.versions(), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.of(self.manifest(self.version() if version is None else version), table)

    def of(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table's rows by a manifest, of some buckets or all."""
        held = manifest["tables"].get(table, {})
        paths = [f"{self.folder}/{p}" for b, p in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        schema = self.schemas[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 1) -> None:
        """Forgets all but the last `keep` versions, and deletes files that none of these name. Not while a change is under way."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            self.files.delete(f"{self.folder}/versions/{v:08d}.json")
        named = {p.split("/")[1] for m in kept for t in m["tables"].values() for p in t.values()}
        for name in set(self.files.names(f"{self.folder}/data")) - named:
            self.files.delete(f"{self.folder}/data/{name}")


class Change:
    """Changes to any of a store's tables that take effect together, by commit(), or not at all."""

    def __init__(self, own: SnapshotStore):
        self.store, self.base = own, own.version()
        self.manifest = own.manifest(self.base)
        self.rewritten: dict[str, set[int]] = {}

    def read(self, table: str) -> DataFrame:
        return self.store.of(self.manifest, table)

    def _put(self, table: str, rows: DataFrame, buckets: set[int] | None) -> None:
        """rows in place of a table's buckets (None: all). They are written where they are: a task gives a bucket a file, and
        compact() brings a bucket's files together."""
        name, key = f"data/{uuid.uuid4().hex}", self.store.keys[table]
        columns = [f.name for f in self.store.schemas[table]]
        kept = {int(b): p for b, p in self.manifest["tables"].get(table, {}).items() if buckets is not None and int(b) not in buckets}
        fitted = reduce(lambda df, f: df.withColumn(f.name, (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)), self.store.schemas[table], rows).select(*columns)
        fitted.withColumn("_bucket", self.store.bucket(F.col(key))).write.partitionBy("_bucket").parquet(f"{self.store.folder}/{name}")
        fresh = {int(n.split("=")[1]): f"{name}/{n}" for n in self.store.files.names(f"{self.store.folder}/{name}") if n.startswith("_bucket=")}
        self.rewritten.setdefault(table, set()).update(fresh if buckets is None else buckets)
        self.manifest["tables"][table] = {str(b): p for b, p in sorted((kept | fresh).items())}

    def load(self, table: str, rows: DataFrame) -> Change:
        """rows as the whole table."""
        self._put(table, rows, None)
        return self

    def touched(self, table: str, keys: DataFrame, column: str) -> set[int]:
        """Buckets that hold or would hold the rows of which column is among keys. The driver gets a number a bucket."""
        own = self.store.keys[table]
        if column == own:
            found = keys.select(self.store.bucket(F.col(column).cast(self.store.schemas[table][own].dataType)).alias("b"))
        else:
            found = self.read(table).select(column, own).join(keys.select(column).distinct(), column, "left_semi").select(self.store.bucket(F.col(own)).alias("b"))
        return {r.b for r in found.distinct().collect()}

    def rewrite(self, table: str, keys: DataFrame, column: str, made: Callable[[DataFrame], DataFrame]) -> Change:
        """made(rows) in place of the rows of the buckets that the keys touch; made changes rows of these keys alone."""
        buckets = self.touched(table, keys, column)
        if buckets:
            self._put(table, made(self.store.of(self.manifest, table, buckets)), buckets)
        return self

    # The engine's mutations, each on the buckets that it touches.

    def upsert_documents(self, updates: DataFrame, now: Column) -> Change:
        return self.rewrite("documents", updates, "source_id", lambda rows: store.upsert_documents(rows, updates, now))

    def replace_chunks(self, document_ids: DataFrame, fresh: DataFrame) -> Change:
        both = document_ids.select("document_id").unionByName(fresh.select("document_id"))
        return self.rewrite("chunks", both, "document_id", lambda rows: store.replace_chunks(rows, document_ids, fresh))

    def update_subjects(self, values: DataFrame) -> Change:
        return self.rewrite("chunks", values, "id", lambda rows: store.update_by_id(rows, values, "subject"))

    def delete_failures(self, chunk_ids: DataFrame) -> Change:
        keys = chunk_ids.select(F.col(chunk_ids.columns[0]).alias("chunk_id"))
        return self.rewrite("failed_classifications", keys, "chunk_id", lambda rows: store.delete_ids(rows, keys, "chunk_id"))

    def dead_letter(self, new: DataFrame, now: Column) -> Change:
        return self.rewrite("failed_classifications", new, "chunk_id", lambda rows: store.dead_letter(rows, new, now))

    def delete_documents(self, ids: DataFrame) -> Change:
        """Documents, their chunks, and those chunks' failures."""
        ids = ids.select(F.col(ids.columns[0]).alias("id"))
        gone = self.read("chunks").join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
        self.rewrite("failed_classifications", gone, "chunk_id", lambda rows: store.delete_ids(rows, gone, "chunk_id"))
        self.rewrite("chunks", ids.select(F.col("id").alias("document_id")), "document_id", lambda rows: store.delete_ids(rows, ids, "document_id"))
        return self.rewrite("documents", ids, "id", lambda rows: store.delete_ids(rows, ids))

    def reset(self, table: str, column: str) -> Change:
        return self.load(table, store.reset(self.read(table), column))

    def compact(self, table: str, files: int = 8) -> Change:
        """A table's buckets as at least one and at most about `files` files each, for which its rows are shuffled."""
        many = [b for b, p in self.manifest["tables"].get(table, {}).items() if sum(n.endswith(".parquet") for n in self.store.files.names(f"{self.store.folder}/{p}")) > files]
        if many:
            buckets = set(map(int, many))
            self._put(table, self.store.of(self.manifest, table, buckets).repartition(self.store.bucket(F.col(self.store.keys[table]))), buckets)
        return self

    def clear(self, table: str) -> Change:
        self.manifest["tables"][table] = {}
        return self

    def commit(self, **ledger) -> int:
        """Takes effect as the next version; Conflict, without effect, if that was taken since begin(). ledger: what to remember with it."""
        self.manifest["ledger"] = self.manifest.get("ledger", {}) | ledger
        staged, target = f"{self.store.folder}/staged-{uuid.uuid4().hex}.json", f"{self.store.folder}/versions/{self.base + 1:08d}.json"
        self.store.files.fs.mkdirs(self.store.files.path(f"{self.store.folder}/versions"))
        self.store.files.write(staged, json.dumps(self.manifest))
        if not self.store.files.move(staged, target):
            self.store.files.delete(staged)
            raise Conflict(f"version {self.base + 1} was written by another change")
        return self.base + 1
