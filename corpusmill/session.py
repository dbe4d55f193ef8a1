"""Session settings shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter makes it."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("corpusmill")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, bytes of one, and rows of a batch that Parquet is read in, where rows hold whole texts.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts no larger than SMALL, unless the session asks for less: an executor holds several of them,
    in and beside its heap. The settings are read when a plan runs, so they have to stay: a session that an operator
    has used keeps them."""
    for key, most in SMALL.items():
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit] <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share. Where it is unset, a session on one machine
    takes a folder of that machine; a cluster has none that all its machines see, and that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/corpusmill-checkpoints"
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: read as often as wanted, made once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
