"""Classification of a store's chunks in batches that can be stopped, begun again and run twice.

A batch is one commit: labels into chunks, failures into dead letters, successes out of them, and the place reached.
A run that dies between two commits goes on from the last; one that fails on a whole page still goes on behind it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import enrich
from ..operators.snapshots import Change, Conflict, SnapshotStore
from ..session import shared_folder

Classify = Callable[[DataFrame], DataFrame]  #: chunks (id, text) to id, subject, error
RESULT = "id long, subject string, error string"


def once(own: SnapshotStore, rows: DataFrame) -> tuple[DataFrame, str]:
    """rows as a written table, so that a provider is asked once however often they are read; and its folder."""
    path = f"{shared_folder(own.spark)}/replies-{uuid.uuid4().hex}"
    rows.select("id", "subject", "error").write.parquet(path)
    return own.spark.read.schema(RESULT).parquet(path), path


def labelled(change: Change, results: DataFrame, now: Column) -> Change:
    good, bad = results.filter("error is null"), results.filter("error is not null")
    change.update_subjects(good.select("id", "subject")).delete_failures(good.select(F.col("id").alias("chunk_id")))
    return change.dead_letter(bad.select(F.col("id").alias("chunk_id"), F.col("error").alias("error_message")), now)


def committed(own: SnapshotStore, results: DataFrame, now: Column, tries: int = 5, **ledger) -> int:
    """The results as a commit; where another writer was first, on top of what it wrote."""
    for k in range(tries):
        try:
            return labelled(own.begin(), results, now).commit(**ledger)
        except Conflict:
            if k + 1 == tries:
                raise
    raise AssertionError("unreachable")


def classify_all(own: SnapshotStore, classify: Classify, now: Column, size: int = 3, subject: str | None = None, run: str = "classify", stop: Callable[[], bool] = lambda: False, keep: int | None = None) -> dict[str, int]:
    """Pages of chunks without a subject (or with that one) in the order of their ids, until none is left or stop() says so.

    The store's ledger holds the last id of a run; a run of that name goes on behind it. Chunks that fail are passed by
    and stay in dead letters. With keep, only so many versions stay behind each batch, which no other writer may be at
    work beside. Returns classified, errors and batches of this call.
    """
    out = {"classified": 0, "errors": 0, "batches": 0}
    while not stop():
        manifest = own.manifest(own.version())
        page = enrich.next_page(own.of(manifest, "chunks"), manifest.get("ledger", {}).get(run, -(1 << 63)), size, subject).select("id", "text")
        results, path = once(own, classify(page))
        n = results.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.max("id").alias("last")).first()
        if n.n and not stop():
            committed(own, results, now, **{run: n.last})
            out = {"classified": out["classified"] + n.n - n.bad, "errors": out["errors"] + n.bad, "batches": out["batches"] + 1}
            if keep is not None:
                own.vacuum(keep)
        own.files.delete(path)
        if not n.n:
            break
    return out


def restart(own: SnapshotStore, run: str = "classify") -> int:
    """The next run of that name begins with the first chunk."""
    change = own.begin()
    change.manifest.get("ledger", {}).pop(run, None)
    return change.commit()


def retry(own: SnapshotStore, classify: Classify, now: Column, size: int = 15) -> dict[str, int]:
    """One pass over the failures that were least often, then longest ago tried."""
    page = enrich.retry_page(own.read("failed_classifications"), own.read("chunks"), size).select(F.col("chunk_id").alias("id"), "text")
    results, path = once(own, classify(page))
    n = results.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if n.n:
        committed(own, results, now)
    own.files.delete(path)
    return {"retried": n.n - n.bad, "still_failed": n.bad, "remaining": own.read("failed_classifications").count()}


def into_store(own: SnapshotStore, classify: Classify, now: Column, run: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: chunks of a stream are labelled in the store. A batch that was committed before has no effect."""

    def write(batch: DataFrame, number: int) -> None:
        if own.manifest(own.version()).get("ledger", {}).get(run, -1) >= number:
            return
        results, path = once(own, classify(batch.select("id", "text").dropDuplicates(["id"])))
        committed(own, results, now, **{run: number})
        own.files.delete(path)

    return write
