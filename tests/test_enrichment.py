"""Batches of labels on a store, providers that fail and limit, and frames that are kept."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cache, provider, snapshots
from corpusmill.streaming import enrichment


def now():
    return F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))


def labels(rows):
    bad = F.col("id") % 4 == 1
    return rows.select("id", F.when(~bad, "events").alias("subject"), F.when(bad, F.concat(F.lit("no "), "text")).alias("error"))


@pytest.fixture
def own(spark, tmp_path):
    s = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    rows = spark.range(12).select("id", (F.col("id") % 5).alias("document_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") == 2, "sports").alias("subject"))
    s.begin().load("chunks", rows).load("failed_classifications", spark.createDataFrame([(1, 3, "old", 2)], "id long, chunk_id long, error_message string, retry_count int")).commit()
    return s


def state(own):
    return sorted((r.id, r.subject) for r in own.read("chunks").collect()), sorted((r.chunk_id, r.error_message, r.retry_count) for r in own.read("failed_classifications").collect())


WANT = ([(k, "sports" if k == 2 else None if k % 4 == 1 else "events") for k in range(12)], [(k, f"no t{k}", 0) for k in (1, 5, 9)])


def test_a_stopped_run_and_its_rest_equal_one_run(own):
    turns = iter([False, False, True])
    first = enrichment.classify_all(own, labels, now(), 4, stop=lambda: next(turns))
    assert first == {"classified": 3, "errors": 1, "batches": 1} and own.manifest(own.version())["ledger"] == {"classify": 4}
    rest = enrichment.classify_all(own, labels, now(), 4, keep=2)
    assert own.versions() == [3, 4]
    assert rest["classified"] == 5 and rest["errors"] == 2 and state(own) == WANT


def test_a_run_that_dies_before_its_commit_asks_again(own):
    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        enrichment.classify_all(own, dies, now(), 5)
    assert own.version() == 1
    enrichment.classify_all(own, labels, now(), 5)
    assert state(own) == WANT


def test_a_page_of_failures_does_not_hold_up_the_rest(own):
    def only_late(rows):
        bad = F.col("id") < 6
        return rows.select("id", F.when(~bad, "events").alias("subject"), F.when(bad, "no").alias("error"))

    assert enrichment.classify_all(own, only_late, now(), 3) == {"classified": 6, "errors": 5, "batches": 4}
    enrichment.restart(own)
    assert enrichment.classify_all(own, labels, now(), 100)["errors"] == 2  # chunks 1 and 5 once more
    assert [x for x in state(own)[1] if x[0] in (1, 5)] == [(1, "no t1", 1), (5, "no t5", 1)]


def test_retry_pass(own):
    enrichment.classify_all(own, labels, now(), 100)
    good = lambda rows: rows.select("id", F.lit("staff").alias("subject"), F.lit(None).cast("string").alias("error"))
    assert enrichment.retry(own, labels, now(), 2) == {"retried": 0, "still_failed": 2, "remaining": 3}
    assert enrichment.retry(own, good, now(), 1) == {"retried": 1, "still_failed": 0, "remaining": 2}
    chunks, failures = state(own)
    assert (9, "staff") in chunks and [(k, n) for k, _, n in failures] == [(1, 1), (5, 1)]


def test_a_batch_of_a_stream_counts_once(spark, own):
    write = enrichment.into_store(own, labels, now(), "stream")
    batch = own.read("chunks")
    write(batch, 0)
    version = own.version()
    write(batch, 0)
    assert own.version() == version and state(own)[1] == WANT[1]


def test_a_writer_in_between_is_kept(own, monkeypatch):
    real, turns = enrichment.labelled, []

    def slow(change, results, when):
        out = real(change, results, when)
        if not turns:
            turns.append(own.begin().load("documents", own.read("documents")).commit())
        return out

    monkeypatch.setattr(enrichment, "labelled", slow)
    enrichment.classify_all(own, labels, now(), 100)
    assert state(own) == WANT and own.version() == 3


# --- providers


class Time:
    """A clock that a sleep moves."""

    def __init__(self):
        self.at, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(round(s, 3))
        self.at += s


def paced(t, **x):
    return provider.TokenBucket(provider.Pacing(sleep=t.sleep, clock=lambda: t.at, **x))


def test_a_bucket_lets_through_what_it_may():
    t = Time()
    bucket = paced(t, per_second=2, burst=3)
    starts = []
    for _ in range(7):
        bucket.take()
        starts.append(round(t.at, 3))
    assert starts == [0, 0, 0, 0.5, 1, 1.5, 2]


def test_limits_are_tried_again_by_their_delay():
    t, said = Time(), []

    def limited(text):
        said.append(text)
        if len(said) < 3:
            raise RuntimeError("429: Please retry in 2.5s" if len(said) == 1 else "quota exceeded")
        return "fine"

    assert provider.call(limited, "x", paced(t, per_second=100, burst=9, tries=3, wait=7)) == ("fine", None, 3) and t.slept == [3.5, 7]
    assert provider.call(lambda _: 1 / 0, "x", paced(t, tries=3)) == (None, "division by zero", 1)
    said.clear()
    assert provider.call(limited, "x", paced(t, tries=2))[1:] == ("quota exceeded", 2)
    assert provider.delay_of("Please retry in 1.2.3s") is None


def test_classified_by_a_provider(spark):
    def model(text):
        if text == "bad":
            raise ValueError("refused")
        return {"a": '{"category": "Events", "confidence": 0.9}', "b": 'so: {"category": "staff", "confidence": 0.2}'}.get(text, "?")

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "bad"), (5, None)], "id long, text string")
    got = {r.id: (r.subject, r.error) for r in provider.classified(rows, model, provider.Pacing(per_second=1e9, burst=99)).collect()}
    assert got == {1: ("events", None), 2: ("low_confidence", None), 3: ("general", None), 4: (None, "refused"), 5: ("general", None)}


def test_expansion_by_providers_that_may_fail(spark):
    def terms(q):
        if "x" in q:
            raise ValueError("no")
        return '"terms: one two"'

    rows = spark.createDataFrame([(1, "when is it"), (2, "école x"), (3, None)], "query_id long, query string")
    fast = provider.Pacing(per_second=1e9, burst=99)
    got = {r.query_id: r.query for r in provider.expanded(rows, terms, lambda q: f"fr {q}", fast).collect()}
    assert got[1] == "when is it fr when is it one two" and got[2] == "école x"
    assert {r.query_id: r.query for r in provider.expanded(rows, pacing=fast).collect()}[1] == "when is it"


# --- frames that are kept


def test_two_callers_load_once(spark):
    loads = []

    def load():
        loads.append(1)
        time.sleep(0.3)
        return spark.range(3)

    own, got = cache.FrameCache(), []
    threads = [threading.Thread(target=lambda: got.append(own.get("a", load, 1))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(loads) == 1 and len({id(f) for f in got}) == 1 and got[0].storageLevel.useMemory


def test_age_version_and_empty_frames(spark):
    t, loads = Time(), []

    def load(rows=True):
        loads.append(rows)
        return spark.range(len(loads) if rows else 0)  # equal plans would share one persisted frame

    own = cache.FrameCache(lifetime=10, clock=lambda: t.at)
    own.get("a", load, 1)
    t.at = 9
    own.get("a", load, 1)
    assert len(loads) == 1
    t.at = 10
    old = own.get("a", load, 1)
    own.get("a", load, 2)
    assert len(loads) == 3 and not old.storageLevel.useMemory and old.count() == 2
    own.get("none", lambda: load(False))
    own.get("none", lambda: load(False))
    assert loads[-2:] == [False, False]
    own.drop("a")
    own.get("a", load, 2)
    assert len(loads) == 6


def test_chunks_of_a_store_follow_its_version(own):
    kept = cache.FrameCache()
    one = cache.chunks_of(kept, own)
    assert cache.chunks_of(kept, own) is one
    own.begin().clear("documents").commit()
    assert cache.chunks_of(kept, own) is not one
