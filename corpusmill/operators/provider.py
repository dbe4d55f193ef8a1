"""Remote models as callables: paced a worker, tried again by the delay that an error asks for, given up as an error row."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T

_DELAY = re.compile(r"please retry in ([\d.]+)s", re.I)
_LIMITED = re.compile("429|quota|rate limit")


@dataclass(frozen=True)
class Pacing:
    """Calls a second and at once of each worker; tries of a call; what to wait where a limit names no delay. A limit of a
    provider divides by the number of workers."""

    per_second: float = 1.5
    burst: int = 3
    tries: int = 2
    wait: float = 5.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic


class TokenBucket:
    def __init__(self, pacing: Pacing):
        self.pacing, self.tokens, self.last = pacing, float(pacing.burst), pacing.clock()

    def take(self) -> None:
        """Returns when a call may start."""
        p = self.pacing
        while True:
            at = p.clock()
            self.tokens, self.last = min(p.burst, self.tokens + (at - self.last) * p.per_second), at
            if self.tokens >= 1 - 1e-9:
                self.tokens -= 1
                return
            p.sleep((1 - self.tokens) / p.per_second)


def delay_of(message: str) -> float | None:
    """Seconds that an error asks to wait, and one more (text.retry_delay_ms() of one message); None if it does not say."""
    try:
        return (math.ceil(float(m[1]) * 1000) + 1000) / 1000 if (m := _DELAY.search(message)) else None
    except ValueError:
        return None


def call(provider: Callable[[str], str], text: str, bucket: TokenBucket) -> tuple[str | None, str | None, int]:
    """Reply, error and tries. Limits are tried again, other errors are not."""
    p, error = bucket.pacing, None
    for k in range(1, p.tries + 1):
        bucket.take()
        try:
            return provider(text), None, k
        except Exception as e:  # whatever the provider raises becomes a row
            error = str(e)
        if not _LIMITED.search(error) or k == p.tries:
            break
        delay = delay_of(error)
        p.sleep(p.wait if delay is None else delay)
    return None, error, k


def replies(rows: DataFrame, text: Column, provider: Callable[[str], str], pacing: Pacing = Pacing()) -> DataFrame:
    """rows with reply, error, tries: what the provider says to each text. A null text is not sent and has neither.

    provider and pacing go to the workers, so they must pickle; a task that runs again calls again, so write the result
    before it is used twice.
    """
    asked = rows.withColumn("_asked", text)
    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("error", StringType()), StructField("tries", IntegerType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(pacing)
        for frame in it:
            got = [(None, None, 0) if pd.isna(t) else call(provider, t, bucket) for t in frame.pop("_asked")]
            frame["reply"], frame["error"], frame["tries"] = (list(c) for c in zip(*got, strict=True)) if got else ([], [], [])
            yield frame

    return asked.mapInPandas(run, schema)


def classified(chunks: DataFrame, provider: Callable[[str], str], pacing: Pacing = Pacing(), preview: int = 1000) -> DataFrame:
    """id, subject, error of chunks (id, text): the provider sees the first characters and replies in JSON; a reply that
    cannot be read is general, one of little confidence low_confidence, and an error leaves the subject null."""
    got = replies(chunks.select("id", "text"), F.substring("text", 1, preview), provider, pacing)
    return got.select("id", F.when(F.col("error").isNull(), T.reply_subject(F.col("reply"))).alias("subject"), "error")


def expanded(queries: DataFrame, expander: Callable[[str], str] | None = None, translator: Callable[[str], str] | None = None, pacing: Pacing = Pacing()) -> DataFrame:
    """query_id, query: with a translation where a query needs one and it differs, and with more terms. Providers that fail, or
    are not given, add nothing."""
    rows = queries.select("query_id", "query")
    nothing = F.lit(None).cast("string")
    if translator is None:
        rows = rows.withColumn("_other", nothing)
    else:
        rows = replies(rows, F.when(T.needs_translation(F.col("query")), F.col("query")), translator, pacing).select("query_id", "query", F.col("reply").alias("_other"))
    if expander is None:
        rows = rows.withColumn("_terms", nothing)
    else:
        rows = replies(rows, F.col("query"), expander, pacing).select("query_id", "query", "_other", F.col("reply").alias("_terms"))
    empty = F.lit("")
    return rows.select("query_id", T.expanded_and_translated(F.col("query"), F.coalesce("_other", empty), F.coalesce("_terms", empty)).alias("query"))
