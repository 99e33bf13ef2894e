"""Deferred retries and late results on streams, with timers in keyed state.

A job that failed is tried again once, some minutes after the first failure; failures until then change nothing,
a later one opens a new wait.  A result counts only if its audit is still the newest of its site.  Both
rules follow event time: what arrives waits in the state until the watermark has passed it, so the order of
arrival plays no part, and state is cleared when nothing is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lucidex.streaming.triggers import RETRY_WAIT, rebuild_triggers

RETRYABLE = ("rate_limit", "network", "unknown")


def _jobs(failures: DataFrame) -> DataFrame:
    job = F.sha1(F.concat_ws("\x1f", "prompt", "options"))
    return failures.filter(F.col("failure").isin(*RETRYABLE)).withColumn("job", job)


def retry_schedule(failures: DataFrame, wait: int = RETRY_WAIT) -> DataFrame:
    """All retries of a whole feed (prompt, options, failure, second): job, due_second, first_failure.

    Unlike ``triggers.retry_plan``, a failure at or after a retry opens a new wait.
    """
    keyed = _jobs(failures).select("job", F.col("second").cast("bigint").alias("second"), "failure")
    fires = rebuild_triggers(keyed.select(F.col("job").alias("site_id"), "second"), wait)
    opened = fires.select(F.col("site_id").alias("job"), (F.col("fire_second") - wait).alias("second"), F.col("fire_second").alias("due_second"))
    first = keyed.groupBy("job", "second").agg(F.min("failure").alias("first_failure"))
    return opened.join(first, ["job", "second"]).select("job", "due_second", "first_failure")


class _Waits(StatefulProcessor):
    """Failures of a job wait for the watermark; then the first opens a wait and its end is the retry."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getMapState("failures", "second bigint", "failure string")
        self.open = handle.getValueState("open", "due bigint, failure string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for second, failure in sorted({(int(ts.timestamp()), failure) for ts, failure in zip(batch["ts"], batch["failure"])}, reverse=True):
                known = self.failures.getValue((second,))[0] if self.failures.containsKey((second,)) else None
                self.failures.updateValue((second,), (failure if known is None else min(known, failure),))
                self.handle.registerTimer(second * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        out = []
        if self.open.exists():
            due, failure = self.open.get()
            if due <= now:
                out.append((key[0], due, failure))
                self.open.clear()
        if self.failures.containsKey((now,)):
            failure = self.failures.getValue((now,))[0]
            self.failures.removeKey((now,))
            if not self.open.exists():
                self.open.update((now + self.wait, failure))
                self.handle.registerTimer((now + self.wait) * 1000)
        yield pd.DataFrame(out, columns=["job", "due_second", "first_failure"]).astype({"due_second": "int64"})

    def close(self) -> None:
        pass


def stream_retries(failures: DataFrame, wait: int = RETRY_WAIT, watermark: str = "10 minutes") -> DataFrame:
    """:func:`retry_schedule` on a stream of prompt, options, failure and ts; a retry comes out once the watermark has passed it."""
    timed = _jobs(failures).select("job", "failure", F.date_trunc("second", "ts").alias("ts")).withWatermark("ts", watermark)
    return timed.groupBy("job").transformWithStateInPandas(
        _Waits(wait), "job string, due_second bigint, first_failure string", "Append", "EventTime")


def current_results(results: DataFrame, audits: DataFrame) -> DataFrame:
    """Results (site_id, stamp, result, second) whose stamp is that of the newest audit at their time.

    *audits* has site_id, stamp and second; of audits in one second the greatest stamp is the newest.  A hot
    site's feed is not read in one task: results are joined with the span in which their audit was the newest.
    """
    newest = audits.groupBy("site_id", "second").agg(F.max("stamp").alias("stamp"))
    order = Window.partitionBy("site_id").orderBy("second")
    spans = newest.withColumn("until", F.lead("second").over(order)).withColumnRenamed("second", "since")
    inside = (F.col("second") >= F.col("since")) & (F.col("until").isNull() | (F.col("second") < F.col("until")))
    return results.join(spans, ["site_id", "stamp"]).filter(inside).select("site_id", "stamp", "result", "second").distinct()


class _Newest(StatefulProcessor):
    """Audits and results of a site in the order of their seconds; only the newest stamp is kept for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second bigint, stamp string, result string", "seen boolean")
        self.stamp = handle.getValueState("stamp", "stamp string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ts, stamp, result in zip(batch["ts"], batch["stamp"], batch["result"]):
                second = int(ts.timestamp())
                self.waiting.updateValue((second, stamp, "" if pd.isna(result) else f"={result}"), (True,))
                self.handle.registerTimer(second * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        due = [k for k in self.waiting.keys() if k[0] == now]
        stamps = [stamp for _, stamp, result in due if not result]
        if stamps:
            self.stamp.update((max(stamps),))
        newest = self.stamp.get()[0] if self.stamp.exists() else None
        kept = [(key[0], stamp, result[1:], second) for second, stamp, result in due if result and stamp == newest]
        for k in due:
            self.waiting.removeKey(k)
        yield pd.DataFrame(kept, columns=["site_id", "stamp", "result", "second"]).astype({"second": "int64"})

    def close(self) -> None:
        pass


def stream_current_results(results: DataFrame, audits: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """:func:`current_results` on streams of site_id, stamp, result and ts, and of site_id, stamp and ts."""
    second = F.date_trunc("second", "ts").alias("ts")
    told = audits.select("site_id", "stamp", F.lit(None).cast("string").alias("result"), second)
    both = results.select("site_id", "stamp", "result", second).unionByName(told).withWatermark("ts", watermark)
    return both.groupBy("site_id").transformWithStateInPandas(_Newest(), "site_id string, stamp string, result string, second bigint", "Append", "EventTime")
