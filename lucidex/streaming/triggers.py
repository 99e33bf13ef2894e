"""Coalesced rebuild triggers, change relevance, queues and retries.

A change opens a wait of a few seconds.  Further changes in the wait are absorbed and
do not extend it; one rebuild fires at its end.  A change at or after the end opens a
new wait.  Times are whole seconds, as a job queue keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lucidex.functions.text import let
from lucidex.operators.exposure import EXCLUDE_KEY, EXCLUDING_TAXONOMIES
from lucidex.operators.skew import attach

#: Waits and caps of the queues.
REBUILD_WAIT = 5
RETRY_WAIT = 300
QUEUE_CAP = 10
QUEUE_DELAY = 1

#: Seconds of one chunk of a site's feed.
CHUNK = 3_600


def relevant_changes(changes: DataFrame, content: DataFrame, profile: DataFrame) -> DataFrame:
    """Changes that can alter a site's index.

    The type must be exposed.  The status is not looked at: a document that leaves the
    published state must trigger too.  Metadata counts only for the exclusion key, terms
    only for categories and tags of sites that exclude by term.  Works on a stream as
    well, with *content* and *profile* static.
    """
    documents = content.select("site_id", "content_id", "post_type")
    key = ["site_id", "content_id"]  # numbers start anew on every site
    others = [c for c in changes.columns if c not in key]
    if changes.isStreaming:
        rows = changes.join(documents, key)
    else:
        # One document may hold a third of the feed: look each changed document up once,
        # then spread its changes.
        touched = documents.join(changes.select(*key).distinct(), key, "left_semi")
        rows = attach(changes, touched, key, others, "inner")
    settings = profile.select("site_id", "exposed_types", "excluded_term_ids", "excluded_term_slugs")
    rows = attach(rows, settings, ["site_id"], others + ["content_id"], "inner")
    has_term_rules = (F.size("excluded_term_ids") > 0) | (F.size("excluded_term_slugs") > 0)
    by_kind = (
        F.when(F.col("kind") == "meta", F.col("meta_key") == EXCLUDE_KEY)
        .when(F.col("kind") == "term", F.col("taxonomy").isin(*EXCLUDING_TAXONOMIES) & has_term_rules)
        .otherwise(F.lit(True)))
    typed = F.array_contains("exposed_types", F.col("post_type"))
    return rows.filter((F.col("content_id") > 0) & typed & by_kind).select(*changes.columns)


def _open_until(seconds: Column, due: Column, wait: int) -> Column:
    """When the last wait of a sorted array of seconds ends, from a given end."""
    return F.aggregate(seconds, due, lambda end, s: F.when(s >= end, s + wait).otherwise(end))


def _fires(seconds: Column, due: Column, wait: int) -> Column:
    """The ends of all waits opened in a sorted array of seconds."""
    start = F.struct(due.alias("due"), F.array().cast("array<bigint>").alias("fires"))

    def step(state: Column, s: Column) -> Column:
        opened = F.struct((s + wait).alias("due"), F.concat(state["fires"], F.array(s + wait)).alias("fires"))
        return F.when(s >= state["due"], opened).otherwise(state)

    return F.aggregate(seconds, start, step, lambda state: state["fires"])


def rebuild_triggers(changes: DataFrame, wait: int = REBUILD_WAIT) -> DataFrame:
    """When each site rebuilds: ``site_id, fire_second``.

    The greedy rule is sequential, but a site's feed is not read in one task.  Seconds
    collapse on the map side, and each hour of a site is one chunk of at most 3,600
    seconds.  A chunk depends on the one before only through how far its last wait
    reaches into the next hour, which has *wait* possible values.  Each chunk is solved
    for all of them, the short list of hours is chained, and the chunks then give their
    fires.
    """
    seconds = changes.select("site_id", F.col("second").cast("bigint").alias("second")).distinct()
    hour = F.floor(F.col("second") / F.lit(CHUNK)).cast("bigint")
    chunks = (seconds.withColumn("hour", hour).groupBy("site_id", "hour")
              .agg(F.sort_array(F.collect_list("second")).alias("seconds")))
    begin, end = F.col("hour") * CHUNK, (F.col("hour") + 1) * CHUNK
    zero = F.lit(0).cast("bigint")
    offsets = F.sequence(zero, F.lit(wait - 1).cast("bigint"))
    reach = let(F.col("seconds"), lambda ordered: F.transform(
        offsets, lambda over: F.greatest(zero, _open_until(ordered, begin + over, wait) - end)))
    hours = chunks.select("site_id", "hour", reach.alias("reach"))

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """The offset each hour is entered with: one small row per active hour."""
        entered, over, before = [], 0, None
        rows = rows.sort_values("hour")
        for now, reaches in zip(rows["hour"], rows["reach"]):
            over = over if before == now - 1 else 0
            entered.append(over)
            before, over = now, int(reaches[over])
        return pd.DataFrame({"site_id": rows["site_id"], "hour": rows["hour"], "over": entered})

    entries = hours.groupBy("site_id").applyInPandas(chain, "site_id string, hour bigint, over bigint")
    solved = chunks.join(entries, ["site_id", "hour"])
    fires = let(F.col("seconds"), lambda ordered: _fires(ordered, begin + F.col("over"), wait))
    return solved.select("site_id", F.explode(fires).alias("fire_second"))


def stream_triggers(changes: DataFrame, wait: int = REBUILD_WAIT, watermark: str = "10 minutes") -> DataFrame:
    """The same on a stream of ``site_id, ts``.

    Repeats of a second are dropped first, spread over (site, second), so a hot site
    reaches its state at one row per second at most.  Seconds wait in the state until the
    watermark has passed them and are then taken in order, so a late one counts as in the batch.
    State holds the end of a site's open wait and the seconds of the watermark's delay.
    """
    seconds = (changes.select("site_id", F.date_trunc("second", "ts").alias("ts"))
               .withWatermark("ts", watermark).dropDuplicates(["site_id", "ts"]))

    def coalesce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = state.get if state.exists else (None, [])
        waiting = set(waiting)
        if not state.hasTimedOut:
            waiting |= {int(t.timestamp()) for batch in batches for t in batch["ts"]}
        now = state.getCurrentWatermarkMs() // 1000
        fires = []
        for second in sorted(s for s in waiting if s < now):
            waiting.remove(second)
            if due is None or second >= due:
                if due is not None:
                    fires.append(due)
                due = second + wait
        if due is not None and due <= now:
            fires.append(due)
            due = None
        if due is None and not waiting:
            state.remove()
        else:
            state.update((due, sorted(waiting)))
            wake = min([due] * (due is not None) + [s + 1 for s in waiting])
            state.setTimeoutTimestamp(max(wake * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"site_id": [key[0]] * len(fires), "fire_second": pd.Series(fires, dtype="int64")})

    return seconds.groupBy("site_id").applyInPandasWithState(
        coalesce, "site_id string, fire_second bigint", "due bigint, waiting array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def busy_periods(seconds: DataFrame, delay: int) -> DataFrame:
    """The distinct seconds of each site (site_id, second) with the ``begin`` of their busy period.

    A period begins where no job of an earlier second can still be pending.  A site's feed isn't read in
    one task: gaps are found inside hours, and one row per hour carries the last second and the last begin on.
    """
    hour = F.floor(F.col("second") / F.lit(CHUNK)).cast("bigint")
    placed = seconds.select("site_id", F.col("second").cast("bigint").alias("second")).distinct().withColumn("hour", hour)
    ends = placed.groupBy("site_id", "hour").agg(F.max("second").alias("_end"))
    hours = Window.partitionBy("site_id").orderBy("hour")
    before = ends.withColumn("_before", F.lag("_end").over(hours)).drop("_end")
    inside = Window.partitionBy("site_id", "hour").orderBy("second")
    joined = placed.join(before, ["site_id", "hour"])
    previous = F.coalesce(F.lag("second").over(inside), F.col("_before"))
    marked = joined.withColumn("_begin", F.when(previous.isNull() | (F.col("second") - previous >= delay), F.col("second")))
    own = marked.withColumn("_begin", F.last("_begin", ignorenulls=True).over(inside)).drop("_before")
    carried = own.groupBy("site_id", "hour").agg(F.max("_begin").alias("_last"))
    ahead = hours.rowsBetween(Window.unboundedPreceding, -1)
    entered = carried.select("site_id", "hour", F.last("_last", ignorenulls=True).over(ahead).alias("_carried"))
    return own.join(entered, ["site_id", "hour"]).select("site_id", "second", F.coalesce("_begin", "_carried").alias("begin"))


def queue_admissions(requests: DataFrame, cap: int = QUEUE_CAP, delay: int = QUEUE_DELAY) -> DataFrame:
    """What :func:`stream_queue` decides, for a whole feed of ``site_id, content_id, second``.

    The queue is surely empty where a busy period begins, so periods are decided apart, side by side.
    In a period requests go by second and document; a task reads its sorted periods one row at a time and
    holds at most *cap* pending jobs.  A site without any pause of *delay* seconds is one period.
    """
    asked = requests.select("site_id", "content_id", F.col("second").cast("bigint").alias("second")).distinct()
    placed = asked.join(busy_periods(asked, delay), ["site_id", "second"])
    ordered = placed.repartition("site_id", "begin").sortWithinPartitions("site_id", "begin", "second", "content_id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period, pending = None, {}
        for batch in batches:
            outcomes, dues = [], []
            columns = [batch.column(c).to_pylist() for c in ("site_id", "begin", "second", "content_id")]
            for site, begin, second, doc in zip(*columns):
                if (site, begin) != period:
                    period, pending = (site, begin), {}
                pending = {d: due for d, due in pending.items() if due > second}
                if doc in pending:
                    outcomes.append("pending")
                elif len(pending) >= cap:
                    outcomes.append("refused")
                else:
                    pending[doc] = second + delay
                    outcomes.append("queued")
                dues.append(pending.get(doc))
            yield pa.RecordBatch.from_arrays(
                [batch.column("site_id"), batch.column("content_id"), batch.column("second"), pa.array(outcomes, pa.string()), pa.array(dues, pa.int64())],
                ["site_id", "content_id", "second", "outcome", "due_second"])

    return ordered.mapInArrow(decide, "site_id string, content_id bigint, second bigint, outcome string, due_second bigint")


def stream_queue(requests: DataFrame, cap: int = QUEUE_CAP, watermark: str = "10 minutes", delay: int = QUEUE_DELAY) -> DataFrame:
    """Per-document jobs with a cap on how many are pending per site.

    A document already pending is not queued again; with *cap* pending a request is
    refused.  Output: ``site_id, content_id, outcome, due_second``.
    """
    timed = (requests.select("site_id", "content_id", F.date_trunc("second", "ts").alias("ts"))
             .withWatermark("ts", watermark).dropDuplicates(["site_id", "content_id", "ts"]))

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() // 1000
            pending = {doc: due for doc, due in pending.items() if due > now}
        # In the order of time over all of a trigger's batches; how Arrow cuts them plays no part.
        arrived = sorted((int(ts.timestamp()), doc) for batch in batches for doc, ts in zip(batch["content_id"], batch["ts"]))
        if arrived:
            out = []
            for second, doc in arrived:
                pending = {d: due for d, due in pending.items() if due > second}
                if doc in pending:
                    out.append((key[0], doc, "pending", pending[doc]))
                elif len(pending) >= cap:
                    out.append((key[0], doc, "refused", None))
                else:
                    pending[doc] = second + delay
                    out.append((key[0], doc, "queued", pending[doc]))
            yield pd.DataFrame(out, columns=["site_id", "content_id", "outcome", "due_second"]).astype(
                {"due_second": "Int64"})
        if pending:
            state.update((list(pending), list(pending.values())))
            state.setTimeoutTimestamp(max(max(pending.values()) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return timed.groupBy("site_id").applyInPandasWithState(
        admit, "site_id string, content_id bigint, outcome string, due_second bigint",
        "docs array<bigint>, dues array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def retry_plan(failures: DataFrame, wait: int = RETRY_WAIT) -> DataFrame:
    """One deferred retry per prompt and options, *wait* seconds after the first failure.

    *failures* has ``prompt, options, failure, second``; permanent ones are not retried.
    Prompts are long, so they are grouped by hash and never shuffled.
    """
    retryable = failures.filter(F.col("failure").isin("rate_limit", "network", "unknown"))
    keyed = retryable.select(F.sha1(F.concat_ws("\x1f", "prompt", "options")).alias("job"), "failure", "second")
    return keyed.groupBy("job").agg(
        (F.min("second") + wait).alias("due_second"),
        F.min_by("failure", F.struct("second", "failure")).alias("first_failure"))
