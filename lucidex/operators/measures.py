"""Site measures that follow a change log, without reading the stored texts again.

A document's part in the measures is a narrow row of facts.  A change batch takes the old facts of its
documents out and puts the new ones in: counts and sums are added with a sign.  The worst documents can't be
kept by sums, so each site has a reserve of them, complete up to a bound; drops use it up and puts below the
bound join it.  Only a site whose reserve falls short of what is shown is filled again, from its facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.operators.audit import QUALITY_THRESHOLD, WORST_LIMIT, body_quality
from lucidex.operators.skew import top_per_group
from lucidex.sources import snapshots
from lucidex.sources.tables import append_change, commits, read_changing
from lucidex.sources.work import release, written

KEY = ["site_id", "content_id"]

FACTS = ("site_id string, content_id bigint, quality_score int, is_empty boolean, is_noisy boolean, "
         "is_listed boolean, is_described boolean")

#: Worst documents that a site keeps beyond what is shown.
RESERVE = 50

SUMS = ("rows_total", "rows_with_score", "score_sum", "rows_above_threshold", "empty_rows", "noisy_rows",
        "total_entries", "entries_with_description")


def facts_of(store: DataFrame, listed: Column, described: Column) -> DataFrame:
    """The facts of stored documents; *listed* and *described* say if they are index entries, with a description."""
    judged = body_quality(store)
    return judged.select(*KEY, "quality_score", "is_empty", "is_noisy", F.coalesce(listed, F.lit(False)).alias("is_listed"),
                         F.coalesce(described, F.lit(False)).alias("is_described"))


def _signed(facts: DataFrame, sign: int) -> DataFrame:
    score = F.col("quality_score").cast("bigint")
    ones = {"rows_total": F.lit(True), "rows_with_score": score.isNotNull(), "rows_above_threshold": score >= QUALITY_THRESHOLD,
            "empty_rows": F.col("is_empty"), "noisy_rows": F.col("is_noisy"), "total_entries": F.col("is_listed"),
            "entries_with_description": F.col("is_listed") & F.col("is_described")}
    values = {name: F.when(flag, F.lit(sign)).otherwise(F.lit(0)).cast("bigint") for name, flag in ones.items()}
    values["score_sum"] = F.coalesce(score, F.lit(0)) * sign
    return facts.select("site_id", *[values[name].alias(name) for name in SUMS])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site_id").agg(*[F.sum(name).alias(name) for name in SUMS])


def _reserve(facts: DataFrame, reserve: int) -> DataFrame:
    """The worst documents of each site, and after them one more that shows whether there are others."""
    scored = facts.filter(F.col("quality_score").isNotNull() & (F.col("content_id") != 0)).select(*KEY, "quality_score")
    return top_per_group(scored, ["site_id"], [F.asc("quality_score"), F.asc("content_id")], reserve + 1, ["content_id"])


def _place(score: str = "quality_score", content: str = "content_id") -> Column:
    return F.struct(F.col(score).alias("quality_score"), F.col(content).alias("content_id"))


@dataclass(frozen=True)
class Measures:
    """*sites*: site_id, the sums and ``bound``, up to which the reserve is complete (null: it holds all).

    *worst*: site_id, content_id, quality_score of the reserve.
    """

    sites: DataFrame
    worst: DataFrame

    def report(self) -> DataFrame:
        """The measures as an audit reads them: :func:`audit.markdown_stats`, ``body_quality_rates`` and ``description_coverage`` in one."""
        n = F.col("rows_total")
        return self.sites.select(
            "site_id", "rows_total", "rows_with_score",
            F.when(F.col("rows_with_score") > 0, F.col("score_sum") / F.col("rows_with_score")).otherwise(F.lit(0.0)).alias("mean_quality"),
            "rows_above_threshold", (F.col("empty_rows") / n).alias("empty_ratio"), (F.col("noisy_rows") / n).alias("noisy_ratio"),
            "total_entries", "entries_with_description")

    def shown(self, limit: int = WORST_LIMIT) -> DataFrame:
        """The worst documents with their rank."""
        return top_per_group(self.worst, ["site_id"], [F.asc("quality_score"), F.asc("content_id")], limit, ["content_id"])


def _cut(ranked: DataFrame, reserve: int) -> tuple[DataFrame, DataFrame]:
    """The reserve without the row beyond it, and per site the bound where there is one."""
    last = ranked.groupBy("site_id").agg(F.max("rank").alias("_n"), F.max_by(_place(), F.when(F.col("rank") <= reserve, F.col("rank"))).alias("_last"))
    bound = last.select("site_id", F.col("_n").alias("_held"), F.when(F.col("_n") > reserve, F.col("_last")).alias("_bound"))
    return ranked.filter(F.col("rank") <= reserve).drop("rank"), bound


def measure(facts: DataFrame, reserve: int = RESERVE) -> Measures:
    """The measures of all facts."""
    worst, bounds = _cut(_reserve(facts, reserve), reserve)
    sites = _summed(_signed(facts, 1)).join(bounds, "site_id", "left").select("site_id", *SUMS, F.col("_bound").alias("bound"))
    return Measures(sites, worst)


def follow(now: Measures, facts: DataFrame, puts: DataFrame, drops: DataFrame, reserve: int = RESERVE,
           shown: int = WORST_LIMIT) -> tuple[Measures, DataFrame]:
    """The measures and facts after a batch.

    *facts* are those before it.  *puts* are whole facts and *drops* keys, the last change of each document:
    a document is in one of them at most, and once.  A drop of an unknown document changes nothing.
    """
    keys = puts.select(*KEY).unionByName(drops.select(*KEY))
    old = written(facts.join(keys, KEY, "left_semi"), "measure-old")  # as many rows as the batch
    deltas = _summed(_signed(old, -1).unionByName(_signed(puts, 1)))
    after = now.sites.select("site_id", *SUMS).unionByName(deltas)
    sums = _summed(after).filter("rows_total > 0")
    facts_after = facts.join(keys, KEY, "left_anti").unionByName(puts.select(*facts.columns))

    bounds = now.sites.select("site_id", F.col("bound").alias("_was"))
    scored = puts.filter(F.col("quality_score").isNotNull() & (F.col("content_id") != 0)).select(*KEY, "quality_score")
    joining = scored.join(bounds, "site_id", "left").filter(F.col("_was").isNull() | (_place() <= F.col("_was"))).drop("_was")
    rest = now.worst.join(keys, KEY, "left_anti").unionByName(joining)
    order = [F.asc("quality_score"), F.asc("content_id")]
    ranked = written(top_per_group(rest, ["site_id"], order, reserve + 1, ["content_id"]), "measure-ranked")
    worst, cut = _cut(ranked, reserve)
    limits = (sums.select("site_id").join(bounds, "site_id", "left").join(cut, "site_id", "left")
              .select("site_id", F.coalesce("_bound", "_was").alias("bound"), F.coalesce("_held", F.lit(0)).alias("_held")))
    # There may be more beyond the bound, and too few are left below it.
    short = written(limits.filter(F.col("bound").isNotNull() & (F.col("_held") < shown)).select("site_id"), "measure-short")
    refilled, found = _cut(_reserve(facts_after.join(short, "site_id", "left_semi"), reserve), reserve)
    limits = (limits.join(short.withColumn("_short", F.lit(True)), "site_id", "left").join(found.select("site_id", "_bound"), "site_id", "left")
              .select("site_id", F.when(F.col("_short"), F.col("_bound")).otherwise(F.col("bound")).alias("bound")))
    sites = sums.join(limits, "site_id", "left").select("site_id", *SUMS, "bound")
    alive = worst.join(short, "site_id", "left_anti").unionByName(refilled.select(*worst.columns))
    return Measures(sites, alive), facts_after


def refresh(spark: SparkSession, root: str, puts: DataFrame, drops: DataFrame, run: str, reserve: int = RESERVE) -> snapshots.Snapshot:
    """A batch of the log, applied once under the name of its run.

    Facts are a changing table and measures a published version that names the facts it goes with, so a run
    that failed in between starts from the same facts again.  It must be repeated before another may start.
    """
    measures, log = f"{root}/measures", f"{root}/facts"
    last = snapshots.latest(spark, measures)
    if last and last.run == run:
        return last
    seen = int(last.stamp) if last else -1
    others = commits(spark, log).filter((F.col("seq") > seen) & (F.col("kind") == "log") & ~F.col("run").isin(f"{run}-put", f"{run}-drop"))
    if not others.isEmpty():
        raise snapshots.Conflict("a run was logged and not published; repeat it first")
    facts = read_changing(spark, log, FACTS, seen)
    now = Measures(last.table("sites"), last.table("worst")) if last else measure(facts, reserve)
    puts, drops = written(puts, "measure-puts"), written(drops.select(*KEY), "measure-drops")
    then, _ = follow(now, facts, puts, drops, reserve)
    append_change(puts, log, "put", FACTS, f"{run}-put")
    seq = append_change(drops, log, "drop", FACTS, f"{run}-drop")
    done = snapshots.publish(spark, measures, run, {"sites": then.sites, "worst": then.worst}, stamp=str(seq), base=last.version if last else 0)
    release(puts, drops)
    return done
