"""Mixing sources to target weights by nested hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sums tell in which bucket a source's budget
ends, and only that bucket is split further by the next digits of the hash.  The outcome is one
number per source, against which each row's hash is compared: nothing is sorted, and a rerun or a
recomputed task takes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lucidex.llm.common import WORD, saved, whole_text

#: Bits of the hash that a level of the histogram looks at, and the number of levels.
LEVEL_BITS = 12
LEVELS = 5
HASH_BITS = LEVEL_BITS * LEVELS


def row_hash(*columns: str) -> Column:
    """The first 60 bits of an MD5 over the columns; a null is empty."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size) with its target.

    The sources in code-point order, null last, weigh *weights* in turn.  They share *share* times
    all sizes; a target stops at *most* times its source's size and the excess is shared again by
    weight.  That ends where every source has ``min(level * weight, most * size)`` for one level, and
    the level follows from running sums over the sources in the order in which they fill up.

    The window has no key: it holds one row per source, never rows of documents.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))).cast("int") + 1
    weighed = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    fills = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size, weight = F.col("source_size"), F.col("_weight")
    left = F.sum(size).over(whole) * F.lit(float(share)) - F.lit(float(most)) * F.coalesce(F.sum(size).over(before), F.lit(0))
    weight_left = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    level = F.col("_left") / F.col("_weight_left")
    cap = size * F.lit(float(most))
    # The level is set by the first source that does not fill up; taking later ones as the first gives less.
    return (
        weighed.withColumn("_left", left).withColumn("_weight_left", weight_left)
        .withColumn("_level", F.max(F.when(level * weight <= cap, level)).over(whole))
        .select("source", "source_size", F.least(cap, F.coalesce(F.col("_level") * weight, cap)).alias("target"))
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash below which a row gets one copy more (source, whole, below).

    rows: source, size, hash.  budgets: source, source_size, target.  ``whole`` copies go to every
    row; the rest of the budget is met by the rows with the lowest hashes.
    """
    plan = budgets.select(
        "source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        .cast("long").alias("whole"), "target", "source_size",
    ).select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
             F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        unit = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        inside = rows if level == 0 else rows.join(
            plan.select(F.col("source").alias("_source"), F.col("below").alias("_below")),
            rows["source"].eqNullSafe(F.col("_source"))
            & (rows["hash"] >= F.col("_below")) & (rows["hash"] < F.col("_below") + unit * (1 << LEVEL_BITS)))
        bars = (inside.groupBy(F.col("source").alias("_source"), F.expr(f"hash div {unit}").alias("_bar"))
                .agg(F.sum("size").alias("_size")))
        # At most 4,096 bars a source.
        upto = Window.partitionBy("_source").orderBy("_bar").rowsBetween(Window.unboundedPreceding, 0)
        sums = bars.withColumn("_upto", F.sum("_size").over(upto))
        last = level == LEVELS - 1
        # The boundary bar: the first whose running sum passes the budget.  At the last level it is
        # taken whole where that is nearer to the budget than leaving it.
        found = plan.join(sums, plan["source"].eqNullSafe(sums["_source"]), "left").groupBy(*plan.columns).agg(
            F.min(F.when(F.col("_upto") > F.col("rest"), F.struct("_bar", "_size", "_upto"))).alias("_edge"),
            F.max("_upto").alias("_all"))
        edge_start = F.col("_edge._upto") - F.col("_edge._size")
        over = F.col("_edge._upto") - F.col("rest")
        short = F.col("rest") - edge_start
        step = F.when(F.col("_edge").isNull(), F.col("below") + (0 if level else 1 << HASH_BITS))
        if last:
            below = step.otherwise(F.col("_edge._bar") + F.when(over < short, 1).otherwise(0))
        else:
            below = step.otherwise(F.col("_edge._bar") * unit)
        plan = found.select("source", "whole", F.when(F.col("_edge").isNull(), F.lit(0.0)).otherwise(short).alias("rest"),
                            below.cast("long").alias("below"))
        plan = saved(plan, "mix-level")
    return plan.select("source", "whole", "below")


def mix(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (key columns, source, size, hash) with source_size, target and copies.

    copies is how often the mix takes the row: the whole part of target / size of its source, and one
    more below the source's hash threshold.  A row is taken ``most`` times at most.  An empty table
    gives an empty result; a source of size 0 has target 0 and its rows, all empty, are taken once.
    """
    sources = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    budgets = saved(targets(sources, weights, share, most), "mix-targets")
    plan = thresholds(rows, budgets)
    per_source = budgets.join(plan, budgets["source"].eqNullSafe(plan["source"])).select(
        budgets["source"].alias("_source"), "source_size", "target", "whole", "below")
    copies = F.least(F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0), F.lit(int(most)))
    return (rows.join(per_source, rows["source"].eqNullSafe(F.col("_source")))
            .withColumn("copies", F.when(F.col("source_size") == 0, 1).otherwise(copies).cast("long"))
            .drop("_source", "whole", "below"))


def row_name(text: Column) -> Column:
    """What a row is told apart by: its doc_id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document, as a narrow work table.

    The hash is one of doc_id, text and, where rows agree in both, their number among these, so rows with
    a null or repeated doc_id are taken one by one like any others.  Equal rows are counted in the part
    of the table that holds them, and one row per part says how many are in the parts before: no group
    of equal rows meets in one task.  Which of them gets which number doesn't show in the result.
    """
    text = whole_text()
    rows = saved(docs.select("doc_id", "source", word_count(text).alias("size"), row_name(text).alias("_name")), "mix-rows").withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy("_name", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_name", "_part").orderBy("source", "size")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1).join(ahead, ["_name", "_part"])
    numbered = numbered.withColumn("_at", F.col("_at") + F.col("_ahead"))
    return saved(numbered.select("doc_id", "source", "size", row_hash("_name", "_at").alias("hash")), "mix-sizes")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
