"""Grouping and joining that survive a group holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The fewest pieces a group is split into before its rows meet.
SALTS = 16

_SALT = "_salt"


def salts_of(rows: DataFrame) -> int:
    """How many pieces a group is split into: as the shuffle partitions grow, so do the pieces."""
    return max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def salt_of(columns: Sequence[str], salts: int = SALTS) -> Column:
    """A deterministic piece number, so that a recomputed task gives the same split."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int,
                  spread_on: Sequence[str], rank: str = "rank", salts: int | None = None) -> DataFrame:
    """The first *limit* rows of each group with their rank, exactly.

    Ranks are taken within pieces of a group first, where Spark also prunes on the
    map side.  What is left for the whole group is at most ``limit * salts`` rows.
    """
    pieces = Window.partitionBy(*group, _SALT).orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        rows.withColumn(_SALT, salt_of(spread_on, salts or salts_of(rows)))
        .withColumn(rank, F.row_number().over(pieces))
        .filter(F.col(rank) <= limit)
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= limit)
        .drop(_SALT)
    )


def rank_all(rows: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column],
             rank: str = "rank") -> DataFrame:
    """Every row with its rank in its group, without a group in one task.

    *bucket* is a coarse part of the order, greatest first, such as the hour of a time.  Rows are ranked inside
    their bucket; how many rows lie in the buckets before it is summed over one row per bucket.
    """
    own = [F.col(c) for c in group]
    placed = rows.withColumn("_bucket", F.coalesce(bucket.cast("bigint"), F.lit(-(1 << 62))))
    sizes = placed.groupBy(*own, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*own).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*own, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*own, "_bucket").orderBy(*order)
    return (placed.withColumn(rank, F.row_number().over(inside)).join(offsets, [*group, "_bucket"])
            .withColumn(rank, (F.col(rank) + F.col("_ahead")).cast("int")).drop("_bucket", "_ahead"))


def latest_per_key(rows: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the greatest *newest* columns per key.

    An aggregate and not a window: copies of a key collapse on the map side, so a
    key with very many copies never meets in one task.
    """
    names = rows.columns
    packed = F.struct(*names)
    order = F.struct(*newest)
    return (
        rows.groupBy(*key)
        .agg(F.max_by(packed, order).alias("_row"))
        .select("_row.*")
        .select(*names)
    )


def attach(facts: DataFrame, lookup: DataFrame, on: Sequence[str], spread_on: Sequence[str],
           how: str = "left", salts: int | None = None) -> DataFrame:
    """Join many rows to a table with one row per key.

    The rows of a hot key are split over *salts* tasks and the single row of the
    lookup is copied to each.  No broadcast is forced: Spark broadcasts the lookup
    itself where its measured size allows.
    """
    salts = salts or salts_of(facts)
    spread = facts.withColumn(_SALT, salt_of(spread_on, salts))
    copies = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, _SALT], how).drop(_SALT)
