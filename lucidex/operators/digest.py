"""Comparing two tables by digests of key buckets, so that equal parts aren't read.

Rows are kept in folders by a bucket of their key.  A bucket's digest doesn't depend on the order of its rows:
their number, and two combinations of their hashes.  Buckets are grouped under tops; tops that differ are
found first, then the buckets in these, and only those buckets are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tops, and buckets under each.
TOPS, LOWS = 64, 64

PRINT = ["rows", "folded", "summed"]


def bucket_of(key: Sequence[str], tops: int = TOPS, lows: int = LOWS) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *key), F.lit(tops * lows)).cast("int")


def save(rows: DataFrame, path: str, key: Sequence[str], compared: Sequence[str], part: Column | None = None,
         tops: int = TOPS, lows: int = LOWS) -> None:
    """Writes the rows by bucket, and their digests beside them.

    *compared* are the columns that must agree, with the key, for two rows to be equal; *part* says which rows
    are compared at all (a row that isn't must not matter to a reader of the differences).
    """
    bucketed = rows.withColumn("bucket", bucket_of(key, tops, lows))
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.schema(bucketed.schema).parquet(f"{path}/rows")
    judged = kept if part is None else kept.filter(part)
    values = [*key, *compared]
    told = judged.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*values)).alias("folded"),
        F.sum(F.xxhash64(F.lit(1), *values).cast("decimal(20,0)")).cast("string").alias("summed"))
    told.withColumn("top", F.floor(F.col("bucket") / lows).cast("int")).coalesce(1).write.mode("overwrite").partitionBy("top").parquet(f"{path}/digests")


PRINTS = "bucket int, rows bigint, folded bigint, summed string, top int"


def _prints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRINTS).parquet(f"{path}/digests")


def _unequal(left: DataFrame, right: DataFrame, key: str) -> list[int]:
    """Keys whose digests differ, or that one side lacks; at most as many as there are buckets."""
    a, b = (side.select(key, F.struct(*PRINT).alias(name)) for side, name in ((left, "a"), (right, "b")))
    return sorted(r[0] for r in a.join(b, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(key).collect())


def differing_buckets(spark: SparkSession, left: str, right: str) -> list[int]:
    """Buckets in which the tables may differ: tops first, then the buckets of those that differ."""
    sides = [_prints(spark, path) for path in (left, right)]
    tops = _unequal(*[s.groupBy("top").agg(F.sum("rows").alias("rows"), F.bit_xor("folded").alias("folded"),
                                           F.sum(F.col("summed").cast("decimal(38,0)")).cast("string").alias("summed")) for s in sides], "top")
    if not tops:
        return []
    return _unequal(*[s.filter(F.col("top").isin(tops)) for s in sides], "bucket")


def read_buckets(spark: SparkSession, path: str, schema: str, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; folders of the others aren't listed in the scan."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/rows")
    return rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")
