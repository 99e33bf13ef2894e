"""The conversion store: what to convert, upsert, invalidate, empty twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.functions import text as tx
from lucidex.operators.conversion import CONVERTER_VERSION
from lucidex.operators.skew import latest_per_key

KEY = ["site_id", "content_id"]


def content_hash(*extra: Column) -> Column:
    """SHA-1 over everything that decides a conversion."""
    modified = F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("body_html", "excerpt")] + [modified]
    parts += [F.coalesce(F.col("title"), F.lit("")), *[F.coalesce(e, F.lit("")) for e in extra]]
    return F.sha1(F.concat(*parts))


def plan_conversion(content_keys: DataFrame, store: DataFrame,
                    version: str = CONVERTER_VERSION) -> DataFrame:
    """Mark each document as a hit or a miss.

    Both inputs are narrow (key, hash), so no page text takes part in the join.
    Store both tables bucketed by the key and it needs no shuffle either.
    """
    known = store.filter(F.col("converter_version") == version).select(
        *KEY, F.col("content_hash").alias("_known"))
    is_hit = F.col("content_hash").eqNullSafe(F.col("_known"))
    return content_keys.join(known, KEY, "left").select(
        *KEY, "content_hash", F.when(is_hit, F.lit("hit")).otherwise(F.lit("miss")).alias("action"))


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after the changes: the newest row per document, a change winning a tie.

    Only keys and times of the store are compared; its texts are kept or dropped where they are.
    """
    newest = latest_per_key(changes, KEY, ["generated_at", "content_hash"])
    times = store.groupBy(*KEY).agg(F.max("generated_at").alias("_stored_at"))
    wins = F.col("_stored_at").isNull() | (F.col("generated_at") >= F.col("_stored_at"))
    winning = newest.join(times, KEY, "left").filter(wins).drop("_stored_at")
    return store.join(winning.select(*KEY), KEY, "left_anti").unionByName(winning.select(*store.columns))


def invalidate(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store without the documents that changed."""
    return store.join(changes.filter(F.col("content_id") > 0).select(*KEY).distinct(), KEY, "left_anti")


def is_empty_markdown(markdown: Column) -> Column:
    return tx.trim(markdown) == ""


def known_empty(content_keys: DataFrame, store: DataFrame) -> DataFrame:
    """Whether the stored twin is known to be empty; no stored row means no."""
    texts = store.select(*KEY, is_empty_markdown(F.coalesce("markdown", F.lit(""))).alias("_empty"))
    joined = content_keys.join(texts, KEY, "left")
    flag = (F.col("content_id") > 0) & F.coalesce("_empty", F.lit(False))
    return joined.withColumn("known_empty", flag).drop("_empty")


def retired_meta_counts(meta: DataFrame, retired_keys: list[str]) -> DataFrame:
    """Rows per retired key, zero included."""
    found = (meta.filter(F.col("key").isin(*retired_keys)).groupBy("key").agg(F.count(F.lit(1)).alias("_n")))
    wanted = meta.sparkSession.createDataFrame([(key,) for key in retired_keys], "key string")
    return wanted.join(found, "key", "left").select("key", F.coalesce("_n", F.lit(0)).alias("rows"))


def without_retired_meta(meta: DataFrame, retired_keys: list[str]) -> DataFrame:
    """The other rows; a row without key is none of the retired ones."""
    return meta.filter(~F.coalesce(F.col("key").isin(*retired_keys), F.lit(False)))
