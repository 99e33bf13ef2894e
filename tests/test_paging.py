"""Deep pages: equal to ranking all, and only the page's buckets are ranked."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lucidex.operators import descriptions as ds, paging

T0 = datetime(2024, 1, 1)


def rows_of(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        when = rng.choice([T0, T0, T0 + timedelta(minutes=rng.randint(0, 3000)), None, datetime(1965, 1, 1) + timedelta(hours=i)])
        rows.append((rng.choice(["hot", "hot", "s"]), rng.choice([i, i << 12, i << 33]), when, f"t{i}"))
    return spark.createDataFrame(rows, "site_id string, content_id bigint, published_at timestamp_ntz, title string")


def shown(frame):
    return sorted((r["site_id"], r["position"], r["content_id"], r["title"], r["total"], r["pages"], r["page"]) for r in frame.collect())


@pytest.mark.parametrize("rank_rows", [0, 4, 60, None])
def test_equal_to_ranking_all(spark, rank_rows):
    rows = rows_of(spark).cache()
    for page, size in ((1, 10), (2, 7), (9, 30), (30, 20), (31, 20), (500, 10), (0, 0)):
        assert shown(paging.deep_page_of(rows, page, size, rank_rows=rank_rows)) == shown(ds.page_of(rows, page, size)), (page, size)
    rows.unpersist()


def test_only_the_bucket_of_the_page_is_ranked(spark):
    """Page 10,000 of a bulk import with one time: a window ranks some thousand of a million rows."""
    rows = spark.range(1_000_000).select(F.lit("hot").alias("site_id"), F.col("id").alias("content_id"), F.lit(T0).cast("timestamp_ntz").alias("published_at"))
    frame = paging.deep_page_of(rows, 10_000, 50, rank_rows=5_000)
    got = frame.collect()
    assert [r["content_id"] for r in sorted(got, key=lambda r: r["position"])] == list(range(1_000_000 - 499_950 - 1, 1_000_000 - 500_001, -1))
    assert {(r["total"], r["pages"]) for r in got} == {(1_000_000, 20_000)}
    whole = frame._jdf.queryExecution().executedPlan().toString()
    assert "_level5" in whole  # down to ranges of 1,024 ids


def test_empty_table(spark):
    none = rows_of(spark).limit(0)
    assert paging.deep_page_of(none, 3, 10).collect() == []
