"""Fetching the pages that miss: exact, and no other page moves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidex.operators import fetch
from lucidex.plans import jobs
from lucidex.plans.inputs import Inputs
from lucidex.sources.work import written

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_auto_broadcast(spark):
    """As if every table were above the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(frame) -> str:
    """The plan as it ran, without the one it started from."""
    frame.collect()
    whole = frame._jdf.queryExecution().executedPlan().toString()
    return whole[:whole.rindex("== Initial Plan ==")]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """20,000 pages, written."""
    path = str(tmp_path_factory.mktemp("wide") / "rows")
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("site_id"),
        F.col("id").alias("content_id"), F.repeat(F.sha1(F.col("id").cast("string")), 20).alias("body_html"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("broadcast_keys", [None, 0])
@pytest.mark.parametrize("keep", ["content_id % 4000 = 7", "content_id % 3 = 0", "false", "true"])
def test_fetch_is_exact(spark, wide, broadcast_keys, keep):
    asked = wide.filter(keep).select("site_id", "content_id", F.lit("h").alias("content_hash"))
    strange = spark.createDataFrame([("hot", 10**9, "h"), (None, 3, "h"), ("s1", None, "h")], "site_id string, content_id long, content_hash string")
    keys = written(asked.unionByName(strange), "test-keys")
    got = fetch.fetch_rows(wide, keys, ["site_id", "content_id"], broadcast_keys)
    assert got.columns == ["site_id", "content_id", "body_html", "content_hash"]
    wanted = wide.filter(keep).withColumn("content_hash", F.lit("h"))
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_few_keys_move_no_page(spark, wide, no_auto_broadcast):
    keys = written(wide.filter("content_id % 4000 = 7").select("site_id", "content_id"), "test-keys")
    plan = final_plan(fetch.fetch_rows(wide, keys, ["site_id", "content_id"]))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_the_filter_lets_few_others_pass(spark, wide):
    keys = wide.filter("content_id % 100 = 7").select("site_id", "content_id")
    bits = fetch.bloom_size(200)
    told = fetch.bloom_filter(keys, ["site_id", "content_id"], bits)
    assert len(told.first()["words"]) * 64 == bits >= 200 * fetch.BITS_PER_KEY
    passing = wide.filter(fetch.may_contain(told.scalar(), ["site_id", "content_id"], bits))
    assert passing.join(keys, ["site_id", "content_id"], "left_semi").count() == 200
    assert passing.count() < 200 + 20_000 * 0.02


def test_many_keys_filter_above_the_scan(spark, wide, no_auto_broadcast):
    keys = written(wide.filter("content_id % 100 = 7").select("site_id", "content_id"), "test-keys")
    frame = fetch.fetch_rows(wide, keys, ["site_id", "content_id"], broadcast_keys=0)
    plan = final_plan(frame)
    assert "SortMergeJoin" in plan
    exchange, test = plan.index("Exchange hashpartitioning(site_id"), plan.index("Filter (((((")
    scan = plan.index("body_html", plan.index("FileScan parquet [site_id", plan.index("Initial", test) if "Initial" in plan else test))
    assert exchange < test < scan and "getbit(Subquery" in plan[test:]  # the filter is between the scan and the exchange


def test_the_job_moves_no_other_page(spark, no_auto_broadcast):
    inputs = Inputs(spark, SF)
    pages, keys = jobs.fetch_missing(inputs.content, inputs.store)
    assert 0 < keys.count() < inputs.content.count()
    plan = final_plan(pages)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    direct = jobs.missing_conversions(inputs.content, inputs.store).select("site_id", "content_id")
    assert pages.select("site_id", "content_id").exceptAll(direct).count() == 0 and pages.count() == direct.count()
