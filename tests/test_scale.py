"""Skewed groups, plans, incremental jobs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lucidex import schemas
from lucidex.operators import site_index, skew
from lucidex.plans import jobs
from lucidex.plans.inputs import Inputs
from lucidex.sources.tables import append_change, compact, read_changing, save_bucketed
from lucidex.streaming import triggers

SF = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """One site with a third of the rows and heavy ties."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"s{i % 40}", i, rng.randint(0, 9)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "site_id string, content_id bigint, v int").repartition(9)


def test_top_per_group_is_exact(hot):
    rows, frame = hot
    got = skew.top_per_group(frame, ["site_id"], [F.desc("v"), F.asc("content_id")], 17, ["content_id"]).collect()
    want = set()
    for site in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == site), key=lambda r: (-r[2], r[1]))[:17]
        want |= {(r[0], r[1], i + 1) for i, r in enumerate(ranked)}
    assert {(r["site_id"], r["content_id"], r["rank"]) for r in got} == want


def test_top_per_group_prunes_before_the_shuffle(hot):
    plan = plan_of(skew.top_per_group(hot[1], ["site_id"], [F.desc("v")], 17, ["content_id"]))
    assert "WindowGroupLimit" in plan


def test_latest_per_key_is_exact(hot):
    rows, frame = hot
    got = {(r["site_id"], r["v"]): r["content_id"] for r in skew.latest_per_key(frame, ["site_id", "v"], ["content_id"]).collect()}
    want: dict = {}
    for site, cid, v in rows:
        want[(site, v)] = max(cid, want.get((site, v), -1))
    assert got == want


def test_latest_per_key_combines_on_the_map_side(hot):
    plan = plan_of(skew.latest_per_key(hot[1], ["site_id"], ["content_id"]))
    assert "partial_max_by" in plan and "Window" not in plan


def test_attach_spreads_a_hot_key(spark, hot):
    rows, frame = hot
    names = frame.select("site_id").distinct().withColumn("name", F.upper("site_id"))
    joined = skew.attach(frame, names, ["site_id"], ["content_id"], "inner")
    assert joined.count() == len(rows) and joined.filter("name <> upper(site_id)").count() == 0
    spread = frame.filter("site_id = 'hot'").select(skew.salt_of(["content_id"]).alias("p")).groupBy("p").count()
    assert spread.count() == skew.SALTS
    assert skew.attach(frame, names.filter("site_id <> 'hot'"), ["site_id"], ["content_id"]).count() == len(rows)


def test_scan_reads_only_what_it_needs(spark):
    keys = plan_of(Inputs(spark, SF).samples.keys)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in keys
    filtered = plan_of(spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'error'").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in filtered
    assert "props" not in filtered


def greedy(seconds, wait):
    fires, due = [], None
    for s in sorted(set(seconds)):
        if due is None or s >= due:
            due = s + wait
            fires.append(due)
    return fires


@pytest.mark.parametrize("wait", [5, 9])
def test_rebuild_triggers_match_the_greedy_rule(spark, wait):
    rng = random.Random(wait)
    day = 86_400
    feed = {
        "dense over midnight": [day * 3 - 40 + i for i in range(0, 120)] * 3,
        "sparse": [rng.randint(0, day * 9) for _ in range(200)],
        "every fourth second over days": list(range(day - 50, day + 50, 4)) + list(range(3 * day - 10, 3 * day + 30, 3)),
        "one": [day],
        "edges": [day - 1, day, day + wait - 2, day + wait - 1, 2 * day - wait, 2 * day, 2 * day + 1],
    }
    rows = [(site, s) for site, seconds in feed.items() for s in seconds]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "site_id string, second bigint")
    got: dict = {}
    for row in triggers.rebuild_triggers(frame, wait).collect():
        got.setdefault(row["site_id"], []).append(row["fire_second"])
    assert {site: sorted(f) for site, f in got.items()} == {site: greedy(s, wait) for site, s in feed.items()}


def test_changing_table(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "site_id string, content_id bigint, v string"
    assert read_changing(spark, root, schema).count() == 0

    def state():
        return {(r["content_id"], r["v"]) for r in read_changing(spark, root, schema).collect()}

    def rows(*pairs):
        return spark.createDataFrame([("s", c, v) for c, v in pairs], schema)

    append_change(rows((1, "a"), (2, "b")), root, "put", schema)
    append_change(rows((2, "b2"), (3, "c")), root, "put", schema)
    append_change(rows((1, None), (9, None)).select("site_id", "content_id"), root, "drop", schema)
    assert state() == {(2, "b2"), (3, "c")}
    compact(spark, root, schema)
    assert state() == {(2, "b2"), (3, "c")}
    append_change(rows((1, "again")), root, "put", schema)
    append_change(rows((1, "again")), root, "put", schema)
    assert state() == {(1, "again"), (2, "b2"), (3, "c")}


def test_incremental_conversion_equals_a_full_rebuild(spark, tmp_path):
    content = Inputs(spark, SF).content
    edited = content.withColumn("title", F.when(F.col("content_id") % 5 == 0, F.lit("edited")).otherwise(F.col("title")))
    step, full = str(tmp_path / "step"), str(tmp_path / "full")
    jobs.refresh_conversions(spark, content, step, "2024-02-01 00:00:00")
    assert jobs.missing_conversions(content, read_changing(spark, step, schemas.STORE)).count() == 0
    missing = jobs.missing_conversions(edited, read_changing(spark, step, schemas.STORE))
    assert missing.count() == edited.filter("title = 'edited'").count()
    jobs.refresh_conversions(spark, edited, step, "2024-02-02 00:00:00")
    jobs.refresh_conversions(spark, edited, full, "2024-02-02 00:00:00")
    shown = ["site_id", "content_id", "content_hash", "markdown", "quality_score"]
    a = read_changing(spark, step, schemas.STORE).select(shown)
    b = read_changing(spark, full, schemas.STORE).select(shown)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == content.count()
    signals = read_changing(spark, step, schemas.STORE).select(F.size(F.json_object_keys("signals")).alias("n")).distinct().collect()
    assert [r["n"] for r in signals] == [18]
    fewer = edited.filter("content_id % 2 = 0")
    jobs.refresh_conversions(spark, fewer, step, "2024-02-03 00:00:00")
    assert read_changing(spark, step, schemas.STORE).count() == fewer.count()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    inputs = Inputs(spark, SF)
    for name, rows in (("bucket_content", inputs.content), ("bucket_store", inputs.store)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        save_bucketed(rows, name, 4, str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = jobs.missing_conversions(spark.table("bucket_content"), spark.table("bucket_store"))
        plan = plan_of(missing)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        direct = jobs.missing_conversions(inputs.content, inputs.store)
        assert missing.count() == direct.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_content", "bucket_store"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_publish_job(spark, tmp_path):
    inputs = Inputs(spark, SF)
    out = str(tmp_path / "index")
    jobs.publish_indexes(inputs.content, inputs.profile, inputs.sample("content_meta"), inputs.sample("robots"),
                         inputs.descriptions, inputs.editorial, inputs.store, out)
    assert spark.read.parquet(f"{out}/lines").count() == inputs.rows.count()
    bodies = site_index.index_body(spark.read.parquet(f"{out}/parts")).select("site_id", "body")
    assert bodies.exceptAll(inputs.bodies_of_sites.select("site_id", "body")).count() == 0
    jobs.audit_sites(inputs.signals, out, "2024-02-01")
    assert spark.read.parquet(f"{out}/sub_scores").count() == 7 * inputs.signals.count()
