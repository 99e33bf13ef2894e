"""Measures that follow a log of changes against measures of all facts; runs that fail in between."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lucidex.operators import audit, measures as ms
from lucidex.sources import snapshots
from lucidex.sources.tables import append_change
from lucidex.sources.work import written


def fact(site, number, score, rng):
    return (site, number, score, rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.7, rng.random() < 0.5)


def table(frame):
    return {r["site_id"]: tuple(r)[1:] for r in frame.collect()}


def worst(frame):
    return sorted(tuple(r[c] for c in ("site_id", "rank", "content_id", "quality_score")) for r in frame.collect())


@pytest.mark.parametrize("seed, reserve", [(1, 5), (2, 7), (3, 50)])
def test_a_log_equals_all_facts(spark, seed, reserve):
    """Batches of puts and drops with hot sites, ties, sites that end and begin, and reserves that run out."""
    rng = random.Random(seed)
    facts = {i: fact(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice([None, *range(8)]), rng) for i in range(1, 121)}
    rows = lambda values: spark.createDataFrame(list(values), ms.FACTS)
    held = written(rows(facts.values()), "test-facts")
    now = ms.measure(held, reserve)
    now = ms.Measures(written(now.sites, "test-sites"), written(now.worst, "test-worst"))
    next_id, refilled = 1000, 0
    for step in range(5):
        scored = sorted((f for f in facts.values() if f[0] == "hot" and f[2] is not None), key=lambda f: (f[2], f[1]))
        gone = {f[1] for f in scored[:4 + step]} | set(rng.sample(sorted(facts), 6))  # the worst go, so reserves run out
        if step == 1:
            gone |= {i for i, f in facts.items() if f[0] == "b"}
        puts = [fact(facts[i][0], i, rng.choice([None, *range(8)]), rng) for i in rng.sample(sorted(set(facts) - gone), 10)]
        for _ in range(5):
            puts.append(fact(rng.choice(["hot", "new", "b"]), next_id, rng.choice([None, 0, 3, 9]), rng))
            next_id += 1
        drops = spark.createDataFrame([(facts[i][0], i) for i in gone] + [("hot", 10**9)], "site_id string, content_id bigint")
        now, held = ms.follow(now, held, rows(puts), drops, reserve)
        now, held = ms.Measures(written(now.sites, "test-sites"), written(now.worst, "test-worst")), written(held, "test-facts")
        facts = {i: f for i, f in facts.items() if i not in gone} | {f[1]: f for f in puts}
        whole = ms.measure(rows(facts.values()), reserve)
        assert table(now.report()) == table(whole.report())
        assert worst(now.shown()) == worst(whole.shown())
        assert sorted(map(tuple, held.collect()), key=str) == sorted(facts.values(), key=str)
        limits = {r["site_id"]: r["bound"] for r in now.sites.collect()}
        for site, bound in limits.items():  # the reserve is what it says
            own = sorted((f[2], f[1]) for f in facts.values() if f[0] == site and f[2] is not None)
            if bound is not None:
                own = [p for p in own if p <= tuple(bound)]
                refilled += 1
            assert sorted((r["quality_score"], r["content_id"]) for r in now.worst.filter(F.col("site_id") == site).collect()) == own
    assert refilled or reserve == 50


def test_report_agrees_with_the_audit(spark):
    store = spark.createDataFrame([("s", i, "word " * i, (i * 7) % 101 if i % 5 else None) for i in range(40)] + [("t", 99, "x", None)],
                                  "site_id string, content_id bigint, markdown string, quality_score int")
    facts = ms.facts_of(store, F.col("markdown") != "", F.length("markdown") > 50)
    report = {r["site_id"]: r for r in ms.measure(facts).report().collect()}
    for r in audit.markdown_stats(store).collect():
        assert all(report[r["site_id"]][c] == pytest.approx(r[c]) for c in ("rows_total", "rows_with_score", "mean_quality", "rows_above_threshold"))
    for r in audit.body_quality_rates(store).collect():
        assert all(report[r["site_id"]][c] == pytest.approx(r[c]) for c in ("empty_ratio", "noisy_ratio"))
    assert (report["s"]["total_entries"], report["s"]["entries_with_description"]) == (39, 29)


def test_only_a_short_reserve_reads_facts_of_a_site(spark):
    """Taking rows out of the middle of a site reads no more of it than the batch."""
    facts = written(spark.range(5000).select(
        F.lit("hot").alias("site_id"), F.col("id").alias("content_id"), (F.col("id") % 90).cast("int").alias("quality_score"), F.lit(False).alias("is_empty"),
        F.lit(False).alias("is_noisy"), F.lit(True).alias("is_listed"), F.lit(True).alias("is_described")), "test-facts")
    now = ms.measure(facts, 50)
    assert now.worst.count() == 50 and now.sites.first()["bound"]["quality_score"] == 0
    then, _ = ms.follow(now, facts, facts.limit(0), facts.filter("content_id % 90 = 45").select("site_id", "content_id"), 50)
    assert then.worst.count() == 50 and then.sites.first()["rows_total"] == 5000 - facts.filter("content_id % 90 = 45").count()
    few, _ = ms.follow(now, facts, facts.limit(0), now.worst.limit(47).select("site_id", "content_id"), 50)
    assert few.worst.count() == 50 and few.shown().count() == 5


def test_runs_of_the_job(spark, tmp_path, monkeypatch):
    root, rng = str(tmp_path / "state"), random.Random(1)
    rows = lambda *values: spark.createDataFrame(list(values), ms.FACTS)
    none = rows().select("site_id", "content_id")
    one = ms.refresh(spark, root, rows(*[fact("a", i, i, rng) for i in range(1, 20)]), none, "monday")
    assert one.version == 1 and one.table("sites").first()["rows_total"] == 19
    assert ms.refresh(spark, root, rows(), none, "monday") == one
    gone = spark.createDataFrame([("a", 1), ("a", 2)], "site_id string, content_id bigint")
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ms.refresh(spark, root, rows(fact("a", 50, 0, rng)), gone, "tuesday")
    assert snapshots.latest(spark, f"{root}/measures") == one  # readers have the old version
    with pytest.raises(snapshots.Conflict):
        ms.refresh(spark, root, rows(), none, "wednesday")
    two = ms.refresh(spark, root, rows(fact("a", 50, 0, rng)), gone, "tuesday")  # repeated: applied once
    assert two.version == 2 and two.table("sites").first()["rows_total"] == 18
    three = ms.refresh(spark, root, rows(), spark.createDataFrame([("a", 50)], "site_id string, content_id bigint"), "wednesday")
    assert three.table("sites").first()["rows_total"] == 17
    assert [r["content_id"] for r in ms.Measures(three.table("sites"), three.table("worst")).shown().orderBy("rank").collect()] == [3, 4, 5, 6, 7]
