"""Comparing by digests: equal to the whole comparison, and only buckets that differ are read."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lucidex.operators import digest, publish

T0 = datetime(2024, 1, 1)
KEY = ["site_id", "content_id"]


def states(spark, rows):
    """(site, id, path or None, twin, present path or None, days late)."""
    wanted = [(s, i, path, T0, twin) for s, i, path, twin, _, _ in rows if path]
    present = [(s, i, there, T0 + timedelta(days=late)) for s, i, _, _, there, late in rows if there]
    return spark.createDataFrame(wanted, publish.WANTED), spark.createDataFrame(present, publish.PRESENT)


def actions(frame):
    return sorted(tuple(r[c] for c in ("site_id", "content_id", "path", "present_path", "action")) for r in frame.collect())


def test_equal_to_the_whole_comparison(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        path = rng.choice(["a.md", "b.md", f"{i}.md", None])
        rows.append((rng.choice(["hot", "hot", "s"]), i, path, rng.random() < 0.7, rng.choice([path, path, "old.md", None]), rng.choice([-1, 0, 0, 2])))
    wanted, present = states(spark, rows)
    paths = str(tmp_path / "wanted"), str(tmp_path / "present")
    publish.save_mirror_states(wanted, present, *paths, tops=4, lows=8)
    whole = publish.mirror_delta(wanted, present).filter("action NOT IN ('keep', 'none')")
    assert actions(publish.mirror_digest_delta(spark, *paths)) == actions(whole) != []


def test_only_differing_buckets_are_read(spark, tmp_path):
    rows = [("s", i, f"{i}.md", True, f"{i}.md", 0) for i in range(3000)]
    paths = str(tmp_path / "wanted"), str(tmp_path / "present")
    wanted, present = states(spark, rows)
    publish.save_mirror_states(wanted, present, *paths, tops=8, lows=16)
    assert digest.differing_buckets(spark, *paths) == [] and publish.mirror_digest_delta(spark, *paths).count() == 0
    rows[17] = ("s", 17, "17.md", True, None, 0)
    rows[1234] = ("s", 1234, "new.md", True, "1234.md", 0)
    rows[2999] = ("s", 2999, "2999.md", False, "2999.md", -1)
    wanted, present = states(spark, rows)
    publish.save_mirror_states(wanted, present, *paths, tops=8, lows=16)
    buckets = digest.differing_buckets(spark, *paths)
    assert 1 <= len(buckets) <= 3
    delta = publish.mirror_digest_delta(spark, *paths)
    assert [(r[1], r[4]) for r in actions(delta)] == [(17, "write"), (1234, "move"), (2999, "delete")]
    plan = delta._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in line or f"PartitionFilters: [bucket" in line for line in scans)
    read = digest.read_buckets(spark, paths[0], publish.WANTED, buckets)
    assert len(read.inputFiles()) >= 1 and read.count() < 3000 * 3 / 64


def test_digests_do_not_depend_on_order_and_see_repeats(spark, tmp_path):
    base = [("s", i % 50, f"{i}") for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "site_id string, content_id bigint, v string")
    for name, rows in (("a", base), ("b", base[::-1]), ("c", base + base[:2]), ("d", base[:-1] + [("s", 49, None)])):
        digest.save(frame(rows).repartition(3), str(tmp_path / name), KEY, ["v"], tops=2, lows=4)
    at = lambda name: str(tmp_path / name)
    assert digest.differing_buckets(spark, at("a"), at("b")) == []
    assert 1 <= len(digest.differing_buckets(spark, at("a"), at("c"))) <= 2  # a row twice doesn't cancel out
    assert len(digest.differing_buckets(spark, at("a"), at("d"))) == 1


@pytest.mark.parametrize("side", ["wanted", "present", "both"])
def test_empty_tables(spark, tmp_path, side):
    rows = [("s", i, f"{i}.md", True, f"{i}.md", 0) for i in range(20)]
    wanted, present = states(spark, rows)
    paths = str(tmp_path / "wanted"), str(tmp_path / "present")
    publish.save_mirror_states(wanted.limit(0) if side != "present" else wanted, present.limit(0) if side != "wanted" else present, *paths, tops=2, lows=2)
    got = [r[4] for r in actions(publish.mirror_digest_delta(spark, *paths))]
    assert got == {"wanted": ["delete"] * 20, "present": ["write"] * 20, "both": []}[side]
