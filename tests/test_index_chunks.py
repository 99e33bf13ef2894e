"""Index parts under edits: equal to a full rebuild, and few of them change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lucidex.operators import index_chunks as ic
from lucidex.sources.work import written

SCHEMA = ("site_id string, label string, entry_kind int, group_pos bigint, at bigint, at_id bigint, entry_key string, line string")


def line(site, number, at, text="", label="post", kind=1):
    return (site, label, kind, 0, at, -number, str(number), f"- {number}{text}")


def plain_parts(rows, average):
    """{(group, start): body} of lines as tuples."""
    import hashlib

    out, start, last = {}, None, None
    for r in sorted(rows, key=lambda r: (r[:4], r[4:7])):
        if r[:4] != last:
            start, last = (ic.FIRST, ic.FIRST), r[:4]
        if int(hashlib.md5(f"{r[0]}/{r[2]}/{r[6]}".encode()).hexdigest()[:8], 16) % average == 0:
            start = r[4:6]
        out[r[:4] + start] = out.get(r[:4] + start, "") + r[7] + "\n"
    return out


def found(parts):
    rows = parts.collect()
    out = {tuple(r[c] for c in ic.GROUP + ic.START): r["body"] for r in rows}
    assert len(out) == len(rows)
    return out


def state_of(spark, rows, average):
    placed = written(ic.with_parts(spark.createDataFrame(rows, SCHEMA).repartition(5), average), "test-placed")
    return placed, written(ic.parts_of(placed), "test-parts")


def apply(spark, rows, puts, drops):
    gone = {(r[0], r[2], r[6]) for r in puts} | {(r[0], r[2], r[6]) for r in drops}
    return [r for r in rows if (r[0], r[2], r[6]) not in gone] + puts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_equal_a_full_rebuild(spark, seed):
    """Batches on the state that earlier batches left: inserts, edits, moves, drops, a section that ends and one that begins."""
    rng = random.Random(seed)
    average = rng.choice([2, 4, 9])
    rows = [line(rng.choice(["hot", "hot", "s1", "s2"]), i, rng.choice([5, rng.randint(-50, 50)])) for i in range(150)]
    rows += [line("hot", 1000 + i, i, label="Picks", kind=0) for i in range(5)]
    placed, parts = state_of(spark, rows, average)
    assert found(parts) == plain_parts(rows, average)
    next_id = 5000
    for step in range(3):
        drops = rng.sample(rows, 25) if step else [r for r in rows if r[0] == "s1"]
        rest = [r for r in rows if r not in drops]
        puts = [r[:7] + (r[7] + " edited",) for r in rng.sample(rest, 8)]
        puts += [r[:4] + (r[4] + rng.randint(-9, 9),) + r[5:] for r in rng.sample([r for r in rest if r[2] and r[6] not in {p[6] for p in puts}], 8)]  # moved
        for _ in range(8):
            puts.append(line(rng.choice(["hot", "s2", "new"]), next_id, rng.choice([5, -10**6, rng.randint(-50, 50)])))
            next_id += 1
        change = ic.change_parts(placed, parts, spark.createDataFrame(puts, SCHEMA), spark.createDataFrame(drops, SCHEMA), average)
        before, rows = plain_parts(rows, average), apply(spark, rows, puts, drops)
        after = plain_parts(rows, average)
        listed = {tuple(r[c] for c in ic.GROUP + ic.START): (r["change"], r["body"]) for r in change.parts.collect()}
        wanted = {k: ("put", after[k]) if k in after else ("drop", None) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
        assert listed == wanted
        parts, placed = written(change.parts_after(parts), "test-parts"), written(change.lines_after(placed), "test-placed")
        assert found(parts) == after
        again = ic.with_parts(spark.createDataFrame(rows, SCHEMA), average).select(*placed.columns)
        assert placed.exceptAll(again).count() == again.exceptAll(placed).count() == 0


def test_a_hundred_thousand_entries(spark):
    """One site, a third of its entries with one time: parts are small, and an insert changes at most three."""
    entries = spark.range(100_000).select(
        F.lit("hot").alias("site_id"), F.lit("post").alias("label"), F.lit(1).alias("entry_kind"), F.lit(0).cast("bigint").alias("group_pos"),
        F.when(F.col("id") % 3 == 0, 7_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).cast("bigint").alias("at"),
        (-F.col("id")).alias("at_id"), F.col("id").cast("string").alias("entry_key"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("line"))
    placed = written(ic.with_parts(entries, 500), "test-placed")
    parts = written(ic.parts_of(placed), "test-parts")
    told = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.max("lines").alias("most")).first()
    assert told["lines"] == 100_000 and 150 < told["n"] < 260 and told["most"] < 5_000
    for number, at in ((200_001, -5), (200_002, 7_000), (200_003, 500_000), (200_004, 2_000_000)):
        change = ic.change_parts(placed, parts, spark.createDataFrame([line("hot", number, at)], SCHEMA), spark.createDataFrame([], SCHEMA), 500)
        assert 1 <= change.parts.count() <= 3
    many = [line("hot", 300_000 + i, (i * 7919) % 1_000_000) for i in range(40)]
    change = ic.change_parts(placed, parts, spark.createDataFrame(many, SCHEMA), spark.createDataFrame([], SCHEMA), 500)
    listed = change.parts.select(*ic.GROUP, *ic.START, "change", "body")
    assert listed.count() <= 3 * len(many)
    rebuilt = ic.parts_of(ic.with_parts(entries.unionByName(spark.createDataFrame(many, SCHEMA)), 500))
    now, was = rebuilt.select(*ic.GROUP, *ic.START, "body"), parts.select(*ic.GROUP, *ic.START, "body")
    assert listed.filter("change = 'put'").drop("change").exceptAll(now.exceptAll(was)).count() == 0
    assert now.exceptAll(was).count() == listed.filter("change = 'put'").count()
    assert change.parts_after(parts).select(*ic.GROUP, *ic.START, "body").exceptAll(now).count() == 0


def test_ranges_share_a_hot_time(spark):
    """Lines of one site and one time are dealt over tasks."""
    entries = spark.range(50_000).select(
        F.lit("hot").alias("site_id"), F.lit("post").alias("label"), F.lit(1).alias("entry_kind"), F.lit(0).cast("bigint").alias("group_pos"),
        F.lit(7).cast("bigint").alias("at"), (-F.col("id")).alias("at_id"), F.col("id").cast("string").alias("entry_key"), F.lit("- x").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ic.with_parts(entries, 100)
        sizes = [r["count"] for r in placed.groupBy("start", "start_id").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 50_000 and max(sizes) < 2_000 and len(sizes) > 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    placed, parts = written(ic.with_parts(none), "test-placed"), written(ic.parts_of(ic.with_parts(none)), "test-parts")
    assert parts.count() == 0
    change = ic.change_parts(placed, parts, spark.createDataFrame([line("a", 1, 5)], SCHEMA), none, 10)
    assert [(r["change"], r["body"], r["start"]) for r in change.parts.collect()] in ([("put", "- 1\n", ic.FIRST)], [("put", "- 1\n", 5)])
    assert ic.change_parts(placed, parts, none, none).parts.count() == 0
