"""Search by postings: equal to reading all bodies, and reads only what can hold the term."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lucidex.operators import descriptions as ds, text_index as ti

T0 = datetime(2024, 1, 1)
SCHEMA = ("site_id string, content_id bigint, status string, post_type string, permalink string, published_at timestamp_ntz, "
          "title string, excerpt string, body_html string")


def content_of(spark, bodies, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "s"]), i, rng.choice(["publish", "publish", "draft"]), "post", f"u{i}", T0 + timedelta(minutes=i % 7),
             rng.choice([None, "", "The Title", body[:5] if body else "x"]), rng.choice([None, "An Excerpt 🙂"]), body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def found(frame):
    return sorted((r["site_id"], r["position"], r["content_id"], r["total"]) for r in frame.collect())


@pytest.mark.parametrize("block", [3, 7, 1024])
def test_terms_of_any_length(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ti, "BLOCK_CHARS", block)
    monkeypatch.setattr(ti, "FOLDERS", 4)
    rng = random.Random(block)
    letters = "aab c\nÉ🙂%_\\'"
    bodies = [None, "", "a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["A" * 50, "İstanbul ẞ"]
    content = content_of(spark, bodies).cache()
    path = str(tmp_path / "index")
    ti.build(content, path)
    terms = ["", "a", "É", "🙂", "aa", "title", "An Excerpt 🙂", "a" * 30, "zz", "\\'", "%_"]
    for size in (1, 2, 3, 4, 5, 8, 13, 30):
        body = rng.choice([b for b in bodies if b and len(b) > 40])
        at = rng.randrange(len(body) - size)
        terms.append(body[at:at + size])
    for term in terms:
        assert found(ti.search(spark, path, term, 1, 20)) == found(ds.search(content, term, 1, 20)), term
    content.unpersist()


def test_intersection_is_narrow(spark, tmp_path):
    """Documents that hold all grams of a term far from one another aren't read."""
    far = "abc" + "x" * 5000 + "bcd" + "x" * 5000 + "cde"
    bodies = [far] * 20 + ["...abcde..."] + ["y" * 1022 + "abcde" + "y" * 10]
    content = content_of(spark, bodies).withColumn("status", F.lit("publish"))
    path = str(tmp_path / "index")
    ti.build(content, path)
    assert sorted(r["content_id"] for r in ti.candidates(spark, path, "abcde").collect()) == [20, 21]
    assert sorted(r["content_id"] for r in ti.hits(spark, path, "ABCDE").collect()) == [20, 21]


def test_scans_are_pruned(spark, tmp_path):
    bodies = [f"page {i} " + "filler words " * 50 for i in range(300)] + ["needle"]
    path = str(tmp_path / "index")
    ti.build(content_of(spark, bodies).withColumn("status", F.lit("publish")), path)
    frame = ti.hits(spark, path, "needle")
    assert [r["content_id"] for r in frame.collect()] == [300]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    texts = next(line for line in plan.splitlines() if "FileScan" in line and "body_html" in line)
    assert "PartitionFilters: [isnotnull(folder" in texts or "PartitionFilters: [folder" in texts
    assert "content_id" in texts.split("PushedFilters")[1]
    asked = ti.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in asked and "In(gram" in asked and "PartitionFilters: [" in asked and "body_html" not in asked


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    ti.build(spark.createDataFrame([], SCHEMA), path)
    assert ti.hits(spark, path, "").count() == 0 and ti.hits(spark, path, "word").count() == 0
    ti.build(content_of(spark, ["only"]), path)
    assert ti.hits(spark, path, "absent").count() == 0


def test_postings_have_a_row_for_each_gram_of_a_unit(spark, tmp_path):
    """Many blocks of the same words take a row for each gram and not for each gram and block."""
    path = str(tmp_path / "index")
    ti.build(content_of(spark, ["the same words " * 500] * 40).coalesce(1).withColumn("status", F.lit("publish")), path)
    rows = spark.read.parquet(f"{path}/postings").filter("gram IS NOT NULL")
    blocks = rows.select(F.sum(F.size("places"))).first()[0]
    assert blocks > 40 * 8 * 30 and rows.count() < blocks / 20
    assert ti.hits(spark, path, "same").count() == 40


@pytest.mark.parametrize("most, total", [(1 << 20, 1 << 10), (1 << 40, 1 << 40)])
def test_pairs_are_distinct_and_in_order(most, total):
    codes, places = [3, 1, 3, (1 << 20) - 1, 1, 3], [5, 2, 5, 1023, 0, 4]
    own, held = ti._distinct(np.array(codes), np.array(places), most, total)
    assert list(zip(own.tolist(), held.tolist())) == sorted(set(zip(codes, places)))


def test_units_end_between_texts(spark, tmp_path, monkeypatch):
    """Terms over the edges of blocks are found whatever the units are, and none over the edges of texts."""
    monkeypatch.setattr(ti, "BLOCK_CHARS", 4)
    bodies = ["abcdefgh🙂ij" * 3, None, "", "xyabc", "defgh"] * 5
    content = content_of(spark, bodies).withColumns({"status": F.lit("publish"), "title": F.lit("abc"), "excerpt": F.lit("def")}).cache()
    for unit in (1, 40, 1 << 20):
        batch = pa.RecordBatch.from_pydict({"seq": list(range(25)), "a": ["abc"] * 25, "b": ["def"] * 25, "c": [b or "" for b in bodies]})
        monkeypatch.setattr(ti, "UNIT_BYTES", unit)
        units = list(ti._units(batch))
        assert [s for u in units for s in u.column(0).to_pylist()] == list(range(25))
        rows = [r for u in units for b in ti._postings_of(u, 4) for r in b.to_pylist()]
        owners = {r["unit"]: r["owners"] for r in rows if r["gram"] is None}
        assert {owners[r["unit"]][p] for r in rows if r["gram"] == "🙂ij" for p in r["places"]} == {0, 5, 10, 15, 20}
    path = str(tmp_path / "index")
    ti.build(content, path)
    for term in ("h🙂i", "cde", "ijab", "z"):
        assert found(ti.search(spark, path, term, 1, 20)) == found(ds.search(content, term, 1, 20)), term
    assert ti.candidates(spark, path, "bcde").count() == 5
    content.unpersist()
