"""Publication: all or nothing, one pointer, pinned readers; numbers of changes for one writer each."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lucidex.plans import jobs
from lucidex.plans.catalog import QUERIES
from lucidex.plans.inputs import Inputs
from lucidex.sources import snapshots
from lucidex.sources.tables import append_change, commits, compact, read_changing
from lucidex.sources.work import create_if_absent, files_in

SF = "/root/testdata/sf0.001"
SCHEMA = "site_id string, content_id bigint, v string"


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def shown(frame):
    return sorted(r["v"] for r in frame.collect())


def test_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert snapshots.latest(spark, root) is None
    first = snapshots.publish(spark, root, "a", {"lines": rows(spark, "1"), "parts": rows(spark, "p")}, stamp="today")
    assert (first.version, first.run, first.stamp, first.tables) == (1, "a", "today", ("lines", "parts"))
    held = first.table("lines")
    second = snapshots.publish(spark, root, "b", {"lines": rows(spark, "1", "2")}, base=1)
    assert second.version == 2 and shown(snapshots.latest(spark, root).table("lines")) == ["1", "2"]
    assert shown(held) == ["1"] and shown(snapshots.open_version(spark, root, 1).table("lines")) == ["1"]
    with pytest.raises(KeyError):
        second.table("parts")
    again = snapshots.publish(spark, root, "a", {"lines": rows(spark, "never")})
    assert again == first and snapshots.versions(spark, root) == [1, 2]
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, "c", {"lines": rows(spark, "3")}, base=1)
    assert shown(snapshots.latest(spark, root).table("lines")) == ["1", "2"]


def test_a_failed_run_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "index")
    snapshots.publish(spark, root, "good", {"lines": rows(spark, "old"), "full": rows(spark, "old")})
    broken = rows(spark, "x").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, root, "bad", {"lines": rows(spark, "new"), "full": broken})
    assert files_in(spark, f"{root}/runs/bad")  # half of it was written
    now = snapshots.latest(spark, root)
    assert now.run == "good" and shown(now.table("lines")) == shown(now.table("full")) == ["old"]
    mended = snapshots.publish(spark, root, "bad", {"lines": rows(spark, "new"), "full": rows(spark, "new")})
    assert mended.version == 2 and shown(mended.table("full")) == ["new"]


def test_publishers_at_once_take_different_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: snapshots.publish(spark, root, f"run{i}", {"t": rows(spark, str(i))}), range(6)))
    assert sorted(s.version for s in made) == snapshots.versions(spark, root) == [1, 2, 3, 4, 5, 6]
    assert all(shown(s.table("t")) == [s.run[3:]] for s in made)


def test_expire(spark, tmp_path):
    root = str(tmp_path / "index")
    for i in range(5):
        snapshots.publish(spark, root, f"r{i}", {"t": rows(spark, str(i))})
    rows(spark, "half").write.parquet(f"{root}/runs/dead/t")
    rows(spark, "half").write.parquet(f"{root}/runs/alive/t")
    assert snapshots.expire(spark, root, keep=2, running=("alive",)) == ["dead", "r0", "r1", "r2"]
    assert snapshots.versions(spark, root) == [4, 5] and shown(snapshots.open_version(spark, root, 4).table("t")) == ["3"]
    assert snapshots.publish(spark, root, "r9", {"t": rows(spark, "9")}).version == 6


def test_create_if_absent_has_one_winner(spark, tmp_path):
    path = str(tmp_path / "deep" / "file")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_if_absent(spark, path, str(i)), range(16)))
    assert sum(won) == 1 and (tmp_path / "deep" / "file").read_text() == str(won.index(True))
    assert list(files_in(spark, str(tmp_path / "deep"))) == ["file"]


def change(spark, *pairs):
    return spark.createDataFrame([("s", c, v) for c, v in pairs], SCHEMA)


def test_writers_at_once_take_different_numbers(spark, tmp_path):
    root = str(tmp_path / "store")
    with ThreadPoolExecutor(6) as pool:
        seqs = list(pool.map(lambda i: append_change(change(spark, (1, str(i)), (10 + i, "own")), root, "put", SCHEMA, f"run{i}"), range(6)))
    assert sorted(seqs) == list(range(6))
    state = {r["content_id"]: r["v"] for r in read_changing(spark, root, SCHEMA).collect()}
    assert state == {1: str(seqs.index(5)), **{10 + i: "own" for i in range(6)}}


def test_compaction_waits_for_writers_and_gives_up_dead_ones(spark, tmp_path):
    root = str(tmp_path / "store")
    append_change(change(spark, (1, "a")), root, "put", SCHEMA)
    assert create_if_absent(spark, f"{root}/_claims/{1:012d}", "slow")  # a writer that still writes
    append_change(change(spark, (1, "late"), (2, "b")), root, "put", SCHEMA)
    assert compact(spark, root, SCHEMA) == 0  # only what is before the open claim
    state = lambda: {r["content_id"]: r["v"] for r in read_changing(spark, root, SCHEMA).collect()}
    assert state() == {1: "late", 2: "b"}
    assert compact(spark, root, SCHEMA, patience=0) == 2  # given up
    assert state() == {1: "late", 2: "b"}
    assert not create_if_absent(spark, f"{root}/_ends/{1:012d}", "slow")  # so it can't finish under that number
    assert append_change(change(spark, (1, "slow")), root, "put", SCHEMA) == 3 and state() == {1: "slow", 2: "b"}


def test_a_writer_whose_claim_was_given_up_takes_another(spark, tmp_path):
    root = str(tmp_path / "store")
    create_if_absent(spark, f"{root}/_ends/{0:012d}", "given up")
    assert append_change(change(spark, (1, "a")), root, "put", SCHEMA) == 1
    assert shown(read_changing(spark, root, SCHEMA)) == ["a"] and commits(spark, root).count() == 1


def test_daily_rebuild(spark, tmp_path):
    root, inputs = str(tmp_path / "index"), Inputs(spark, SF)
    tables = (inputs.profile, inputs.sample("content_meta"), inputs.sample("robots"), inputs.descriptions, inputs.editorial, inputs.store)
    made = jobs.daily_rebuild(root, "2024-02-01", inputs.content, *tables)
    assert made.table("lines").count() == inputs.rows.count()
    assert jobs.daily_rebuild(root, "2024-02-01", inputs.content.limit(0), *tables) == made
    fewer = jobs.daily_rebuild(root, "2024-02-02", inputs.content.filter("content_id > 25"), *tables, keep=1)
    assert fewer.version == 2 and 0 < fewer.table("full").count() < inputs.full_rows.count()
    assert snapshots.versions(spark, root) == [2] and list(files_in(spark, f"{root}/runs")) == ["daily-2024-02-02"]


def test_runs_of_the_query_read_inputs_that_are_derived_once(spark, monkeypatch):
    class Stop(Exception):
        pass

    seen = []

    def publish(root, run, *tables, **more):
        seen.extend(tables)
        raise Stop

    monkeypatch.setattr(jobs, "publish_snapshot", publish)
    with pytest.raises(Stop):
        QUERIES["index_snapshot"](spark, SF)
    derived = [all("/snapshot-" in file for file in rows.inputFiles()) for rows in seen]
    assert len(derived) == 7 and derived.count(False) == 1  # descriptions are the documents themselves


def test_parts_are_made_from_the_lines_that_were_written(spark, tmp_path, monkeypatch):
    inputs, out, read = Inputs(spark, SF), str(tmp_path / "index"), []
    plain = jobs.site_index.index_parts
    monkeypatch.setattr(jobs.site_index, "index_parts", lambda lines, profile: (read.append(lines), plain(lines, profile))[1])
    tables = (inputs.profile, inputs.sample("content_meta"), inputs.sample("robots"), inputs.descriptions, inputs.editorial, inputs.store)
    jobs.publish_indexes(inputs.content, *tables, out=out)
    files = read[0].inputFiles()
    assert files and all("/index/lines/" in file for file in files)
    assert spark.read.parquet(f"{out}/parts").agg(F.sum("lines")).first()[0] == spark.read.parquet(f"{out}/lines").count()
