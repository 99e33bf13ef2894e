"""Streams against their batch meaning."""

from __future__ import annotations

import datetime as dt
import random

from lucidex import schemas
from lucidex.sources.tables import append_change, read_changing
from lucidex.streaming import sinks, triggers
from tests.test_exposure import T0, frame
from tests.test_scale import greedy

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(spark, folder, schema, batches):
    """A file stream that delivers each batch as one file."""
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, tmp_path, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    return stream.sparkSession.table(name).collect()


def at(second):
    return START + dt.timedelta(seconds=second)


def test_rebuild_triggers_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    dense = sorted(rng.randint(0, 120) for _ in range(60))
    moments = {"k1": [0, 3, 4, 6], "k2": [1], "dense": dense}
    rows = [(site, at(s)) for site, seconds in moments.items() for s in seconds]
    batches = [sorted(rows, key=lambda r: r[1])[:40], sorted(rows, key=lambda r: r[1])[40:], [("k9", at(7200))], [("k9", at(14400))]]
    stream = feed(spark, tmp_path / "in", "site_id string, ts timestamp", batches)
    got: dict = {}
    for row in drain(triggers.stream_triggers(stream, watermark="10 seconds"), tmp_path, "fires"):
        got.setdefault(row["site_id"], []).append(row["fire_second"] - int(START.timestamp()))
    assert sorted(got["k1"]) == [5, 11] and got["k2"] == [6]
    assert sorted(got["dense"]) == greedy(dense, 5)


def test_late_seconds_count_as_in_the_batch(spark, tmp_path):
    rng = random.Random(8)
    seconds = [100, 98] + [rng.randint(90, 400) for _ in range(150)]
    batches = [[("s", at(s)) for s in seconds[i:i + 30]] for i in range(0, len(seconds), 30)] + [[("z", at(7200))], [("z", at(14400))]]
    stream = feed(spark, tmp_path / "in", "site_id string, ts timestamp", batches)
    fired = [r["fire_second"] - int(START.timestamp()) for r in drain(triggers.stream_triggers(stream), tmp_path, "late") if r["site_id"] == "s"]
    assert sorted(fired) == greedy(sorted(seconds), 5)


def test_queue_is_served_in_order_over_all_batches(spark, tmp_path):
    rows = [("s", second * 100 + i, at(second)) for second in range(100) for i in range(12)]
    random.Random(4).shuffle(rows)
    stream = feed(spark, tmp_path / "in", "site_id string, content_id bigint, ts timestamp", [rows])
    out = drain(triggers.stream_queue(stream, watermark="1 minute"), tmp_path, "ordered")
    assert sum(r["outcome"] == "queued" for r in out) == 1000 and sum(r["outcome"] == "refused" for r in out) == 200


def test_queue_cap(spark, tmp_path):
    rows = [("s", i, at(0)) for i in range(14)] + [("s", 1, at(0)), ("s", 50, at(30)), ("t", 1, at(0))]
    stream = feed(spark, tmp_path / "in", "site_id string, content_id bigint, ts timestamp", [rows])
    out = drain(triggers.stream_queue(stream, watermark="1 minute"), tmp_path, "queue")
    outcomes: dict = {}
    for row in out:
        outcomes.setdefault((row["site_id"], row["outcome"]), set()).add(row["content_id"])
    assert outcomes[("s", "queued")] == set(range(10)) | {50}
    assert outcomes[("s", "refused")] == {10, 11, 12, 13}
    assert outcomes[("t", "queued")] == {1}


def test_invalidation_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    stored = [{"site_id": "s", "content_id": i, "content_hash": "h", "markdown": "m", "generated_at": T0,
               "converter_version": "5", "quality_score": 1} for i in range(1, 11)]
    append_change(frame(spark, stored, schemas.STORE), root, "put", schemas.STORE)
    changes = [("s", 2, "save"), ("s", 3, "meta"), ("s", 4, "trash"), ("s", 0, "save"), ("s", 2, "save")]
    stream = feed(spark, tmp_path / "in", "site_id string, content_id bigint, kind string", [changes[:2], changes[2:]])
    sinks.daily_run(stream, sinks.invalidating_sink(root), str(tmp_path / "ck")).start().awaitTermination(120)
    left = {r["content_id"] for r in read_changing(spark, root, schemas.STORE).collect()}
    assert left == {1, 3, 5, 6, 7, 8, 9, 10}
    again = feed(spark, tmp_path / "in2", schemas.STORE, [[tuple(stored[1][n] for n in (
        "site_id", "content_id", "content_hash", "markdown", "generated_at", "converter_version", "quality_score")) + (None,)]])
    sinks.daily_run(again, sinks.upserting_sink(root), str(tmp_path / "ck2")).start().awaitTermination(120)
    assert 2 in {r["content_id"] for r in read_changing(spark, root, schemas.STORE).collect()}


def test_relevant_changes_stream_equals_batch(spark, tmp_path):
    schema = "site_id string, content_id bigint, kind string, meta_key string, taxonomy string"
    rows = [("s", 1, "save", None, None), ("s", 1, "meta", "excluded", None), ("s", 1, "meta", "views", None),
            ("s", 1, "term", None, "category"), ("s", 1, "term", None, "color"), ("s", 2, "save", None, None),
            ("t", 3, "trash", None, None), ("t", 3, "term", None, "post_tag"), ("t", 1, "save", None, None)]
    rows += [("s", 1, "save", None, None)] * 20
    content = spark.createDataFrame([("s", 1, "post"), ("s", 2, "movie"), ("t", 3, "post")],
                                    "site_id string, content_id bigint, post_type string")
    profile = spark.createDataFrame([("s", ["post"], [5], []), ("t", ["post"], [], [])],
                                    "site_id string, exposed_types array<string>, excluded_term_ids array<bigint>, "
                                    "excluded_term_slugs array<string>")
    batch = triggers.relevant_changes(spark.createDataFrame(rows, schema), content, profile).collect()
    stream = feed(spark, tmp_path / "in", schema, [rows[:5], rows[5:]])
    streamed = drain(triggers.relevant_changes(stream, content, profile), tmp_path, "relevant")

    def plain(found):
        return sorted((r["site_id"], r["content_id"], r["kind"], r["meta_key"] or "", r["taxonomy"] or "") for r in found)

    assert plain(batch) == plain(streamed) and len(batch) == 24
    assert ("s", 1, "meta", "excluded", "") in plain(batch) and ("t", 3, "trash", "", "") in plain(batch)
