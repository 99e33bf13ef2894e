"""Numbers that start anew on every site, rows without a stored one, ties, repeated writes, long lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lucidex import schemas
from lucidex.operators import descriptions as ds, profile, site_index, skew, store
from lucidex.plans.catalog import QUERIES
from lucidex.sources.tables import append_change, compact, read_changing
from lucidex.streaming import sinks, triggers

T0 = datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_changes_stay_on_their_site(spark):
    content = frame(spark, [("a", 1, "post"), ("b", 1, "post"), ("b", 2, "page")], "site_id string, content_id bigint, post_type string")
    settings = frame(spark, [("a", ["post"], [], []), ("b", ["post"], [], [])],
                     "site_id string, exposed_types array<string>, excluded_term_ids array<bigint>, excluded_term_slugs array<string>")
    changes = frame(spark, [("a", 1, "save", None, None, 10), ("b", 2, "save", None, None, 10), ("c", 1, "save", None, None, 10)],
                    "site_id string, content_id bigint, kind string, meta_key string, taxonomy string, second bigint")
    found = triggers.relevant_changes(changes, content, settings)
    assert [(r["site_id"], r["content_id"]) for r in found.collect()] == [("a", 1)]
    assert found.columns == changes.columns


def test_first_results_and_requests_are_kept(spark):
    stored = frame(spark, [("a", 1, "old", None, T0, "1", "done")], schemas.DESCRIPTIONS)
    results = frame(spark, [("a", 2, False, None, False, "Fresh words", T0), ("b", 1, True, None, False, None, T0)],
                    "site_id string, content_id bigint, below_floor boolean, error_code string, needs_retry boolean, reply string, modified_at timestamp_ntz")
    got = {(r["site_id"], r["content_id"]): (r["auto"], r["job_status"], r["changed"]) for r in ds.apply_results(stored, results).collect()}
    assert got == {("a", 1): ("old", "done", False), ("a", 2): ("Fresh words", "done", True), ("b", 1): (None, "skipped", False)}
    requests = frame(spark, [("a", 2, "set", "Own words"), ("b", 1, "regenerate", None)], "site_id string, content_id bigint, request string, manual_text string")
    asked = {(r["site_id"], r["content_id"]): (r["manual"], r["requeued"], r["changed"]) for r in ds.apply_requests(stored, requests).collect()}
    assert asked == {("a", 1): (None, False, False), ("a", 2): ("Own words", False, True), ("b", 1): (None, True, False)}


def test_a_site_without_settings_can_be_updated(spark):
    stored = frame(spark, [], schemas.PROFILE)
    asked = frame(spark, [("new", ["page"], ["publish"])], "site_id string, exposed_types array<string>, exposed_statuses array<string>")
    row = profile.update_exposure(stored, asked).first()
    assert (row["site_id"], row["exposed_types"], row["changed"], row["markdown_enabled"]) == ("new", ["page"], True, True)


def test_long_numbers_are_no_ids(spark):
    rows = frame(spark, [(["12345678901234567890123", "-7x", " 7", "0"],)], "ids array<string>")
    assert rows.select(profile.clean_ids("ids").alias("i")).first()["i"] == [7]


def entry(text, at=T0, site="a", number=1, digest="h"):
    return (site, number, digest, text, at, "5", 10, "{}")


def test_a_change_wins_a_tie(spark):
    base = frame(spark, [entry("old", digest="z"), entry("other", number=2), entry("kept", number=3)], schemas.STORE)
    changes = frame(spark, [entry("new", digest="a"), entry("late", T0 - timedelta(days=1), number=2), entry("first", number=9)], schemas.STORE)
    got = {r["content_id"]: r["markdown"] for r in store.upsert(base, changes).collect()}
    assert got == {1: "new", 2: "other", 3: "kept", 9: "first"}


def test_writes_are_named_by_run(spark, tmp_path):
    root = str(tmp_path / "store")
    put = sinks.upserting_sink(root)
    put(frame(spark, [entry("one")], schemas.STORE), 0)
    drop = sinks.invalidating_sink(root)
    gone = frame(spark, [("a", 1, "save")], "site_id string, content_id bigint, kind string")
    drop(gone, 0)
    put(frame(spark, [entry("two")], schemas.STORE), 1)
    drop(gone, 0)  # replayed after a later put
    assert [r["markdown"] for r in read_changing(spark, root, schemas.STORE).collect()] == ["two"]
    # Two writers that saw the same state do not overwrite each other.
    spark.createDataFrame([(3, "log", "x"), (3, "log", "y")], "seq bigint, kind string, run string").write.mode("append").json(f"{root}/_commits")
    for run, number in (("x", 5), ("y", 6)):
        frame(spark, [entry(run, number=number)], schemas.STORE).withColumns(
            {"_op": F.lit("put"), "_seq": F.lit(3).cast("bigint"), "_run": F.lit(run)}).write.parquet(f"{root}/log/seq=3-{run}")
    assert sorted(r["markdown"] for r in read_changing(spark, root, schemas.STORE).collect()) == ["two", "x", "y"]
    compact(spark, root, schemas.STORE)
    append_change(frame(spark, [entry("six", number=6)], schemas.STORE), root, "put", schemas.STORE)
    assert sorted(r["markdown"] for r in read_changing(spark, root, schemas.STORE).collect()) == ["six", "two", "x"]


def test_every_document_of_a_type_is_listed(spark):
    rows = spark.range(1, 1501).select(
        F.lit("a").alias("site_id"), F.col("id").alias("content_id"), F.lit("post").alias("post_type"), F.lit("publish").alias("status"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 700 AS int))").alias("published_at"),
        F.array(F.lit("post")).alias("exposed_types"), F.array(F.lit("publish")).alias("exposed_statuses"))
    ranked = site_index.newest_per_type(rows).orderBy("type_rank").select("content_id", "type_rank").collect()
    assert [r["type_rank"] for r in ranked] == list(range(1, 1501))
    assert [r["content_id"] for r in ranked] == [r["content_id"] for r in rows.orderBy(F.desc("published_at"), F.desc("content_id")).collect()]
    assert ds.considered_rows(rows).count() == 1500


def test_rank_all_ranks_rows_without_a_bucket_last(spark):
    rows = frame(spark, [("g", i, i // 10 if i < 50 else None) for i in range(60)], "g string, i int, b int")
    got = {r["i"]: r["rank"] for r in skew.rank_all(rows, ["g"], F.col("b"), [F.desc("i")]).collect()}
    assert got == {**{i: 50 - i for i in range(50)}, **{i: 110 - i for i in range(50, 60)}}


def test_every_dropping_kind_invalidates(spark, tmp_path):
    """Saved and inserted documents lose their stored text, like trashed ones; other changes keep it."""
    kinds = ["signup", "click", "error", "view", "purchase"]
    pages = [(i, f"https://www.shop.com/en/p{i}", f"<title>T{i}</title>") for i in range(6)]
    events = [(i, T0, i, kind, 1.0) for i, kind in enumerate(kinds)]
    docs = [(i, f"text {i}", "en", "s", 6) for i in range(6)]
    for name, rows, schema in (("pages", pages, "page_id long, url string, html string"),
                               ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
                               ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")):
        frame(spark, rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    left = QUERIES["markdown_invalidate"](spark, str(tmp_path)).collect()
    assert sorted(r["content_id"] for r in left) == [4, 5, 6]
