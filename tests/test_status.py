"""Documents that give no text have a reason, and none of them fails a task."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from lucidex import schemas
from lucidex.operators import conversion
from lucidex.plans import jobs
from lucidex.sources.tables import read_changing

KEY = ["site_id", "content_id"]
PAGES = {
    1: "<p>plain</p>", 2: "", 3: None, 4: "<p>" + "x" * 6_000_000 + "</p>", 5: "<div>" * 100 + "deep words" + "</div>" * 100,
    6: "<ul><li>" * 500 + "item" + "</li></ul>" * 500, 7: "<script>var a = 1;</script>", 8: "<img src='x.png'>",
}


def content_of(spark, pages):
    rows = [("s", i, "post", "publish", "", f"p{i}", f"Title {i}", "", html, f"https://s.com/p{i}", datetime(2024, 1, 1), datetime(2024, 1, 2), [], [], "{}")
            for i, html in pages.items()]
    return spark.createDataFrame(rows, schemas.CONTENT)


def test_reasons(spark):
    got = {r["content_id"]: r for r in conversion.convert(content_of(spark, PAGES), KEY).collect()}
    assert {i: r["status"] for i, r in got.items() if i not in (5, 6)} == {
        1: "ok", 2: "empty", 3: "empty", 4: "oversize", 7: "ok", 8: "ok"}
    assert got[5]["status"] == "nothing_kept" and got[5]["markdown"].strip() == ""
    assert got[6]["status"] in ("failed", "nothing_kept") and got[6]["markdown"].strip() == ""
    assert got[1]["markdown"].strip() == "plain" and got[4]["quality_score"] == 100


def test_the_job_keeps_reasons(spark, tmp_path):
    root = str(tmp_path / "store")
    shown = lambda: {r["content_id"]: r["status"] for r in jobs.conversion_status(spark, root).collect()}
    jobs.refresh_conversions(spark, content_of(spark, PAGES), root, "2024-02-01 00:00:00")
    first = shown()
    assert first.keys() == {2, 3, 4, 5, 6} and first[4] == "oversize" and first[5] == "nothing_kept"
    assert read_changing(spark, root, schemas.STORE).count() == len(PAGES)
    changed = {**PAGES, 4: "<p>short now</p>", 1: ""}
    del changed[5]
    jobs.refresh_conversions(spark, content_of(spark, changed), root, "2024-02-02 00:00:00")
    then = shown()
    assert then.keys() == {1, 2, 3, 6} and then[1] == "empty"


def test_deep_fields_fail_no_task(spark):
    deep = {"type": "text", "value": "at the bottom"}
    value: object = "at the bottom"
    field: dict = {"name": "f", "type": "text"}
    for _ in range(150):
        field, value = {"name": "f", "type": "group", "sub_fields": [field]}, {"f": value}
    nested = json.dumps({"a": {**field, "value": value}, "b": deep})
    hopeless = '{"a": ' * 5000 + "1" + "}" * 5000
    rows = spark.createDataFrame([(1, nested), (2, hopeless), (3, None), (4, "{"), (5, "[]")], "content_id long, fields_json string")
    got = conversion.field_rows(rows, ["content_id"]).orderBy("content_id", "ordinal").collect()
    assert [(r["content_id"], r["ordinal"], r["text"]) for r in got] == [(1, 0, "at the bottom"), (1, 1, "at the bottom")]
