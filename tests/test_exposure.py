"""The exposure gate: one case per rule and their order."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lucidex import schemas
from lucidex.operators import exposure
from lucidex.operators.profile import clean_editorial, normalise_profile, update_exposure

T0 = dt.datetime(2024, 1, 1)
DOC = {"site_id": "s", "post_type": "post", "status": "publish", "password": "", "slug": "about", "title": "T",
       "excerpt": "", "body_html": "", "permalink": "https://s/about", "published_at": T0, "modified_at": T0,
       "terms": [], "robots": [], "fields_json": None}
SITE = {"site_id": "s", "exposed_types": ["post"], "exposed_statuses": ["publish"]}

#: name -> (document changes, site changes, meta, robots row, reason)
CASES = {
    "plain": ({}, {}, {}, None, None),
    "type": ({"post_type": "page"}, {}, {}, None, "cpt"),
    "type first": ({"post_type": "page", "status": "draft", "password": "x"}, {}, {}, None, "cpt"),
    "status": ({"status": "draft"}, {}, {}, None, "status"),
    "status allowed": ({"status": "draft"}, {"exposed_statuses": ["draft"]}, {}, None, None),
    "password": ({"password": "pw"}, {}, {"excluded": "1"}, None, "password"),
    "yoast": ({}, {"seo_posture": "yoast"}, {"yoast_noindex": "1"}, None, "noindex"),
    "yoast off": ({}, {"seo_posture": "yoast"}, {"yoast_noindex": "0"}, None, None),
    "yoast flag, other posture": ({}, {"seo_posture": "none"}, {"yoast_noindex": "1"}, None, None),
    "rank math": ({"robots": ["noindex"]}, {"seo_posture": "rank_math"}, {}, None, "noindex"),
    "rank math index": ({"robots": ["index"]}, {"seo_posture": "rank_math"}, {}, None, None),
    "aioseo": ({}, {"seo_posture": "aioseo"}, {}, (False, True), "noindex"),
    "aioseo default": ({}, {"seo_posture": "aioseo"}, {}, (True, True), None),
    "aioseo no row": ({}, {"seo_posture": "aioseo"}, {}, None, None),
    "noindex before excluded": ({"robots": ["noindex"]}, {"seo_posture": "rank_math"}, {"excluded": "1"}, None, "noindex"),
    "meta flag": ({}, {}, {"excluded": "1"}, None, "excluded"),
    "meta flag off": ({}, {}, {"excluded": "0"}, None, None),
    "id list": ({}, {"excluded_ids": ["16"]}, {}, None, "excluded"),
    "slug list": ({}, {"excluded_slugs": ["About"]}, {}, None, "excluded"),
    "empty slug": ({"slug": ""}, {"excluded_slugs": [""]}, {}, None, None),
    "utility page": ({}, {"utility_ids": [0, 20]}, {}, None, "excluded"),
    "term id": ({"terms": [("category", 5, "news")]}, {"excluded_term_ids": ["5"]}, {}, None, "excluded"),
    "term slug": ({"terms": [("post_tag", 6, "old")]}, {"excluded_term_slugs": ["old"]}, {}, None, "excluded"),
    "other taxonomy": ({"terms": [("color", 5, "news")]}, {"excluded_term_ids": ["5"], "excluded_term_slugs": ["news"]},
                       {}, None, None),
    "sample": ({"slug": "hello-world"}, {}, {}, None, "sample"),
    "sample allowed": ({"slug": "hello-world"}, {"exclude_samples": False}, {}, None, None),
}


def frame(spark, rows, schema):
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def reasons(spark):
    docs, sites, meta, robots = [], [], [], []
    for i, (doc, site, flags, row, _) in enumerate(CASES.values()):
        sid, cid = f"s{i}", i
        if "id list" == list(CASES)[i]:
            cid = 16
        if "utility page" == list(CASES)[i]:
            cid = 20
        docs.append({**DOC, "site_id": sid, "content_id": cid, **doc})
        sites.append({**SITE, "seo_posture": "none", **site, "site_id": sid})
        meta += [{"site_id": sid, "content_id": cid, "key": k, "value": v} for k, v in flags.items()]
        if row:
            robots.append({"site_id": sid, "content_id": cid, "robots_default": row[0], "robots_noindex": row[1]})
    profile = normalise_profile(frame(spark, sites, schemas.PROFILE))
    rows = exposure.with_profile(frame(spark, docs, schemas.CONTENT), profile)
    gated = exposure.with_exposure(rows, frame(spark, meta, schemas.CONTENT_META), frame(spark, robots, schemas.ROBOTS))
    return {r["site_id"]: r["reason"] for r in gated.collect()}


@pytest.mark.parametrize("name", CASES)
def test_reason(reasons, name):
    assert reasons[f"s{list(CASES).index(name)}"] == CASES[name][4]


def test_plugged_noindex(spark):
    profile = normalise_profile(frame(spark, [{**SITE, "seo_posture": "none"}], schemas.PROFILE))
    rows = exposure.with_profile(frame(spark, [{**DOC, "content_id": 1}], schemas.CONTENT), profile)
    gated = exposure.with_exposure(rows, frame(spark, [], schemas.CONTENT_META), frame(spark, [], schemas.ROBOTS),
                                   extra_noindex=F.col("title") == "T")
    assert gated.first()["reason"] == "noindex"


def test_profile_defaults_and_cleaning(spark):
    stored = frame(spark, [{"site_id": "a"}, {
        "site_id": "b", "exposed_types": ["Post!", "post", "movie", ""], "exposed_statuses": ["Draft", "gone"],
        "excluded_ids": ["-3", "4x", "0", "3"], "excluded_slugs": [" My Slug ", "--", "my-slug"],
        "static_mode": "on", "markdown_enabled": False}], schemas.PROFILE)
    rows = {r["site_id"]: r for r in normalise_profile(stored).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["exposed_types"], a["exposed_statuses"], a["static_mode"]) == ([], ["publish"], "auto")
    assert a["markdown_enabled"] and a["descriptions_enabled"] and not a["structured_data_enabled"] and not a["allow_training"]
    assert (b["exposed_types"], b["exposed_statuses"], b["excluded_ids"], b["excluded_slugs"]) == (
        ["post"], ["draft"], [3, 4], ["my-slug"])
    assert b["static_mode"] == "on" and not b["markdown_enabled"]


def test_profile_update_reports_changes(spark):
    stored = frame(spark, [{**SITE}, {**SITE, "site_id": "t"}], schemas.PROFILE)
    asked = spark.createDataFrame([("s", ["page"], ["publish"]), ("t", ["post"], ["publish"])],
                                  "site_id string, exposed_types array<string>, exposed_statuses array<string>")
    rows = {r["site_id"]: (r["exposed_types"], r["changed"]) for r in update_exposure(stored, asked).collect()}
    assert rows == {"s": (["page"], True), "t": (["post"], False)}


def test_editorial(spark):
    raw = [(1, "<i>A</i>", "https://x/1", None, None, None), (2, "B", "javascript:x", None, "Featured", None),
           (3, "C", "mailto:a@b.c", "D\nd", "Custom", " My  label "), (4, "D", "https://x/4", "", "Custom", " "),
           (5, "E", "/relative", "", "Resources", "x"), (6, " ", "https://x/6", "", "Featured", None)]
    frame_ = spark.createDataFrame([("s", *r) for r in raw], schemas.EDITORIAL)
    rows = {r["position"]: (r["title"], r["section"], r["rendered_label"]) for r in clean_editorial(frame_).collect()}
    assert rows == {1: ("A", "Featured", "Featured"), 3: ("C", "Custom", "My label"), 4: ("D", "Featured", "Featured"),
                    5: ("E", "Resources", "Resources")}
