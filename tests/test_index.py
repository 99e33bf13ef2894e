"""Index text: order, merging, parts, caps; description jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lucidex import schemas
from lucidex.operators import descriptions as ds, site_index as si, store
from lucidex.operators.exposure import with_exposure, with_profile
from lucidex.operators.profile import normalise_profile
from tests.test_exposure import DOC, SITE, T0, frame

ENTRY = ("site_id string, content_id bigint, post_type string, type_order int, type_rank int, label string, title string, "
         "url string, description string")
CURATED = "site_id string, position bigint, title string, url string, description string, rendered_label string"


def parts_of(spark, sites, curated, entries, **options):
    profile = spark.createDataFrame(sites, "site_id string, site_name string, tagline string")
    editorial = spark.createDataFrame(curated, CURATED)
    lines = si.index_lines(si.index_rows(editorial, spark.createDataFrame(entries, ENTRY)))
    return si.index_parts(lines, profile, **options)


def bodies(*args):
    return si.index_body(parts_of(*args))


def text_of(frame_):
    return {r["site_id"]: r["body"] for r in frame_.collect()}


def test_header_only_and_empty(spark):
    got = text_of(bodies(spark, [("a", "My\nSite", "A *tag*"), ("b", "", ""), ("c", "X", "")], [], []))
    assert got == {"a": "# My Site\n> A \\*tag\\*\n", "b": "", "c": "# X\n"}


def test_order_merge_and_escapes(spark):
    curated = [("s", 1, "News 1", "https://x/n(1)", "", "News"), ("s", 2, "Curated", "https://x/c", "Hand &amp; made", "page"),
               ("s", 3, "Loose", "https://x/l", "", ""), ("s", 4, "News 2", "https://x/n2", "", "News"),
               ("s", 5, "", "https://x/none", "", "Gone")]
    entries = [("s", 11, "post", 1, 1, "post", "Post [A]", "https://x/p", "Says_so"),
               ("s", 12, "page", 2, 2, "page", "Auto 2", "https://x/a2", ""),
               ("s", 13, "page", 2, 1, "page", "Auto 1", "https://x/a1", "")]
    got = text_of(bodies(spark, [("s", "", "")], curated, entries))["s"]
    assert got == (
        "# \n\n## News\n\n- [News 1](https://x/n%281%29)\n- [News 2](https://x/n2)\n"
        "\n## page\n\n- [Curated](https://x/c): Hand & made\n- [Auto 1](https://x/a1)\n- [Auto 2](https://x/a2)\n"
        "\n## Editorial\n\n- [Loose](https://x/l)\n"
        "\n## post\n\n- [Post \\[A\\]](https://x/p): Says\\_so\n")


def test_parts_join_to_the_text(spark):
    curated = [("s", i, f"T{i}", f"https://x/{i}", "", "News" if i % 3 else "Other") for i in range(1, 60)]
    entries = [("s", 100 + i, "post", 1, i, "post", f"P{i}", f"https://x/p{i}", "") for i in range(1, 30)]
    args = (spark, [("s", "Name", "Tag")], curated, entries)
    whole = text_of(bodies(*args))["s"]
    parts = parts_of(*args, lines_per_piece=7).orderBy("part").collect()
    assert len(parts) > 5 and "".join(p["body"] for p in parts) == whole
    assert max(p["lines"] for p in parts) <= 7 and sum(p["lines"] for p in parts) == 88
    stored = si.index_artifact(bodies(*args)).first()
    assert (stored["entry_count"], stored["body_bytes"]) == (whole.count("\n- "), len(whole.encode()))


def test_labels_shared_by_two_types(spark):
    entries = [("s", 1, "a", 1, 1, "X", "A1", "u1", ""), ("s", 2, "b", 2, 1, "Y", "B1", "u2", ""),
               ("s", 3, "c", 3, 1, "X", "C1", "u3", "")]
    assert text_of(bodies(spark, [("s", "N", "")], [], entries))["s"] == (
        "# N\n\n## X\n\n- [A1](u1)\n- [C1](u3)\n\n## Y\n\n- [B1](u2)\n")


def test_full_index(spark):
    entries = spark.createDataFrame([
        ("s", 1, "post", 1, 1, "Posts", "One", "https://x/1", ""), ("s", 2, "post", 1, 2, "Posts", "Two", "https://x/2", ""),
        ("s", 3, "page", 2, 1, "Pages", "Three", "https://x/3", "")], ENTRY)
    editorial = spark.createDataFrame([("s", 1, "Pick", "https://x/p", "", "Featured")], CURATED)
    texts = spark.createDataFrame([("s", 1, " # Body\n\n### Inner\n"), ("s", 3, "  ")], "site_id string, content_id bigint, markdown string")
    rows = si.full_index(editorial, entries, texts)
    ordered = rows.orderBy("section_kind", "section_pos", "entry_pos").collect()
    assert "".join(r["text"] for r in ordered) == (
        "\n## Featured\n\n- [Pick](https://x/p)\n"
        "\n## Posts\n\n### One\n\nURL: https://x/1\n\n# Body\n\n### Inner\n"
        "\n---\n\n### Two\n\nURL: https://x/2\n"
        "\n## Pages\n\n### Three\n\nURL: https://x/3\n")
    profile = spark.createDataFrame([("s", "Name", "")], "site_id string, site_name string, tagline string")
    sizes = si.full_artifact(rows, profile).first()
    assert (sizes["doc_count"], sizes["doc_count_text"]) == (3, 4)
    assert sizes["body_bytes"] == len("# Name\n") + sum(len(r["text"]) for r in ordered)


def test_cap_comes_before_the_gate(spark):
    docs = [{**DOC, "content_id": i, "published_at": T0 + dt.timedelta(minutes=i), "title": f"T{i}", "excerpt": f"E{i}",
             "password": "x" if i > 7 else ""} for i in range(1, 11)]
    profile = normalise_profile(frame(spark, [{**SITE, "seo_posture": "none"}], schemas.PROFILE))
    capped = si.newest_per_type(with_profile(frame(spark, docs, schemas.CONTENT), profile), cap=5)
    gated = with_exposure(capped, frame(spark, [], schemas.CONTENT_META), frame(spark, [], schemas.ROBOTS))
    blank = frame(spark, [{"site_id": "s", "content_id": 7, "markdown": " \n"}], schemas.STORE)
    entries = si.index_entries(gated, frame(spark, [], schemas.DESCRIPTIONS), blank, labels={"post": "Posts"})
    got = [(r["content_id"], r["label"], r["url"], r["description"]) for r in entries.collect()]
    assert got == [(6, "Posts", "https://s/about.md", "E6")]


def test_description_precedence(spark):
    cases = [("P", "M", "A", "E", "P"), (None, " M ", "A", "E", "M"), (" ", "  ", "A", "E", "A"), (None, None, None, "E", "E"),
             (None, "", " ", " ", ""), (None, "<b></b>", "A", "", "")]
    rows = spark.createDataFrame([(*c,) for c in cases], "p string, m string, a string, e string, want string")
    for row in rows.select("want", ds.resolved_description(*[F.col(c) for c in "pmae"]).alias("got")).collect():
        assert row["got"] == row["want"]


def test_queue_and_counts(spark):
    day = dt.timedelta(days=1)
    schema = ("site_id string, content_id bigint, published_at timestamp_ntz, modified_at timestamp_ntz, reason string, "
              "auto string, manual string, generated_for timestamp_ntz, generator_version string, descriptions_enabled boolean, "
              "client_configured boolean")
    base = ("s", T0, None, None, None, None, None, True, True)

    def row(cid, **over):
        full = dict(zip(("site_id", "modified_at", "reason", "auto", "manual", "generated_for", "generator_version",
                         "descriptions_enabled", "client_configured"), base)) | over
        return {"content_id": cid, "published_at": T0 + dt.timedelta(minutes=cid), **full}

    rows = frame(spark, [
        row(1), row(2, manual="M"), row(3, auto="A", generated_for=T0, generator_version="1"),
        row(4, auto="A", generated_for=T0 - day, generator_version="1"), row(5, auto="A", generated_for=T0, generator_version="0"),
        row(6, auto="A"), row(7, reason="cpt"), row(8, client_configured=False), row(9, descriptions_enabled=False),
        row(10, auto="  ", manual=" ")], schema)
    marked = rows.withColumns({"eligible": ds.is_eligible(), "stale": ds.is_stale(
        F.col("auto"), F.col("generated_for"), F.col("modified_at"), F.col("generator_version"))}).cache()
    assert {r["content_id"] for r in marked.filter("eligible").collect()} == {1, 4, 5, 6, 10}
    assert {r["content_id"] for r in marked.filter("stale").collect()} == {4, 5, 6}
    assert [r["content_id"] for r in ds.take_budget(marked, 2).orderBy("queue_rank").collect()] == [10, 6]
    counts = ds.run_counts(marked, 2).first()
    assert (counts["scheduled"], counts["skipped"], counts["total_considered"]) == (2, 8, 10)
    assert [ds.run_limit(n) for n in (0, -1, 7, 500)] == [10, 10, 7, 100]


def test_paging(spark):
    rows = spark.range(1, 48).select(F.lit("s").alias("site_id"), F.col("id").alias("content_id"),
                                     F.lit(T0).cast("timestamp_ntz").alias("published_at"))
    shown = ds.page_of(rows, page=3, size=20).orderBy("position").collect()
    assert [r["content_id"] for r in shown] == list(range(7, 0, -1))
    assert (shown[0]["total"], shown[0]["pages"], shown[0]["position"]) == (47, 3, 41)
    assert ds.page_of(rows, page=0, size=0).count() == 1
    assert ds.page_of(rows, page=1, size=1000).count() == 47


def test_store_upsert_keeps_newest_and_plan_sees_it(spark):
    def stored(cid, hash_, minutes, version="5"):
        return {"site_id": "s", "content_id": cid, "content_hash": hash_, "markdown": hash_, "converter_version": version,
                "generated_at": T0 + dt.timedelta(minutes=minutes), "quality_score": 1}

    old = frame(spark, [stored(1, "a", 1), stored(2, "b", 5), stored(3, "c", 1, "4")], schemas.STORE)
    new = frame(spark, [stored(1, "a2", 2), stored(2, "b2", 4), stored(4, "d", 1)], schemas.STORE)
    done = store.upsert(old, new).cache()
    assert {(r["content_id"], r["content_hash"]) for r in done.collect()} == {(1, "a2"), (2, "b"), (3, "c"), (4, "d")}
    keys = spark.createDataFrame([("s", 1, "a2"), ("s", 2, "x"), ("s", 3, "c"), ("s", 9, "n")],
                                 "site_id string, content_id bigint, content_hash string")
    plan = {r["content_id"]: r["action"] for r in store.plan_conversion(keys, done).collect()}
    assert plan == {1: "hit", 2: "miss", 3: "miss", 9: "miss"}
    gone = spark.createDataFrame([("s", 1), ("s", 1), ("s", 0)], "site_id string, content_id bigint")
    assert {r["content_id"] for r in store.invalidate(done, gone).collect()} == {2, 3, 4}


def test_structured_data_nodes(spark):
    from lucidex.operators import publish

    rows = spark.createDataFrame([
        ("s", 1, "post", 'A <b> & "q"', "https://s/1", ["Article", "WebPage"], True),
        ("s", 2, "page", "P", "https://s/2", ["WebSite", "WebPage"], True),
        ("s", 3, "page", "P", "https://s/3", ["WebPage"], False)],
        "site_id string, content_id bigint, post_type string, title string, permalink string, gap array<string>, "
        "weakly_exposed boolean").withColumns({
            "structured_data_enabled": F.lit(True), "home_url": F.lit("https://s/"), "site_name": F.lit("S"),
            "language": F.lit("en-US"), "published_at": F.lit(T0).cast("timestamp_ntz"),
            "modified_at": F.lit(T0).cast("timestamp_ntz")})
    got = {r["content_id"]: (r["nodes"], r["json_ld"]) for r in publish.structured_data(rows).collect()}
    import json

    assert set(got) == {1, 2}
    assert got[1][0] == 1 and "\\u003Cb\\u003E" in got[1][1] and json.loads(got[1][1])["headline"] == 'A <b> & "q"'
    assert json.loads(got[1][1])["datePublished"] == "2024-01-01T00:00:00+00:00"
    assert [n["@type"] for n in json.loads(got[2][1])] == ["WebSite", "WebPage"]


def test_mirror_actions(spark):
    from lucidex.operators import publish

    day = dt.timedelta(days=1)
    content = frame(spark, [{"site_id": "s", "content_id": i, "path": f"p{i}.md", "modified_at": T0, "has_twin": twin}
                            for i, twin in ((1, True), (2, True), (3, True), (4, True), (5, False), (6, False))],
                    "site_id string, content_id bigint, path string, modified_at timestamp_ntz, has_twin boolean")
    present = frame(spark, [{"site_id": "s", "content_id": i, "present_path": p, "written_at": w} for i, p, w in (
        (1, "p1.md", T0), (2, "old.md", T0), (3, "p3.md", T0 - day), (5, "x.md", T0), (9, "p9.md", T0))],
                    "site_id string, content_id bigint, present_path string, written_at timestamp_ntz")
    actions = {r["content_id"]: r["action"] for r in publish.mirror_delta(content, present, newest=None).collect()}
    assert actions == {1: "keep", 2: "move", 3: "rewrite", 4: "write", 5: "delete", 6: "none", 9: "delete"}
    recent = {r["content_id"] for r in publish.mirror_delta(content, present, newest=2).collect()}
    assert recent == {5, 6}


def test_channel_documents(spark):
    import json

    from lucidex.operators import publish

    profile = normalise_profile(frame(spark, [
        {**SITE, "site_name": "My\r\nSite", "home_url": "https://h.test/", "sitemap_url": "https://h.test/s.xml", "allow_training": True},
        {**SITE, "site_id": "t", "site_name": " ", "home_url": "https://h.test/", "markdown_enabled": False}], schemas.PROFILE))
    docs = {r["site_id"]: r for r in publish.channel_documents(profile).collect()}
    assert docs["s"]["ai_txt"].startswith("# ai.txt for My Site\n") and "Sitemap: https://h.test/s.xml\n" in docs["s"]["ai_txt"]
    assert docs["s"]["ai_txt"].endswith("Inference: allowed\nTraining: allowed\n")
    assert "# ai.txt for h.test\n" in docs["t"]["ai_txt"] and "Sitemap" not in docs["t"]["ai_txt"]
    assert json.loads(docs["t"]["llms_policy"]) == {
        "version": 1, "organization": "h.test", "website": "https://h.test/", "llms_txt": "https://h.test/llms.txt",
        "policy": {"allow_inference": True, "allow_training": False}}
    assert json.loads(docs["t"]["ai_layer"])["channels"]["markdown_views"] is False
