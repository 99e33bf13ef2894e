"""Sub-scores, reasons, narrative and guard on hand-made signals."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lucidex.operators import audit, conflicts as cf, guard, narrative

SCHEMA = ("site_id string, exposed_types array<string>, exposed_statuses array<string>, descriptions_enabled boolean, "
          "advertise_enabled boolean, structured_data_enabled boolean, index_populated boolean, entry_count bigint, "
          "conflict_kinds array<string>, conflict_count bigint, static_robots boolean, index_url string, rows_total bigint, "
          "rows_with_score bigint, mean_quality double, rows_above_threshold bigint, sampled bigint, empty_ratio double, "
          "noisy_ratio double, worst_titles array<string>, worst_refs array<string>, seo_plugin string, client_configured boolean, "
          "total_entries bigint, entries_with_description bigint, ai_txt_present boolean, ai_layer_present boolean, "
          "policy_present boolean, openapi_present boolean, provider_slug string, provider_name string, provider_config_url string")
BEST = dict(exposed_types=["post"], exposed_statuses=["publish"], descriptions_enabled=True, advertise_enabled=True,
            structured_data_enabled=False, index_populated=True, entry_count=24, conflict_kinds=[], conflict_count=0,
            static_robots=False, index_url="https://x/llms.txt", rows_total=10, rows_with_score=10, mean_quality=100.0,
            rows_above_threshold=10, sampled=10, empty_ratio=0.0, noisy_ratio=0.0, worst_titles=[], worst_refs=[],
            seo_plugin="yoast", client_configured=True, total_entries=24, entries_with_description=24, ai_txt_present=True,
            ai_layer_present=True, policy_present=True, openapi_present=False, provider_slug=None, provider_name=None,
            provider_config_url=None)

#: name -> (changed signals, sub-score, value, first reason code or None)
CASES = {
    "empty index": (dict(index_populated=False, entry_count=0), "discoverability", 35, "disc_llms_txt_empty"),
    "rewrite": (dict(conflict_kinds=["rewrite"], conflict_count=1), "discoverability", 90, "disc_llms_txt_populated"),
    "nothing exposed": (dict(exposed_types=[], index_populated=False, entry_count=0), "discoverability", 10, None),
    "half described": (dict(entries_with_description=12), "content_readability", 50, "cr_coverage_medium"),
    "few described": (dict(entries_with_description=1), "content_readability", 4, "cr_coverage_low"),
    "over described": (dict(entries_with_description=99), "content_readability", 100, "cr_coverage_good"),
    "no entries": (dict(total_entries=0), "content_readability", 0, "cr_no_exposed_entries"),
    "native schema": (dict(seo_plugin="", structured_data_enabled=True), "schema_coverage", 100, "sc_native_jsonld"),
    "no schema": (dict(seo_plugin=""), "schema_coverage", 60, "sc_no_structured_data"),
    "one risky": (dict(exposed_statuses=["publish", "draft"]), "exposure_safety", 85, "es_risky_statuses"),
    "all risky": (dict(exposed_statuses=["draft", "private", "pending", "password", "x"]), "exposure_safety", 40, None),
    "safe but empty": (dict(exposed_types=[]), "exposure_safety", 60, "es_only_published"),
    "no client": (dict(client_configured=False), "integration_health", 40, "ih_llm_unconfigured"),
    "features off": (dict(client_configured=False, descriptions_enabled=False), "integration_health", 100, "ih_llm_disabled"),
    "conflict": (dict(conflict_kinds=["plugin"], conflict_count=2), "integration_health", 60, "ih_llm_configured"),
    "no rows": (dict(rows_total=0), "md_conversion_quality", 0, "mcq_no_cache"),
    "none scored": (dict(rows_with_score=0, rows_above_threshold=0), "md_conversion_quality", 0, "mcq_no_cache"),
    "middling": (dict(mean_quality=66.9, rows_above_threshold=3), "md_conversion_quality", 51, "mcq_mean_quality"),
    "empty bodies": (dict(empty_ratio=0.5, noisy_ratio=0.25), "md_conversion_quality", 72, None),
    "clamped": (dict(mean_quality=10.0, rows_above_threshold=0, empty_ratio=1.0), "md_conversion_quality", 0, None),
    "two channels": (dict(ai_txt_present=False, policy_present=False, openapi_present=True), "multi_channel_discovery", 50,
                     "mcd_channels_detected"),
    "no channels": (dict(index_populated=False, ai_txt_present=False, ai_layer_present=False, policy_present=False),
                    "multi_channel_discovery", 0, "mcd_no_channels"),
}


def signals(spark, rows):
    names = [part.split()[0] for part in SCHEMA.replace("array<string>", "x").split(", ")]
    return spark.createDataFrame([tuple({**BEST, **over, "site_id": sid}[n] for n in names) for sid, over in rows], SCHEMA)


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(name, over) for name, (over, *_) in CASES.items()] + [("best", {})]
    return audit.sub_scores(signals(spark, rows)).cache()


@pytest.fixture(scope="module")
def by_site(scores):
    return {(r["site_id"], r["name"]): r for r in scores.collect()}


@pytest.mark.parametrize("case", CASES)
def test_sub_score(by_site, case):
    _, name, value, code = CASES[case]
    row = by_site[(case, name)]
    assert row["value"] == value
    assert code is None or row["reasons"][0]["code"] == code


def test_weights_and_best(scores):
    assert sum(audit.WEIGHTS.values()) == 100
    overall = {r["site_id"]: r["overall"] for r in audit.overall(scores).collect()}
    assert overall["best"] == 100
    assert overall["no client"] == 91 and overall["no rows"] == 75
    best = {r["site_id"]: r for r in audit.leverage(scores).collect()}
    assert (best["best"]["best_name"], best["best"]["below_target"]) == ("", 0)
    assert best["no client"]["best_name"] == "integration_health" and best["no client"]["best_label"] == "integration health"


def test_leverage_tie_takes_first_name(spark):
    rows = spark.createDataFrame([("s", "b_x", 50, 10), ("s", "a_x", 50, 10), ("s", "c", 100, 80)],
                                 "site_id string, name string, value int, weight int")
    row = audit.leverage(rows).first()
    assert (row["best_name"], row["best_label"], row["below_target"]) == ("a_x", "a x", 2)


def test_health(spark, scores):
    sites = spark.createDataFrame([("best",), ("no rows",), ("ghost",)], "site_id string")
    rows = {r["site_id"]: (r["status"], r["badge"]) for r in
            audit.health(sites, audit.overall(scores), audit.leverage(scores)).collect()}
    assert rows == {"best": ("good", "green"), "no rows": ("recommended", "orange"), "ghost": ("recommended", "gray")}


def test_reason_text(by_site):
    texts = [r["text"] for r in by_site[("half described", "content_readability")]["reasons"]]
    assert texts == ["50% of exposed entries have a curated description — room to improve."]
    noisy = [r["text"] for r in by_site[("empty bodies", "md_conversion_quality")]["reasons"]]
    assert noisy[2].startswith("50% of 10 sampled .md bodies are empty")
    assert noisy[3].startswith("25% of 10 sampled .md bodies are dominated")


def test_rule_narrative(scores):
    rows = {(r["site_id"], r["name"]): r for r in narrative.rule_narrative(scores).collect()}
    assert rows[("best", "discoverability")]["why"].startswith("Working well")
    assert rows[("rewrite", "discoverability")]["why"].startswith("Another plugin is overriding")
    assert rows[("few described", "content_readability")]["why"] == (
        "Critical — only 4% of exposed entries have a curated description.")
    assert rows[("conflict", "integration_health")]["why"] == "2 /llms.txt conflict was detected with another plugin."
    assert rows[("two channels", "multi_channel_discovery")]["why"].startswith("Partial — 2 of 4")
    assert rows[("empty bodies", "md_conversion_quality")]["why"].startswith("50% of 10 sampled .md bodies (of 10")
    for row in rows.values():
        assert len(row["why"].encode()) <= 142 and len(row["fix"].encode()) <= 142


def test_unknown_sub_score(spark):
    rows = spark.createDataFrame([("s", "new_one", 7)], "site_id string, name string, value int").withColumn(
        "facts", F.array(F.struct(F.lit("a").alias("name"), F.lit("b").alias("value"))))
    assert narrative.rule_narrative(rows).first()["why"] == (
        'Sub-score "new_one" scored 7/100; no template is configured for this sub-score yet.')


#: (value, weight, facts, reasons, line, safe)
GUARD = [
    (50, 15, {"coverage_pct": "50", "total": "24"}, [], "Coverage is at 50%, with 24 entries total.", True),
    (50, 15, {"coverage_pct": "50"}, [], "Coverage is at 80% across entries.", False),
    (60, 10, {"seo_plugin": ""}, ["No structured data detected."], "Install Yoast SEO to emit data.", False),
    (60, 10, {}, ["Detected SEO plugin (Yoast SEO) — fine."], "Keep Yoast SEO active.", True),
    (0, 0, {}, [], "Open the Context Profile and review it.", True),
    (50, 15, {}, [], "Partial coverage. Critical paths need attention.", True),
    (60, 25, {}, [], "Mean quality is 60/100.", True),
    (60, 25, {}, [], "Mean quality is 61/100.", False),
    (50, 15, {"flag": "true", "off": "false"}, [], "1 on and 0 off.", True),
    (50, 15, {}, ["Only 33% of them."], "33% of them at weight 15.", True),
    (50, 15, {}, [], "All is at 50 but 7 is not.", False),
    (50, 15, {}, [], "Acme Booster helps at the start.", True),
    (50, 15, {}, [], "Try it. Acme Booster helps after a stop.", True),
    (50, 15, {}, [], "Please use Acme Booster now.", False),
]


def test_guard(spark):
    rows = [(i, v, w, [(k, x) for k, x in f.items()], [(t,) for t in r], line) for i, (v, w, f, r, line, _) in enumerate(GUARD)]
    frame = spark.createDataFrame(rows, "i int, value int, weight int, facts array<struct<name:string,value:string>>, "
                                        "reasons array<struct<text:string>>, line string")
    safe = guard.line_is_safe(F.col("line"), guard.allowed_numbers(), guard.allowed_entities())
    got = [r["safe"] for r in frame.select("i", safe.alias("safe")).orderBy("i").collect()]
    assert got == [case[5] for case in GUARD]


def test_sentence_starts(one):
    assert one(guard.lower_sentence_starts, "  Ab Cd. Ef Gh! Ij? kl") == "  ab Cd. ef Gh! ij? kl"


def test_parse_reply(spark):
    good = {"a": {"why": " W ", "fix": "<b>F</b>"}}
    texts = [json.dumps(good), "```json\n" + json.dumps(good) + "\n```", json.dumps({**good, "b": {"why": "x"}, "c": 5, "d": "t"}),
             "[1]", "nope", "", json.dumps({"a": {"why": "", "fix": "x"}}), json.dumps({"a": {"why": "é" * 80, "fix": "F"}})]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["p"] for r in rows.select("i", narrative.parse_reply(F.col("t")).alias("p")).orderBy("i").collect()]
    for parsed in got[:3]:
        assert {k: tuple(v) for k, v in parsed.items()} == {"a": ("W", "F")}
    assert got[3:7] == [None] * 4
    assert got[7]["a"]["why"] == "é" * 69 + "…"


def test_guarded_merge(spark, scores):
    ruled = narrative.rule_narrative(scores.filter(F.col("site_id").isin("best", "no client", "no rows")))
    names = list(audit.WEIGHTS)
    safe = {"why": "All is well.", "fix": "Keep going."}
    replies = spark.createDataFrame([
        ("best", json.dumps({n: safe for n in names})),
        ("no client", json.dumps({names[0]: safe, names[1]: {"why": "99999 things.", "fix": "x"}})),
        ("no rows", "broken")], "site_id string, reply string")
    rows = narrative.guarded_narrative(ruled, replies).collect()
    modes = {r["site_id"]: (r["mode"], r["degraded"]) for r in rows}
    assert modes == {"best": ("llm", False), "no client": ("mixed", False), "no rows": ("rule_based", True)}
    kept = {(r["site_id"], r["name"]) for r in rows if r["source"] == "llm"}
    assert len(kept) == 8 and ("no client", names[1]) not in kept


def test_fingerprint_ignores_order(spark):
    rows = [("s", "plugin", 0, "a/a.php", "A", "u", "h", None, None), ("s", "rewrite", 9, None, None, None, None, None, "r"),
            ("t", "plugin", 0, "b/b.php", "B", "u", "h", None, None)]
    schema = ("site_id string, kind string, seen_order bigint, slug string, name string, url string, shape string, "
              "path string, rule string")
    first = {r["site_id"]: r["fingerprint"] for r in cf.fingerprints(spark.createDataFrame(rows, schema)).collect()}
    again = {r["site_id"]: r["fingerprint"] for r in cf.fingerprints(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert first == again and first["s"] != first["t"] and len(first["s"]) == 40


def test_coverage(one):
    matrix = {"a": ("WebPage", "Article"), "all": cf.SCHEMA_BASELINE, "none_of": ()}
    cases = {"": 4, "none": 4, "a": 2, "all": 0, "none_of": 4, "stranger": 4}
    for posture, size in cases.items():
        gap = one(lambda p: cf.coverage_gap(p, matrix=matrix), posture)
        deferred = one(lambda p: cf.coverage_deferred(p, matrix=matrix), posture)
        assert len(gap) == size and len(deferred) == 4 - size and gap == [t for t in cf.SCHEMA_BASELINE if t in gap]
