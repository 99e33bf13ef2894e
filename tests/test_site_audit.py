"""From tables to scores: the job, and what tables say against what a profile says."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucidex.operators import audit
from lucidex.plans import jobs
from lucidex.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


def test_the_job_goes_from_tables_to_scores(spark, tmp_path):
    inputs, out = Inputs(spark, SF), str(tmp_path / "audit")
    by_site = lambda rows: rows.withColumn("site_id", F.regexp_extract("site_id", r"([^.]+\.[^.]+)$", 1))
    jobs.audit_tables(inputs.profile, by_site(inputs.sample("active_plugins")).distinct(), by_site(inputs.sample("root_files")), by_site(inputs.conflicts),
                      inputs.rows, inputs.store, inputs.content, out, "2024-02-01")
    sites = inputs.profile.count()
    signals = spark.read.parquet(f"{out}/signals")
    assert signals.count() == sites and set(audit.SIGNAL_COLUMNS) <= set(signals.columns)
    assert spark.read.parquet(f"{out}/sub_scores").count() == 7 * sites
    assert spark.read.parquet(f"{out}/overall").filter("overall BETWEEN 0 AND 100").count() == sites


def test_tables_decide_posture_and_channels(spark):
    profile = Inputs(spark, SF).profile.limit(1).withColumns({"site_id": F.lit("a.com"), "seo_posture": F.lit("yoast"), "channels_enabled": F.lit(False)})
    store = spark.createDataFrame([("a.com", 1, "words " * 20, 80)], "site_id string, content_id bigint, markdown string, quality_score int")
    content = spark.createDataFrame([("a.com", 1, "T", "https://a.com/1")], "site_id string, content_id bigint, title string, permalink string")
    index = spark.createDataFrame([("a.com", 5, 4, 2)], "site_id string, entry_count bigint, total_entries bigint, entries_with_description bigint")
    conflicts = spark.createDataFrame([("a.com", "rewrite", 7), ("a.com", "plugin", 2), ("a.com", "plugin", 9)], "site_id string, kind string, seen_order int")
    none = spark.createDataFrame([], "site_id string, posture string")
    provider = spark.createDataFrame([("a.com", "ai_layer", "AI Layer", "u")], "site_id string, provider_slug string, provider_name string, provider_config_url string")
    probes = audit.probed_files(spark.createDataFrame([("a.com", "/llms.txt")] * 5, "site_id string, path string"))
    row = audit.signals_from_tables(profile, none, provider, probes, conflicts, index, store, content).first()
    assert row["seo_plugin"] == "" and row["conflict_kinds"] == ["plugin", "rewrite"] and row["conflict_count"] == 3  # in the order they were seen
    assert (row["ai_txt_present"], row["ai_layer_present"], row["policy_present"], row["openapi_present"]) == (True, True, True, True)
    assert row["provider_config_url"] == "u" and row["worst_refs"] == ["1 https://a.com/1"]
    posture = spark.createDataFrame([("a.com", "aioseo")], "site_id string, posture string")
    bare = audit.signals_from_tables(profile, posture, provider.limit(0), probes.limit(0), conflicts.limit(0), index, store, content).first()
    assert bare["seo_plugin"] == "aioseo" and bare["provider_slug"] is None and not bare["ai_txt_present"] and bare["conflict_kinds"] == []
