"""Why/fix lines per sub-score: from rules, and from model replies behind a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.functions import text as tx
from lucidex.operators.audit import ENGINE_NAME, LIST_MARK
from lucidex.operators.guard import allowed_entities, allowed_numbers, line_is_safe

#: The why and fix sentences, by sub-score and case; %d and %s as usual.
RULE_TEXT = {
    "discoverability": {
        "conflict": (
            "Another plugin is overriding the /llms.txt rewrite rule, so agents may hit a stale index.",
            f"Deactivate the conflicting plugin or move it after {ENGINE_NAME} in load order, then re-test /llms.txt."),
        "static_robots": (
            "A static robots.txt file is present, so the /llms.txt reference is not added automatically — agents "
            "that read robots.txt are not pointed to your index.",
            f"Add this line to your static robots.txt manually: # AI-readable content index "
            f"({ENGINE_NAME.lower()}): %s"),
        "good": (
            "Working well — /llms.txt is populated and exposed CPTs are configured, so agents can find the content "
            "surface.",
            "Keep the Context Profile in sync as new CPTs are added."),
        "empty": (
            "The /llms.txt cache is empty, so agents have nothing to discover at the site root.",
            f"Open the Context Profile and save it to seed /llms.txt, or run wp {ENGINE_NAME.lower()} llms-txt regen."),
        "no_types": (
            "No post types are exposed to agents, so /llms.txt has no surface to advertise.",
            "Open the Context Profile and add at least one post type to Exposed CPTs."),
        "no_entries": (
            "Exposed CPTs are configured but no published entries are reaching /llms.txt yet.",
            f"Publish at least one entry in an exposed CPT and run wp {ENGINE_NAME.lower()} llms-txt regen."),
        "partial": (
            "Partial — the index is populated but at least one discoverability signal is below target.",
            "Open the Context Profile and review Exposed CPTs and /llms.txt entry coverage."),
    },
    "content_readability": {
        "good": (
            "Working well — every exposed entry has a curated description for agents to read.",
            "Review descriptions on newly published entries during regular editorial passes."),
        "no_entries": (
            "No exposed entries — there is nothing for agents to read yet.",
            "Add at least one post type to Exposed CPTs in the Context Profile and publish a post."),
        "critical": ("Critical — only %d%% of exposed entries have a curated description.", ""),
        "partial": (
            "Partial — %d%% of exposed entries have a curated description; the rest fall back to the excerpt.", ""),
        "fix_on": ("", 'Open Context Profile → Descriptions and run "Regenerate stale descriptions" '
                       f"(or wp {ENGINE_NAME.lower()} llms-txt descriptions backfill)."),
        "fix_off": ("", "Enable auto-descriptions in Context Profile → Descriptions, then run "
                        '"Regenerate stale descriptions".'),
    },
    "schema_coverage": {
        "plugin": (
            "Working well — an SEO plugin (%s) is emitting structured data alongside published content.",
            "Audit JSON-LD output on key landing pages once per release."),
        "native": (
            "Working well — the plugin emits native JSON-LD (WebSite, Organization, per-content), so agents get "
            "structured data without an SEO plugin.",
            "Audit the native JSON-LD output on key landing pages once per release."),
        "none": (
            "No structured data was detected. Exposed content reaches agents without schema metadata for now.",
            "Enable Schema emission in the Context Profile to emit native JSON-LD, or rely on an SEO plugin to fill "
            "the gap."),
    },
    "exposure_safety": {
        "good": (
            "Working well — only published content is exposed and Exposed CPTs are configured explicitly.",
            "Re-audit Exposed Statuses when new post statuses are introduced by other plugins."),
        "risky": (
            "%d non-publish status is exposed to agents, which can leak unpublished content.",
            "Open the Context Profile and reduce Exposed Statuses to publish only."),
        "no_types": (
            "No CPTs are exposed, which is safe by default but means agents will find nothing.",
            "Open the Context Profile and add at least one post type to Exposed CPTs."),
        "partial": (
            "Partial — at least one exposure signal is below target.",
            "Open the Context Profile and review Exposed CPTs and Exposed Statuses."),
    },
    "integration_health": {
        "good_on": (
            "Working well — the AI Client is configured and the enabled LLM features have a backend to call.",
            "Re-run this check after toggling any LLM feature in the Context Profile."),
        "good_off": (
            "Working well — LLM features are off, so no AI Client is required.",
            "Re-run this check after toggling any LLM feature in the Context Profile."),
        "unconfigured": (
            "LLM features are enabled but the AI Client is unconfigured, so those features silently degrade.",
            "Configure the AI Client in WordPress Settings, or disable the LLM toggles in the Context Profile."),
        "conflict": (
            "%d /llms.txt conflict was detected with another plugin.",
            "Open Tools → Context and follow the conflict notice to resolve the override."),
        "partial": (
            "Partial — at least one integration signal is below target.",
            "Open the Context Profile and verify the AI Client status and /llms.txt conflicts."),
    },
    "md_conversion_quality": {
        "good": (
            "Working well — Markdown conversion quality is at the ceiling across the cached posts.",
            "Re-run the audit after large editorial passes to catch drift."),
        "no_rows": (
            "No Markdown Views cache rows yet, so there is nothing to evaluate.",
            "Visit a few .md URLs on the site to populate the cache, then recompute."),
        "empty": (
            "%d%% of %d sampled .md bodies (of %d cached) are empty or near-empty — agents get no usable content "
            "there.", ""),
        "noisy": (
            "%d%% of %d sampled .md bodies (of %d cached) are dominated by non-prose noise — agents ingest junk "
            "there.", ""),
        "fix_worst": ("", "Fix the source content of the worst pages first (%s) so each .md serves real text, then "
                          "recompute."),
        "fix_any": ("", "Fix the source content of the empty/noisy pages so each .md serves real text, then "
                        "recompute."),
        "critical": (
            "Critical — mean Markdown quality is %d/100 and only %d%% of cached posts are above the MD-quality "
            "threshold.",
            "Improve the source HTML of the lowest-quality posts — cleaner heading structure, fewer nested wrappers "
            "and shortcodes — so the deterministic Markdown conversion scores higher, then recompute."),
        "partial": (
            "Partial — mean Markdown quality is %d/100; %d%% of cached posts are above the MD-quality threshold.",
            "Tidy the source HTML of the posts scoring below the threshold — simpler markup converts to cleaner "
            "Markdown — then recompute."),
    },
    "multi_channel_discovery": {
        "good_provider": (
            "Working well — every plugin-served discovery channel is published and %s is coordinating multi-channel "
            "coverage.",
            "Re-audit after adding or removing sibling AI-readiness plugins to keep coverage consistent."),
        "good": (
            "Working well — every plugin-served discovery channel is published.",
            "Re-audit after adding or removing sibling AI-readiness plugins to keep coverage consistent."),
        "none": (
            "No agent-discovery channels detected — agents that scan ai.txt or /.well-known/ declarations will miss "
            "this site.",
            "Open the Context Profile and save it to seed /llms.txt as a first discovery channel."),
        "partial_provider": (
            "Partial — %d of 4 plugin-served discovery channels detected; %s is contributing to coverage.",
            "Enable the missing channels (ai.txt, ai-layer, llms-policy.json) in the Context Profile. OpenAPI is an "
            "optional bonus for API sites."),
        "partial": (
            "Partial — %d of 4 plugin-served discovery channels detected.",
            "Enable the missing channels (ai.txt, ai-layer, llms-policy.json) in the Context Profile. OpenAPI is an "
            "optional bonus for API sites."),
    },
    "unknown": {
        "any": (
            'Sub-score "%s" scored %d/100; no template is configured for this sub-score yet.',
            "Review the raw signals in the Full breakdown panel."),
    },
}

PAIR = "struct<why:string,fix:string>"


def _fact(name: str) -> Column:
    return F.try_element_at("_facts", F.lit(name))


def _int(name: str) -> Column:
    return F.coalesce(_fact(name).try_cast("int"), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(_fact(name) == "true", F.lit(False))


def _words(name: str) -> Column:
    return F.coalesce(_fact(name), F.lit(""))


def _pair(area: str, case: str, why_args: tuple = (), fix_args: tuple = ()) -> Column:
    why, fix = RULE_TEXT[area][case]
    return F.struct(
        (F.format_string(why, *why_args) if why_args else F.lit(why)).alias("why"),
        (F.format_string(fix, *fix_args) if fix_args else F.lit(fix)).alias("fix"))


def _with_fix(pair: Column, fix: Column) -> Column:
    return F.struct(pair["why"].alias("why"), fix["fix"].alias("fix"))


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F.when(*cases[0])
    for condition, pair in cases[1:]:
        chain = chain.when(condition, pair)
    return chain.otherwise(otherwise)


def _rules() -> dict[str, Column]:
    """The pair of every sub-score, as one expression over ``value`` and the facts."""
    value = F.col("value")
    full = value >= 100
    populated = _flag("index_populated")
    area = "discoverability"
    rules = {area: _first([
        (_flag("rewrite_conflicted"), _pair(area, "conflict")),
        (populated & _flag("advertise_enabled") & _flag("static_robots"),
         _pair(area, "static_robots", (), (_words("index_url"),))),
        (full, _pair(area, "good")),
        (~populated, _pair(area, "empty")),
        (_int("exposed_types") <= 0, _pair(area, "no_types")),
        (_int("entry_count") <= 0, _pair(area, "no_entries")),
    ], _pair(area, "partial"))}

    area = "content_readability"
    fix = F.when(_flag("descriptions_enabled"), _pair(area, "fix_on")).otherwise(_pair(area, "fix_off"))
    pct = (_int("coverage_pct"),)
    rules[area] = _first([
        (full, _pair(area, "good")),
        (_int("total_entries") <= 0, _pair(area, "no_entries")),
        (value < 50, _with_fix(_pair(area, "critical", pct), fix)),
    ], _with_fix(_pair(area, "partial", pct), fix))

    area = "schema_coverage"
    rules[area] = _first([
        (full & (_words("seo_plugin") != ""), _pair(area, "plugin", (_words("seo_plugin"),))),
        (full & _flag("native_enabled"), _pair(area, "native")),
    ], _pair(area, "none"))

    area = "exposure_safety"
    rules[area] = _first([
        (full, _pair(area, "good")),
        (_int("risky_statuses") > 0, _pair(area, "risky", (_int("risky_statuses"),))),
        (_int("exposed_types") <= 0, _pair(area, "no_types")),
    ], _pair(area, "partial"))

    area = "integration_health"
    wanted = _flag("descriptions_enabled")
    rules[area] = _first([
        (full & wanted, _pair(area, "good_on")),
        (full, _pair(area, "good_off")),
        (wanted & ~_flag("client_configured"), _pair(area, "unconfigured")),
        (_int("conflict_count") > 0, _pair(area, "conflict", (_int("conflict_count"),))),
    ], _pair(area, "partial"))

    area = "md_conversion_quality"
    empty, noisy = _int("empty_pct"), _int("noisy_pct")
    seen = (_int("sampled"), _int("rows_total"))
    quality = (_int("mean_quality"), _int("above_threshold_pct"))
    titles = F.array_join(F.slice(F.filter(
        F.transform(F.split(_words("worst_titles"), LIST_MARK), tx.trim), lambda t: t != ""), 1, 2), ", ")
    repair = F.when(titles != "", _pair(area, "fix_worst", (), (titles,))).otherwise(_pair(area, "fix_any"))
    rules[area] = _first([
        (full, _pair(area, "good")),
        (_int("rows_total") <= 0, _pair(area, "no_rows")),
        ((empty > 0) & (empty >= noisy), _with_fix(_pair(area, "empty", (empty, *seen)), repair)),
        (noisy > 0, _with_fix(_pair(area, "noisy", (noisy, *seen)), repair)),
        (value < 50, _pair(area, "critical", quality)),
    ], _pair(area, "partial", quality))

    area = "multi_channel_discovery"
    provider = _words("provider_name")
    present = _int("surfaces_present")
    rules[area] = _first([
        (full & (provider != ""), _pair(area, "good_provider", (provider,))),
        (full, _pair(area, "good")),
        (value <= 0, _pair(area, "none")),
        (provider != "", _pair(area, "partial_provider", (present, provider))),
    ], _pair(area, "partial", (present,)))
    return rules


def rule_narrative(scores: DataFrame) -> DataFrame:
    """Why and fix per sub-score from the first matching rule, at most 140 bytes each."""
    rows = scores.withColumn("_facts", F.map_from_entries("facts"))
    cases = [(F.col("name") == name, pair) for name, pair in _rules().items()]
    chosen = _first(cases, _pair("unknown", "any", (F.col("name"), F.col("value"))))
    return (rows.withColumn("_pair", chosen)
            .withColumns({"why": tx.clip_line(F.col("_pair.why")), "fix": tx.clip_line(F.col("_pair.fix"))})
            .drop("_facts", "_pair"))


def parse_reply(reply: Column) -> Column:
    """Model reply to map name -> (why, fix); incomplete pairs go; nothing left is null."""
    body = tx.trim(reply)
    fenced = body.startswith("```")
    opened = F.regexp_replace(body, r"(?s)\A```[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"(?s)\A(.*)```.*\z", "$1")
    text = F.when(fenced, tx.trim(closed)).otherwise(body)
    # Two levels, so that one malformed entry does not take the others with it.
    entries = F.from_json(text, "map<string,string>")
    pairs = F.transform_values(entries, lambda _, v: F.from_json(v, PAIR))
    cleaned = F.transform_values(pairs, lambda _, v: F.struct(
        tx.trim(F.coalesce(v["why"], F.lit(""))).alias("why"),
        tx.trim(F.coalesce(v["fix"], F.lit(""))).alias("fix")))
    whole = F.map_filter(cleaned, lambda _, v: (v["why"] != "") & (v["fix"] != ""))
    lines = F.transform_values(whole, lambda _, v: F.struct(
        tx.sanitise_line(v["why"]).alias("why"), tx.sanitise_line(v["fix"]).alias("fix")))
    return F.when(F.size(lines) > 0, lines)


def guarded_narrative(ruled: DataFrame, replies: DataFrame) -> DataFrame:
    """Model lines where both are safe, rule lines elsewhere, with the site's mode.

    *ruled* is :func:`rule_narrative` output, *replies* has ``site_id, reply`` with one
    row per site.
    """
    parsed = replies.select("site_id", parse_reply(F.col("reply")).alias("_pairs"))
    rows = ruled.join(parsed, "site_id", "left").withColumn("_pair", F.try_element_at("_pairs", F.col("name")))
    rows = rows.withColumns({"_numbers": allowed_numbers(), "_entities": allowed_entities()})
    safe = F.col("_pair").isNotNull()
    for line in ("why", "fix"):
        safe = safe & line_is_safe(F.col(f"_pair.{line}"), F.col("_numbers"), F.col("_entities"))
    rows = rows.withColumn("_kept", F.coalesce(safe, F.lit(False)))
    modes = rows.groupBy("site_id").agg(F.count_if("_kept").alias("_n"), F.count(F.lit(1)).alias("_all"))
    mode = (F.when(F.col("_n") == 0, F.lit("rule_based")).when(F.col("_n") == F.col("_all"), F.lit("llm"))
            .otherwise(F.lit("mixed")))
    out = rows.join(modes, "site_id")
    kept = F.col("_kept")
    return out.select(
        "site_id", "name",
        F.when(kept, F.col("_pair.why")).otherwise(F.col("why")).alias("why"),
        F.when(kept, F.col("_pair.fix")).otherwise(F.col("fix")).alias("fix"),
        F.when(kept, F.lit("llm")).otherwise(F.lit("rule_based")).alias("source"),
        mode.alias("mode"),
        (F.col("_n") == 0).alias("degraded"))
