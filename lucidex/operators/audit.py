"""The readiness audit: signals per site, seven sub-scores, reasons, overall."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.functions.safety import body_is_empty, body_is_noisy
from lucidex.operators.skew import top_per_group

#: Weights, thresholds and deductions.
WEIGHTS = {
    "discoverability": 10,
    "content_readability": 15,
    "schema_coverage": 10,
    "exposure_safety": 15,
    "integration_health": 15,
    "md_conversion_quality": 25,
    "multi_channel_discovery": 10,
}
QUALITY_THRESHOLD = 70
EMPTY_DEDUCTION = 40
NOISE_DEDUCTION = 30
GOOD_FROM, CRITICAL_BELOW = 80, 50
WORST_LIMIT = 5
SAMPLE_LIMIT = 50

#: How a sub-score is called in text.
LABELS = {
    "discoverability": "discoverability",
    "content_readability": "description coverage",
    "schema_coverage": "schema coverage",
    "exposure_safety": "exposure safety",
    "integration_health": "integration health",
    "md_conversion_quality": "Markdown conversion quality",
    "multi_channel_discovery": "multi-channel discovery",
}

#: The name used for this engine in reason and narrative texts.
ENGINE_NAME = "Lucidex"

#: Reason texts; %d and %s take the arguments in order.
REASONS = {
    "disc_llms_txt_populated": "/llms.txt cache is populated.",
    "disc_llms_txt_empty": "/llms.txt cache is empty — agents cannot discover the site index.",
    "disc_cpt_exposed": "Site exposes %d post type(s) to agents.",
    "disc_no_cpt_exposed": "No post types are exposed to agents (Context Profile → Exposed CPTs is empty).",
    "disc_entries_listed": "/llms.txt lists %d entries.",
    "disc_zero_entries": "/llms.txt has zero entries.",
    "disc_rewrite_conflict": "Another plugin is overriding the /llms.txt rewrite rule.",
    "cr_no_exposed_entries": "No exposed entries — nothing for agents to read.",
    "cr_coverage_good": "%d%% of exposed entries have a curated description.",
    "cr_coverage_medium": "%d%% of exposed entries have a curated description — room to improve.",
    "cr_coverage_low": "Only %d%% of exposed entries have a curated description.",
    "sc_seo_plugin_detected": "Detected SEO plugin (%s) — structured data is likely being emitted.",
    "sc_native_jsonld": ENGINE_NAME + " is emitting native JSON-LD (WebSite + Organization + per-content). "
                        "Schema coverage satisfied without a third-party SEO plugin.",
    "sc_no_structured_data": "No structured data detected on this site. Enable Schema emission in the Context "
                             "Profile to have " + ENGINE_NAME + " emit native JSON-LD, or rely on a third-party "
                             "SEO plugin.",
    "es_only_published": "Only published content is exposed to agents.",
    "es_risky_statuses": "Exposed statuses include %s — these can leak unpublished content to agents.",
    "es_cpt_explicit": "Exposed CPTs are configured explicitly (no implicit defaults).",
    "es_no_cpt": "No CPTs exposed — safe-by-default, but agents will find nothing.",
    "ih_llm_unconfigured": "LLM features enabled but AI client is unconfigured — those features are silently "
                           "degraded.",
    "ih_llm_configured": "AI client configured and LLM features enabled.",
    "ih_llm_disabled": "LLM features disabled — no AI client required.",
    "ih_llms_txt_conflict": "/llms.txt conflict detected (%s).",
    "mcq_no_cache": "No Markdown Views cache rows yet — visit a few `.md` URLs to populate the cache.",
    "mcq_mean_quality": "Mean Markdown quality across %d cached posts: %d/100.",
    "mcq_above_threshold": "%d%% of cached posts are above the MD-quality threshold (%d).",
    "mcq_empty_bodies": "%d%% of %d sampled .md bodies are empty or near-empty — agents get no usable content "
                        "there.",
    "mcq_noisy_bodies": "%d%% of %d sampled .md bodies are dominated by non-prose noise (encoded builder blobs / "
                        "leaked script).",
    "mcd_no_channels": "No agent-discovery channels detected — site is invisible to agents that scan for ai.txt "
                       "or /.well-known/ declarations.",
    "mcd_channels_detected": "%d of 4 plugin-served agent-discovery channel(s) detected.",
    "mcd_openapi_bonus": "OpenAPI spec detected — bonus discovery channel for sites exposing an API.",
    "mcd_provider_configurable": "%s detected — coordinating multi-channel discovery. Configure at %s",
    "mcd_provider_detected": "%s detected — coordinating multi-channel discovery.",
}

#: Joins list items inside one fact; no title holds it.
LIST_MARK = "\x1f"

SIGNAL_COLUMNS = (
    "exposed_types", "exposed_statuses", "descriptions_enabled", "advertise_enabled", "structured_data_enabled",
    "index_populated", "entry_count", "conflict_kinds", "conflict_count", "static_robots", "index_url",
    "rows_total", "rows_with_score", "mean_quality", "rows_above_threshold",
    "sampled", "empty_ratio", "noisy_ratio", "worst_titles", "worst_refs",
    "seo_plugin", "client_configured", "total_entries", "entries_with_description",
    "ai_txt_present", "ai_layer_present", "policy_present", "openapi_present",
    "provider_slug", "provider_name", "provider_config_url",
)


# --- per-site measures ---------------------------------------------------------------


def markdown_stats(store: DataFrame, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    score = F.col("quality_score")
    return store.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(score).alias("rows_with_score"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_quality"),
        F.count_if(score >= threshold).alias("rows_above_threshold"))


def body_quality(store: DataFrame) -> DataFrame:
    empty = body_is_empty(F.col("markdown"))
    return store.withColumns({
        "is_empty": empty,
        "is_noisy": ~empty & body_is_noisy(F.col("markdown")),
    })


def body_quality_rates(store: DataFrame, sample: int | None = None) -> DataFrame:
    """Shares of empty and noisy bodies per site.

    Every row is read; *sample* keeps the first rows by id, as a cheap estimate.
    """
    rows = store.select("site_id", "content_id", "markdown")
    if sample is not None:
        chosen = top_per_group(rows.select("site_id", "content_id"), ["site_id"], [F.asc("content_id")],
                               sample, ["content_id"]).drop("rank")
        rows = rows.join(chosen, ["site_id", "content_id"], "left_semi")
    return body_quality(rows).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("sampled"),
        F.avg(F.col("is_empty").cast("double")).alias("empty_ratio"),
        F.avg(F.col("is_noisy").cast("double")).alias("noisy_ratio"))


def worst_documents(store: DataFrame, content: DataFrame, limit: int = WORST_LIMIT) -> DataFrame:
    """The lowest scores per site with title and address, worst first."""
    scored = store.filter(F.col("quality_score").isNotNull() & (F.col("content_id") != 0)).select(
        "site_id", "content_id", "quality_score")
    ranked = top_per_group(scored, ["site_id"], [F.asc("quality_score"), F.asc("content_id")], limit, ["content_id"])
    return ranked.join(content.select("site_id", "content_id", "title", "permalink"), ["site_id", "content_id"])


def description_coverage(entries: DataFrame) -> DataFrame:
    return entries.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.coalesce("description", F.lit("")) != "").alias("entries_with_description"))


def channel_presence(probes: DataFrame, profile: DataFrame, providers: DataFrame) -> DataFrame:
    """Discovery channels of each site: a probed file, a provider or the own module."""
    rows = profile.join(probes, "site_id", "left").join(providers, "site_id", "left")
    own = F.coalesce("channels_enabled", F.lit(True))

    def seen(flag: str) -> Column:
        return F.coalesce(F.col(flag), F.lit(False))

    return rows.select(
        "site_id",
        (seen("has_ai_txt") | own).alias("ai_txt_present"),
        (seen("has_ai_layer") | F.col("provider_slug").isNotNull() | own).alias("ai_layer_present"),
        (seen("has_policy") | own).alias("policy_present"),
        (seen("has_openapi_json") | seen("has_openapi_yaml") | seen("has_swagger")).alias("openapi_present"),
        "provider_slug", "provider_name", "provider_config_url")


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    """Conflicts per site: their number and the distinct kinds in first-seen order."""
    first = conflicts.groupBy("site_id", "kind").agg(
        F.min("seen_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("_first", "kind"))), lambda k: k["kind"])
    return first.groupBy("site_id").agg(kinds.alias("conflict_kinds"), F.sum("_n").alias("conflict_count"))


def assemble_signals(profile: DataFrame, index: DataFrame, conflicts: DataFrame, stats: DataFrame,
                     rates: DataFrame, worst: DataFrame, channels: DataFrame) -> DataFrame:
    """One row of signals per site; every input already has at most one row per site.

    *index* is :func:`lucidex.operators.site_index.index_measures`; *worst* has at most
    five rows per site.
    """
    ref = F.concat_ws(" ", F.col("content_id").cast("string"), "permalink").alias("ref")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "title", ref)))
    worst_titles = worst.groupBy("site_id").agg(
        F.transform(ordered, lambda w: w["title"]).alias("worst_titles"),
        F.transform(ordered, lambda w: w["ref"]).alias("worst_refs"))
    rows = profile.select(
        "site_id", "exposed_types", "exposed_statuses", "descriptions_enabled", "advertise_enabled",
        "structured_data_enabled", "static_robots", "client_configured",
        F.when(F.col("seo_posture") == "none", F.lit("")).otherwise(F.col("seo_posture")).alias("seo_plugin"),
        F.concat(F.col("home_url"), F.lit("llms.txt")).alias("index_url"))
    for part in (index, conflict_summary(conflicts), stats, rates, worst_titles, channels):
        rows = rows.join(part, "site_id", "left")
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in (
        "entry_count", "conflict_count", "rows_total", "rows_with_score", "rows_above_threshold", "sampled",
        "total_entries", "entries_with_description")}
    zero |= {name: F.coalesce(F.col(name), F.lit(0.0)) for name in ("mean_quality", "empty_ratio", "noisy_ratio")}
    none = F.array().cast("array<string>")
    return rows.withColumns({
        **zero,
        "conflict_kinds": F.coalesce("conflict_kinds", none),
        "worst_titles": F.coalesce("worst_titles", none),
        "worst_refs": F.coalesce("worst_refs", none),
        "index_populated": F.coalesce("entry_count", F.lit(0)) > 0,
    }).select("site_id", *SIGNAL_COLUMNS)


def probed_files(root_files: DataFrame) -> DataFrame:
    """What the files found at the roots of a site's hosts say about its channels; one row per site."""
    count = F.count(F.lit(1))
    return root_files.groupBy("site_id").agg(
        F.bool_or(F.col("path") == "/llms.txt").alias("has_ai_txt"), F.bool_or(F.col("path") == "/sub/llms.txt").alias("has_ai_layer"),
        (count > 3).alias("has_policy"), (count > 4).alias("has_openapi_json"), F.lit(False).alias("has_openapi_yaml"),
        (count == 1).alias("has_swagger"))


def signals_from_tables(profile: DataFrame, postures: DataFrame, providers: DataFrame, probes: DataFrame, conflicts: DataFrame,
                        index: DataFrame, store: DataFrame, content: DataFrame) -> DataFrame:
    """The signals of every site from its tables alone: nothing about a site is said by the profile that a table shows.

    *postures* (site_id, posture) is what the active plug-ins say, *providers* the sites' channel providers,
    *probes* the files found; a site without any has posture none and no provider.
    """
    found = profile.drop("seo_posture").join(postures.select("site_id", F.col("posture").alias("seo_posture")), "site_id", "left")
    found = found.withColumn("seo_posture", F.coalesce("seo_posture", F.lit("none")))
    return assemble_signals(found, index, conflicts, markdown_stats(store), body_quality_rates(store),
                            worst_documents(store, content), channel_presence(probes, profile, providers))


# --- sub-scores ----------------------------------------------------------------------


@dataclass(frozen=True)
class SubScore:
    """Value, reasons and the numbers behind them, as column expressions."""

    name: str
    value: Column
    reasons: list[Column]
    facts: list[Column]

    @property
    def weight(self) -> int:
        return WEIGHTS[self.name]


def clamp(value: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), value)).cast("int")


def reason(when: Column, code: str, *args: Column) -> Column:
    """A (code, args, text) struct where the condition holds, else null."""
    text = F.format_string(REASONS[code], *args) if args else F.lit(REASONS[code])
    given = F.array(*[a.cast("string") for a in args]) if args else F.array().cast("array<string>")
    return F.when(when, F.struct(F.lit(code).alias("code"), given.alias("args"), text.alias("text")))


def fact(name: str, value: Column) -> Column:
    """A named number or text of a sub-score, as text."""
    return F.struct(F.lit(name).alias("name"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def discoverability() -> SubScore:
    populated, entries = F.col("index_populated"), F.col("entry_count")
    types = F.size("exposed_types")
    rewritten = F.array_contains("conflict_kinds", "rewrite")
    value = (_points(populated, 50) + _points(types > 0, 25) + _points(entries > 0, 15) + _points(~rewritten, 10))
    return SubScore("discoverability", clamp(value), [
        reason(populated, "disc_llms_txt_populated"),
        reason(~populated, "disc_llms_txt_empty"),
        reason(types > 0, "disc_cpt_exposed", types),
        reason(types == 0, "disc_no_cpt_exposed"),
        reason(entries > 0, "disc_entries_listed", entries),
        reason(entries <= 0, "disc_zero_entries"),
        reason(rewritten, "disc_rewrite_conflict"),
    ], [
        fact("index_populated", populated), fact("exposed_types", types), fact("entry_count", entries),
        fact("rewrite_conflicted", rewritten), fact("static_robots", F.col("static_robots")),
        fact("advertise_enabled", F.col("advertise_enabled")), fact("index_url", F.col("index_url")),
    ])


def coverage_pct() -> Column:
    total = F.col("total_entries")
    described = F.least(F.col("entries_with_description"), total)
    return F.when(total > 0, F.floor(described * 100 / total)).otherwise(F.lit(0)).cast("int")


def content_readability() -> SubScore:
    total, pct = F.col("total_entries"), coverage_pct()
    described = F.least(F.col("entries_with_description"), total)
    return SubScore("content_readability", clamp(pct), [
        reason(total <= 0, "cr_no_exposed_entries"),
        reason((total > 0) & (pct >= 90), "cr_coverage_good", pct),
        reason((total > 0) & (pct >= 50) & (pct < 90), "cr_coverage_medium", pct),
        reason((total > 0) & (pct < 50), "cr_coverage_low", pct),
    ], [
        fact("total_entries", total), fact("entries_with_description", described), fact("coverage_pct", pct),
        fact("descriptions_enabled", F.col("descriptions_enabled")),
    ])


def schema_coverage() -> SubScore:
    plugin, native = F.col("seo_plugin"), F.col("structured_data_enabled")
    has_plugin = plugin != ""
    return SubScore("schema_coverage", F.when(has_plugin | native, F.lit(100)).otherwise(F.lit(60)), [
        reason(has_plugin, "sc_seo_plugin_detected", plugin),
        reason(~has_plugin & native, "sc_native_jsonld"),
        reason(~has_plugin & ~native, "sc_no_structured_data"),
    ], [fact("seo_plugin", plugin), fact("native_enabled", native)])


def risky_statuses() -> Column:
    return F.filter("exposed_statuses", lambda s: s != "publish")


def exposure_safety() -> SubScore:
    types, risky = F.size("exposed_types"), risky_statuses()
    count = F.size(risky)
    status_points = F.when(count == 0, F.lit(60)).otherwise(
        F.greatest(F.lit(0), F.lit(60) - F.least(F.lit(60), count * 15)))
    return SubScore("exposure_safety", clamp(status_points + _points(types > 0, 40)), [
        reason(count == 0, "es_only_published"),
        reason(count > 0, "es_risky_statuses", F.array_join(risky, ", ")),
        reason(types > 0, "es_cpt_explicit"),
        reason(types == 0, "es_no_cpt"),
    ], [
        fact("exposed_types", types), fact("exposed_statuses", F.array_join("exposed_statuses", ", ")),
        fact("risky_statuses", count),
    ])


def integration_health() -> SubScore:
    wanted, client, conflicts = F.col("descriptions_enabled"), F.col("client_configured"), F.col("conflict_count")
    value = _points(~wanted | client, 60) + _points(conflicts == 0, 40)
    return SubScore("integration_health", clamp(value), [
        reason(wanted & ~client, "ih_llm_unconfigured"),
        reason(wanted & client, "ih_llm_configured"),
        reason(~wanted, "ih_llm_disabled"),
        reason(conflicts > 0, "ih_llms_txt_conflict", F.array_join("conflict_kinds", ", ")),
    ], [
        fact("descriptions_enabled", wanted), fact("client_configured", client), fact("conflict_count", conflicts),
    ])


def _ratio(name: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name)))


def has_scores() -> Column:
    return (F.col("rows_total") > 0) & (F.col("rows_with_score") > 0)


def above_pct() -> Column:
    return F.floor(F.try_divide(F.col("rows_above_threshold") * 100, F.col("rows_with_score"))).cast("int")


def percent(name: str) -> Column:
    return F.when(has_scores(), F.round(_ratio(name) * 100)).otherwise(F.lit(0)).cast("int")


def md_conversion_quality() -> SubScore:
    scored, sampled = F.col("rows_with_score"), F.col("sampled")
    mean, above = F.floor("mean_quality").cast("int"), above_pct()
    empty_pct, noisy_pct = percent("empty_ratio"), percent("noisy_ratio")
    value = (F.floor(mean * 60 / 100) + F.floor(above * 40 / 100)
             - F.round(EMPTY_DEDUCTION * _ratio("empty_ratio")) - F.round(NOISE_DEDUCTION * _ratio("noisy_ratio")))
    some = has_scores()
    threshold = F.lit(QUALITY_THRESHOLD)
    return SubScore("md_conversion_quality", F.when(some, clamp(value)).otherwise(F.lit(0)), [
        reason(~some, "mcq_no_cache"),
        reason(some, "mcq_mean_quality", scored, mean),
        reason(some, "mcq_above_threshold", above, threshold),
        reason(some & (empty_pct > 0), "mcq_empty_bodies", empty_pct, sampled),
        reason(some & (noisy_pct > 0), "mcq_noisy_bodies", noisy_pct, sampled),
    ], [
        fact("rows_total", F.col("rows_total")), fact("rows_with_score", scored),
        fact("mean_quality", F.when(some, mean).otherwise(F.lit(0))),
        fact("rows_above_threshold", F.when(some, F.col("rows_above_threshold")).otherwise(F.lit(0))),
        fact("above_threshold_pct", F.when(some, above)), fact("threshold", threshold),
        fact("sampled", F.when(some, sampled)), fact("empty_pct", empty_pct), fact("noisy_pct", noisy_pct),
        fact("worst_titles", F.when(some, F.array_join("worst_titles", LIST_MARK))),
        fact("worst_refs", F.when(some, F.array_join("worst_refs", LIST_MARK))),
    ])


def channel_count() -> Column:
    names = ("index_populated", "ai_txt_present", "ai_layer_present", "policy_present")
    return sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int"))


def multi_channel_discovery() -> SubScore:
    present = channel_count()
    provider = F.col("provider_slug").isNotNull() & F.col("ai_layer_present")
    name = F.coalesce("provider_name", F.lit("Sibling provider"))
    address = F.coalesce("provider_config_url", F.lit(""))
    return SubScore("multi_channel_discovery", clamp(present * 25), [
        reason(present == 0, "mcd_no_channels"),
        reason(present > 0, "mcd_channels_detected", present),
        reason(F.col("openapi_present"), "mcd_openapi_bonus"),
        reason(provider & (address != ""), "mcd_provider_configurable", name, address),
        reason(provider & (address == ""), "mcd_provider_detected", name),
    ], [
        fact("index_populated", F.col("index_populated")), fact("ai_txt_present", F.col("ai_txt_present")),
        fact("ai_layer_present", F.col("ai_layer_present")), fact("policy_present", F.col("policy_present")),
        fact("openapi_present", F.col("openapi_present")), fact("surfaces_present", present),
        fact("provider_slug", F.col("provider_slug")), fact("provider_name", F.col("provider_name")),
        fact("provider_config_url", F.col("provider_config_url")),
    ])


ALL_SUB_SCORES = (discoverability, content_readability, schema_coverage, exposure_safety, integration_health,
                  md_conversion_quality, multi_channel_discovery)


def sub_scores(signals: DataFrame, only: Iterable[str] | None = None, details: bool = True) -> DataFrame:
    """Long table: one row per site and sub-score, from one pass over the signals.

    Without *details* the reasons and facts are left out, which is all the overall
    score and the leverage need.
    """
    chosen = [build() for build in ALL_SUB_SCORES]
    if only is not None:
        wanted = set(only)
        chosen = [one for one in chosen if one.name in wanted]
    rows = [F.struct(
        F.lit(one.name).alias("name"), one.value.cast("int").alias("value"), F.lit(one.weight).alias("weight"),
        *([F.array_compact(F.array(*one.reasons)).alias("reasons"), F.array(*one.facts).alias("facts")]
          if details else []),
    ) for one in chosen]
    return signals.select("site_id", F.inline(F.array(*rows)))


def reason_rows(scores: DataFrame) -> DataFrame:
    """One row per reason, with its place."""
    return scores.select("site_id", "name", F.posexplode("reasons").alias("position", "reason")).select(
        "site_id", "name", "position", "reason.code", F.array_join("reason.args", "|").alias("args"), "reason.text")


def overall(scores: DataFrame) -> DataFrame:
    total = F.sum(F.col("value") * F.col("weight"))
    return scores.groupBy("site_id").agg(F.floor(total / F.lit(100)).cast("int").alias("overall"))


def leverage(scores: DataFrame) -> DataFrame:
    """The sub-score whose repair gains most; ties go to the first name."""
    below = F.col("value") < 100
    gain = F.when(below, (F.lit(100) - F.col("value")) * F.col("weight"))
    # Greatest gain first, then the smallest name: compare by (-gain, name) and take the least.
    best = F.min(F.when(below, F.struct((-gain).alias("g"), F.col("name").alias("name"))))
    grouped = scores.groupBy("site_id").agg(best.alias("_best"), F.count_if(below).alias("below_target"))
    pairs = [F.lit(part) for pair in LABELS.items() for part in pair]
    name = F.coalesce(F.col("_best.name"), F.lit(""))
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.replace(name, F.lit("_"), F.lit(" ")))
    return grouped.select("site_id", name.alias("best_name"), label.alias("best_label"), "below_target")


def health(sites: DataFrame, overalls: DataFrame, best: DataFrame) -> DataFrame:
    """Status, badge and label per site; a site without an audit is recommended/gray."""
    rows = sites.select("site_id").join(overalls, "site_id", "left").join(best, "site_id", "left")
    score = F.col("overall")
    missing, good, fair = score.isNull(), score >= GOOD_FROM, score >= CRITICAL_BELOW
    label = (
        F.when(missing, F.lit(f"{ENGINE_NAME} Context Score has not been computed yet."))
        .when(good, F.format_string(
            f"{ENGINE_NAME} Context Score: %d/100 — site is well-prepared for AI agent traffic.", score))
        .otherwise(F.format_string(
            f"{ENGINE_NAME} Context Score: %d/100 — %d sub-score(s) below target.", score, F.col("below_target"))))
    return rows.select(
        "site_id", "overall",
        F.when(missing, F.lit("recommended")).when(good, F.lit("good")).when(fair, F.lit("recommended"))
        .otherwise(F.lit("critical")).alias("status"),
        F.when(missing, F.lit("gray")).when(good, F.lit("green")).when(fair, F.lit("orange"))
        .otherwise(F.lit("red")).alias("badge"),
        label.alias("label"), "best_name")


def keep_current(results: DataFrame, audits: DataFrame) -> DataFrame:
    """Late results survive only if the audit they were made for is still the stored one."""
    return results.join(audits.select("site_id", "computed_at"), ["site_id", "computed_at"], "left_semi")
