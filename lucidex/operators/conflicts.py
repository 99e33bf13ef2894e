"""Competing plug-ins, SEO posture, schema coverage and conflict fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known competitors, SEO plug-ins, channel providers and what SEO plug-ins cover.
KNOWN_COMPETITORS = (
    ("website-llms-txt/website-llms-txt.php", "Website LLMs.txt",
     "https://wordpress.org/plugins/website-llms-txt/", "hybrid"),
    ("llms-full-txt-generator/llms-txt-generator.php", "LLMs.txt and LLMs-Full.txt Generator",
     "https://wordpress.org/plugins/llms-full-txt-generator/", "static-file"),
    ("llms-txt-generator/llms-txt-generator.php", "LLMs.txt Generator",
     "https://wordpress.org/plugins/llms-txt-generator/", "rewrite"),
    ("markdown-mirror/markdown-mirror.php", "Markdown Mirror",
     "https://wordpress.org/plugins/markdown-mirror/", "rewrite"),
    ("jumpsuitai-llms-txt/jumpsuitai-llms-txt.php", "JumpsuitAI llms.txt + Markdown Endpoints",
     "https://wordpress.org/plugins/jumpsuitai-llms-txt/", "rewrite"),
)
SEO_PLUGINS = (
    ("yoast", "Yoast SEO", "wordpress-seo/wp-seo.php"),
    ("rank_math", "Rank Math", "seo-by-rank-math/rank-math.php"),
    ("aioseo", "All in One SEO", "all-in-one-seo-pack/all_in_one_seo_pack.php"),
)
CHANNEL_PROVIDERS = (("ai_layer", "AI Layer", "ai-layer/ai-layer.php", "admin.php?page=ai-layer"),)
SCHEMA_BASELINE = ("WebSite", "Organization", "WebPage", "Article")
SCHEMA_COVERAGE = {
    "yoast": ("WebSite", "Organization", "WebPage", "Article", "BreadcrumbList"),
    "rank_math": ("WebSite", "Organization", "WebPage", "Article", "BreadcrumbList"),
    "aioseo": ("WebSite", "Organization", "WebPage", "Article", "BreadcrumbList"),
}

#: Own rewrite targets carry this text; a rule without it belongs to someone else.
OWN_REWRITE_MARK = "lucidex_llms_txt"


def competitor_registry(spark: SparkSession, rows=KNOWN_COMPETITORS) -> DataFrame:
    """The registry as a table.  Rows without a name or slug are dropped."""
    numbered = [(i, *row) for i, row in enumerate(rows) if row[0] and row[1]]
    return spark.createDataFrame(numbered, "ord int, slug string, name string, url string, shape string")


def detect_conflicts(active: DataFrame, registry: DataFrame, root_files: DataFrame,
                     rewrites: DataFrame) -> DataFrame:
    """Conflicts of each site: active competitors, a static file, a foreign rewrite rule.

    *active* is (site_id, slug) of active plug-ins; the registry side is the small one
    and Spark broadcasts it by its size.  ``seen_order`` keeps the order of detection.
    """
    plugins = active.select("site_id", "slug").distinct().join(registry, "slug").select(
        "site_id", F.lit("plugin").alias("kind"), F.col("ord").cast("bigint").alias("seen_order"),
        "slug", "name", "url", "shape")
    files = root_files.filter(F.col("path") == "/llms.txt").groupBy("site_id", "path").agg(
        F.lit("filesystem").alias("kind"), F.lit(1_000_000).cast("bigint").alias("seen_order"))
    # A site has one rule for the index address, so one foreign rule at most.
    foreign = rewrites.filter(~F.contains("rule", F.lit(OWN_REWRITE_MARK)))
    rules = foreign.groupBy("site_id").agg(
        F.lit("rewrite").alias("kind"), F.lit(2_000_000).cast("bigint").alias("seen_order"),
        F.min("rule").alias("rule"))
    return (plugins.unionByName(files, allowMissingColumns=True)
            .unionByName(rules, allowMissingColumns=True))


#: Keys of a conflict record in name order.
_RECORD = ("kind", "name", "path", "rule", "shape", "slug", "url")


def fingerprints(conflicts: DataFrame) -> DataFrame:
    """One order-free SHA-1 per site over its conflict records.

    A site has at most one record per registry row plus two, see above.
    """
    record = F.to_json(F.struct(*[F.col(c) for c in _RECORD]))
    ordered = F.sort_array(F.collect_list(record))
    body = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
    return conflicts.groupBy("site_id").agg(
        F.sha1(body).alias("fingerprint"), F.count(F.lit(1)).alias("conflicts"))


def open_conflicts(prints: DataFrame, dismissed: DataFrame) -> DataFrame:
    return prints.join(dismissed.select("site_id", "fingerprint"), ["site_id", "fingerprint"], "left_anti")


def _first_match(active: DataFrame, slugs: list[tuple[int, str, str]]) -> DataFrame:
    """The first registry entry active on each site; a short CASE instead of a join."""
    order = F.lit(None).cast("int")
    for i, _, plugin_file in slugs:
        order = F.when(F.col("slug") == plugin_file, F.lit(i)).otherwise(order)
    return active.withColumn("_ord", order).groupBy("site_id").agg(F.min("_ord").alias("_ord"))


def seo_posture(active: DataFrame) -> DataFrame:
    first = _first_match(active, [(i, slug, file) for i, (slug, _, file) in enumerate(SEO_PLUGINS)])
    posture, label = F.lit("none"), F.lit("")
    for i, (slug, name, _) in enumerate(SEO_PLUGINS):
        posture = F.when(F.col("_ord") == i, F.lit(slug)).otherwise(posture)
        label = F.when(F.col("_ord") == i, F.lit(name)).otherwise(label)
    via = F.when(F.col("_ord").isNull(), F.lit("")).otherwise(F.lit("plugin_file"))
    return first.select("site_id", posture.alias("posture"), label.alias("label"), via.alias("detected_via"))


def active_provider(active: DataFrame, home: DataFrame) -> DataFrame:
    """The channel provider of each site that has one, with its settings address."""
    slug, name, plugin_file, config_path = CHANNEL_PROVIDERS[0]
    found = active.filter(F.col("slug") == plugin_file).select("site_id").distinct()
    address = F.concat(F.col("home_url"), F.lit("wp-admin/" + config_path))
    return found.join(home.select("site_id", "home_url"), "site_id").select(
        "site_id", F.lit(slug).alias("provider_slug"), F.lit(name).alias("provider_name"),
        address.alias("provider_config_url"))


def _type_array(types: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")


def _covered(posture: Column, matrix: dict[str, tuple[str, ...]]) -> Column:
    covered = _type_array(())
    for slug, types in matrix.items():
        covered = F.when(posture == slug, _type_array(types)).otherwise(covered)
    return F.when(posture.isin("", "none"), _type_array(())).otherwise(covered)


def coverage_gap(posture: Column, baseline: tuple[str, ...] = SCHEMA_BASELINE,
                 matrix: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Baseline types the active SEO plug-in does not emit, in baseline order."""
    return F.array_except(_type_array(baseline), _covered(posture, matrix or SCHEMA_COVERAGE))


def coverage_deferred(posture: Column, baseline: tuple[str, ...] = SCHEMA_BASELINE,
                      matrix: dict[str, tuple[str, ...]] | None = None) -> Column:
    return F.array_intersect(_type_array(baseline), _covered(posture, matrix or SCHEMA_COVERAGE))
