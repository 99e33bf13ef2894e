"""Adapters: the sample tables as the engine's input tables.

Every rule is fixed and simple, so that SQL can repeat it.  All rows are used: pages are content of the site that
their address names, and documents are content of a site of their own source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.functions.urls import registered_site, url_host
from lucidex.operators.skew import attach
from lucidex.operators.store import content_hash

RETIRED_META_KEYS = ["cleanup_status", "cleanup_hash", "cleanup_output", "cleanup_diagnostics"]

PUBLISHED = "(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(content_id AS int)))"
MODIFIED = f"({PUBLISHED} + make_dt_interval(cast(content_id % 7 AS int)))"
#: A source is a site; a document is a page of it, with the start of its text as title and notice.
DOCUMENT_SITE = ("(coalesce(source, 'none') || CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 0) % 3 "
                 "WHEN 0 THEN '.com' WHEN 1 THEN '.net' ELSE '.org' END)")
DOCUMENT_URL = f"'https://' || {DOCUMENT_SITE} || '/' || coalesce(lang, 'en') || '/d' || doc_id"
DOCUMENT_HTML = ("'<title>Doc ' || doc_id || ' ' || regexp_extract(coalesce(text, ''), '^[A-Za-z ]{0,40}', 0) || '</title><div class=\"ad\">' || "
                 "regexp_extract(coalesce(text, ''), '^[A-Za-z ,.\\n]{0,80}', 0) || '</div><p>' || coalesce(text, '') || '</p>'")
SCORE = "CASE WHEN doc_id % 13 = 0 THEN cast(NULL AS int) ELSE cast(doc_id % 101 AS int) END"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def case_of(key: Column, values: dict, default=None) -> Column:
    chain = F.lit(default)
    for match, value in values.items():
        chain = F.when(key == match, F.lit(value)).otherwise(chain)
    return chain


class Samples:
    """The engine's tables over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def content(self) -> DataFrame:
        """Pages, and documents as pages, as content rows of the site named by the last two host labels."""
        documents = self.table("documents").selectExpr("doc_id AS page_id", f"{DOCUMENT_URL} AS url", f"{DOCUMENT_HTML} AS html")
        named = self.table("pages").select("page_id", "url", "html").unionByName(documents).select(
            registered_site(F.col("url")).alias("site_id"),
            F.expr("page_id + 1").alias("content_id"), "url", "html",
            F.expr(r"regexp_extract(url, r'^[a-z]+://[^/?#]+([^?#]*)', 1)").alias("path"),
            F.expr(r"regexp_extract(html, r'<title>([^<]*)</title>', 1)").alias("heading"),
            F.expr(r"""regexp_extract(html, r'<div class="ad">([^<]*)</div>', 1)""").alias("notice"),
            F.expr(r"regexp_extract(url, r'^[a-z]+://[^/?#]+/([a-z]{2})/', 1)").alias("lang"))
        return named.selectExpr(
            "site_id", "content_id",
            "CASE content_id % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'page' ELSE 'product' END AS post_type",
            "CASE content_id % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' ELSE 'publish' END AS status",
            "CASE WHEN content_id % 17 = 0 THEN 'x' ELSE '' END AS password",
            "CASE WHEN content_id % 41 = 0 THEN 'hello-world' WHEN content_id % 43 = 0 THEN 'sample-page' "
            "ELSE regexp_extract(path, r'([^/]+)/?$', 1) END AS slug",
            "CASE WHEN content_id % 23 = 0 THEN '  ' ELSE heading END AS title",
            "CASE WHEN content_id % 4 = 0 THEN '' ELSE notice END AS excerpt",
            "html AS body_html", "url AS permalink",
            f"{PUBLISHED} AS published_at", f"{MODIFIED} AS modified_at",
            "array(named_struct('taxonomy', 'category', 'term_id', CASE lang WHEN 'en' THEN 1L WHEN 'fr' THEN 2L "
            "WHEN 'de' THEN 3L WHEN 'es' THEN 4L ELSE 0L END, 'slug', lang), "
            "named_struct('taxonomy', 'post_tag', 'term_id', content_id % 2 + 10, "
            "'slug', CASE content_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END), "
            "named_struct('taxonomy', 'color', 'term_id', 3L, 'slug', 'fr')) AS terms",
            "CASE WHEN content_id % 11 = 0 THEN array('noindex', 'follow') ELSE array('index') END AS robots",
            "to_json(named_struct('intro', named_struct('type', 'text', 'value', heading), "
            "'picture', named_struct('type', 'image', 'value', content_id), "
            "'faq', named_struct('type', 'repeater', 'sub_fields', array(named_struct('name', 'q', 'type', 'text'), "
            "named_struct('name', 'a', 'type', 'textarea')), 'value', array(named_struct('q', 'Where? ' || url, "
            "'a', notice || '\\n' || lang))))) AS fields_json",
        )

    @cached_property
    def keys(self) -> DataFrame:
        """Site and id of every page and document, without their texts."""
        return self.content.select("site_id", "content_id")

    @cached_property
    def content_meta(self) -> DataFrame:
        """Long metadata of pages, retired keys included."""
        return self.keys.selectExpr("site_id", "content_id", """inline(array_compact(array(
            CASE WHEN content_id % 13 = 0 THEN named_struct('key', 'excluded', 'value', '1') END,
            CASE WHEN content_id % 13 = 1 THEN named_struct('key', 'excluded', 'value', '0') END,
            CASE WHEN content_id % 19 = 0 THEN named_struct('key', 'yoast_noindex', 'value', '1') END,
            named_struct('key', CASE content_id % 5 WHEN 0 THEN 'cleanup_status' WHEN 1 THEN 'cleanup_hash'
                         WHEN 2 THEN 'cleanup_output' ELSE 'views' END, 'value', cast(content_id AS string)))))""")

    @cached_property
    def robots(self) -> DataFrame:
        """The SEO robots table: a row for every fifth page."""
        return self.keys.filter("content_id % 5 = 0").selectExpr(
            "site_id", "content_id", "content_id % 2 = 0 AS robots_default", "content_id % 3 = 0 AS robots_noindex")

    @cached_property
    def stored_profiles(self) -> DataFrame:
        """Raw site settings, one row per site, as editors left them."""
        none, yes, no, empty = "cast(NULL AS boolean)", "true", "false", "cast(array() AS array<string>)"

        def pick(name: str, com: str, net: str, org: str) -> str:
            return f"CASE right(site_id, 4) WHEN '.com' THEN {com} WHEN '.net' THEN {net} ELSE {org} END AS {name}"

        return self.keys.select("site_id").distinct().selectExpr(
            "site_id",
            pick("exposed_types", "array('Post', 'page!', 'page', '')", "array('post', 'page', 'product', 'attachment')",
                 "array('page', 'product')"),
            pick("exposed_statuses", "cast(NULL AS array<string>)", "array('publish', 'bogus', 'Private')",
                 "array('bogus')"),
            pick("excluded_ids", "array('7', '-12', 'x', '0', '7')", empty, "array('33')"),
            pick("excluded_slugs", "array('  Foo Bar! ', '825')", empty, "array('')"),
            pick("excluded_term_ids", empty, "array('3')", empty),
            pick("excluded_term_slugs", "array('FR')", empty, empty),
            pick("descriptions_enabled", none, no, yes),
            pick("structured_data_enabled", yes, none, yes),
            pick("markdown_enabled", none, yes, no),
            pick("advertise_enabled", none, yes, no),
            pick("exclude_samples", none, yes, no),
            pick("channels_enabled", none, no, yes),
            pick("allow_inference", none, yes, no),
            pick("allow_training", none, yes, no),
            pick("full_index_enabled", none, yes, no),
            pick("content_link_enabled", none, no, yes),
            pick("static_mode", "'weird'", "'on'", "cast(NULL AS string)"),
            pick("utility_ids", "array(21L, 0L, 23L)", "array(0L)", "cast(array() AS array<bigint>)"),
            pick("seo_posture", "'yoast'", "'rank_math'", "'aioseo'"),
            pick("client_configured", yes, yes, no),
            pick("static_robots", no, yes, no),
            pick("site_name", "'Alpha &amp; Co'", r"'Beta_\nSite'", "''"),
            pick("tagline", "'Tools &mdash; tactics'", "''", "''"),
            "'https://' || site_id || '/' AS home_url",
            pick("sitemap_url", "'https://' || site_id || '/sitemap.xml'", "''", "''"),
            "'en-US' AS language",
        )

    @cached_property
    def editorial(self) -> DataFrame:
        """Curated entries: one raw row per page, most of them in need of cleaning."""
        return self.content.selectExpr(
            "site_id", "content_id AS position",
            "CASE WHEN content_id % 7 = 0 THEN ' ' ELSE '<b>Pick</b> ' || content_id END AS title",
            "CASE content_id % 6 WHEN 0 THEN 'ftp://' WHEN 1 THEN 'mailto:' WHEN 2 THEN 'javascript:' "
            "ELSE ' https://' END || 'x.example/' || content_id || ' ' AS url",
            "CASE WHEN content_id % 3 <> 0 THEN 'Note\\n' || slug END AS description",
            "CASE content_id % 8 WHEN 0 THEN 'Featured' WHEN 1 THEN 'Resources' WHEN 2 THEN 'Custom' "
            "WHEN 3 THEN 'Custom' WHEN 4 THEN 'Bogus' END AS section",
            "CASE content_id % 8 WHEN 2 THEN 'page' WHEN 3 THEN ' ' ELSE 'unused' END AS section_label",
        )

    @cached_property
    def numbered_documents(self) -> DataFrame:
        return self.table("documents").withColumn("content_id", F.col("doc_id") + 1)

    @cached_property
    def sited_documents(self) -> DataFrame:
        """Every document with its key as content."""
        return self.numbered_documents.withColumn("site_id", F.expr(DOCUMENT_SITE))

    @cached_property
    def descriptions(self) -> DataFrame:
        """Documents as description records of their own content; pages have none."""
        return self.sited_documents.selectExpr(
            "site_id", "content_id",
            "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 29 = 1 THEN '  ' ELSE text END AS auto",
            "CASE WHEN doc_id % 7 = 0 THEN ' ' || text WHEN doc_id % 7 = 1 THEN '   ' END AS manual",
            f"CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN {MODIFIED} - make_dt_interval(1) "
            f"ELSE {MODIFIED} END AS generated_for",
            "CASE WHEN doc_id % 11 = 0 THEN '0' ELSE '1' END AS generator_version",
            "CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs-retry' WHEN 2 THEN 'failed' WHEN 3 THEN 'done' "
            "WHEN 4 THEN '' ELSE 'skipped' END AS job_status",
        )

    @cached_property
    def page_store(self) -> DataFrame:
        """Documents as stored conversions of their own content; pages have none."""
        keyed = self.content.select("site_id", "content_id", content_hash().alias("_hash"))
        return self.sited_documents.join(keyed, ["site_id", "content_id"]).selectExpr(
            "site_id", "content_id",
            "CASE WHEN doc_id % 4 = 0 THEN 'outdated' ELSE _hash END AS content_hash",
            "CASE WHEN doc_id % 9 = 0 THEN '  \\n' ELSE text END AS markdown",
            f"{PUBLISHED} AS generated_at",
            "CASE WHEN doc_id % 6 = 0 THEN '4' ELSE '5' END AS converter_version",
            f"{SCORE} AS quality_score",
        )

    @cached_property
    def source_store(self) -> DataFrame:
        """All documents as stored conversions, one site per source.

        Every eighth body carries an encoded blob and every tenth leftover markup, so
        that noise is found.
        """
        return self.numbered_documents.selectExpr(
            "source AS site_id", "content_id",
            "CASE WHEN doc_id % 8 = 0 THEN text || ' ' || repeat('QWxhZGRpbg', length(text) % 40) "
            "WHEN doc_id % 10 = 1 THEN '[vc_row full=\"1\"]<script src=\"a.js\"></script>' || text "
            "|| '[/vc_row]' ELSE text END AS markdown",
            f"{SCORE} AS quality_score", f"{PUBLISHED} AS generated_at")

    @cached_property
    def hosts(self) -> DataFrame:
        """Pages with their host as the site; conflicts and plug-ins vary by host."""
        return self.table("pages").select(url_host(F.col("url")).alias("site_id"), "page_id")

    @cached_property
    def active_plugins(self) -> DataFrame:
        return self.hosts.selectExpr("site_id", """CASE page_id % 11
            WHEN 0 THEN 'website-llms-txt/website-llms-txt.php' WHEN 1 THEN 'markdown-mirror/markdown-mirror.php'
            WHEN 2 THEN 'seo-by-rank-math/rank-math.php' WHEN 3 THEN 'wordpress-seo/wp-seo.php'
            WHEN 4 THEN 'akismet/akismet.php' WHEN 5 THEN 'llms-txt-generator/llms-txt-generator.php'
            WHEN 6 THEN 'ai-layer/ai-layer.php' WHEN 7 THEN 'all-in-one-seo-pack/all_in_one_seo_pack.php'
            ELSE 'hello.php' END AS slug""")

    @cached_property
    def root_files(self) -> DataFrame:
        return self.hosts.selectExpr("site_id", "CASE page_id % 6 WHEN 0 THEN '/llms.txt' WHEN 1 THEN '/sub/llms.txt' "
                                                "ELSE '/robots.txt' END AS path")

    @cached_property
    def rewrites(self) -> DataFrame:
        return self.hosts.filter("page_id % 3 <> 2").selectExpr(
            "site_id", "CASE WHEN page_id % 3 = 0 THEN 'index.php?other=' || (page_id % 4) "
                       "ELSE 'index.php?lucidex_llms_txt=1' END AS rule")

    @cached_property
    def changes(self) -> DataFrame:
        """Events as a change feed; a minute of events is a second of the feed.

        Users are documents: an event changes what has the user's number on every site.
        """
        fed = self.table("events").withColumn("content_id", F.col("user_id") + 1)
        sites = self.keys.join(fed.select("content_id").distinct(), "content_id", "left_semi")
        return attach(fed, sites, ["content_id"], ["event_id"]).selectExpr(
            "event_id", "site_id", "content_id",
            "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'save' WHEN 'view' THEN 'meta' "
            "WHEN 'purchase' THEN 'term' ELSE 'trash' END AS kind",
            "CASE WHEN event_type = 'view' THEN CASE event_id % 2 WHEN 0 THEN 'excluded' ELSE 'views' END END AS meta_key",
            "CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'post_tag' "
            "ELSE 'color' END END AS taxonomy",
            "cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 60) AS bigint) AS second")

    @cached_property
    def source_signals(self) -> DataFrame:
        """Audit signals of one site per source, from the documents of that source."""
        empty = "cast(array() AS array<string>)"
        sums = self.table("documents").selectExpr(
            "source", "doc_id", "n_chars", "CASE WHEN doc_id % 13 <> 0 THEN doc_id % 101 END AS score"
        ).groupBy("source").agg(
            F.expr("count(1) AS n"), F.expr("count(score) AS scored"), F.expr("avg(score) AS mean"),
            F.expr("count_if(score >= 70) AS above"), F.expr("count_if(n_chars > 600) AS longs"),
            F.expr("count_if(n_chars < 200) AS shorts"), F.expr("count_if(doc_id % 9 = 0) AS ninths"))
        return sums.selectExpr("*", r"cast(regexp_extract(source, r'([0-9]+)$', 1) AS int) AS k").selectExpr(
            "source AS site_id",
            f"concat(CASE WHEN k % 5 <> 0 THEN array('post') ELSE {empty} END, "
            f"CASE WHEN k % 2 = 0 THEN array('page') ELSE {empty} END) AS exposed_types",
            f"concat(array('publish'), CASE WHEN k % 3 = 1 THEN array('draft') ELSE {empty} END, "
            f"CASE WHEN k % 6 = 4 THEN array('private') ELSE {empty} END) AS exposed_statuses",
            "k % 2 = 0 AS descriptions_enabled", "k % 3 = 0 AS advertise_enabled",
            "k % 4 = 2 AS structured_data_enabled", "k % 7 <> 3 AND longs > 0 AS index_populated",
            "CASE WHEN k % 7 = 3 THEN 0L ELSE longs END AS entry_count",
            f"concat(CASE WHEN k % 4 = 1 THEN array('plugin') ELSE {empty} END, "
            f"CASE WHEN k % 8 = 5 THEN array('rewrite') ELSE {empty} END) AS conflict_kinds",
            "cast(CASE WHEN k % 8 = 5 THEN 2 WHEN k % 4 = 1 THEN 1 ELSE 0 END AS bigint) AS conflict_count",
            "k % 9 = 0 AS static_robots", "'https://' || source || '.example/llms.txt' AS index_url",
            "CASE WHEN k % 10 = 9 THEN 0L ELSE n END AS rows_total", "scored AS rows_with_score",
            "coalesce(mean, 0.0D) AS mean_quality", "above AS rows_above_threshold", "n AS sampled",
            "CASE WHEN k % 3 = 0 THEN 0.0D ELSE shorts / n END AS empty_ratio",
            "CASE WHEN k % 4 = 0 THEN 0.0D ELSE ninths / n END AS noisy_ratio",
            f"CASE WHEN k % 2 = 1 THEN array(' ', 'First title', 'Second, title', 'Third') ELSE {empty} END AS worst_titles",
            f"CASE WHEN k % 2 = 1 THEN array('17 https://a.example/17') ELSE {empty} END AS worst_refs",
            "CASE k % 4 WHEN 0 THEN 'yoast' WHEN 1 THEN 'aioseo' ELSE '' END AS seo_plugin",
            "k % 3 <> 1 AS client_configured",
            "CASE WHEN k % 11 = 10 THEN 0L ELSE n END AS total_entries",
            "CASE WHEN k % 6 = 0 THEN n ELSE longs END AS entries_with_description",
            "k % 2 = 0 AS ai_txt_present", "k % 3 <> 2 AS ai_layer_present", "k % 5 < 3 AS policy_present",
            "k % 4 = 3 AS openapi_present", "CASE WHEN k % 5 = 0 THEN 'ai_layer' END AS provider_slug",
            "CASE WHEN k % 5 = 0 THEN 'AI Layer' END AS provider_name",
            "CASE WHEN k % 10 = 0 THEN 'https://a.example/wp-admin/admin.php?page=ai-layer' END AS provider_config_url",
        )
