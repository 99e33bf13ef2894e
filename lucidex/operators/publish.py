"""What is published per document and site: links, channel files, JSON-LD, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.functions import text as tx
from lucidex.functions.safety import instruction_flags
from lucidex.functions.urls import markdown_url, mirror_path, url_host
from lucidex.operators import digest
from lucidex.operators.audit import ENGINE_NAME
from lucidex.operators.skew import top_per_group

KEY = ["site_id", "content_id"]

#: Payload version, preview cap, mirror batch.
PAYLOAD_VERSION = 1
RAW_HTML_CAP = 20_000
MIRROR_BATCH = 50


# --- links ---------------------------------------------------------------------------


def twin_url(permalink: Column, mirror_base: Column, path: Column) -> Column:
    """Address of the twin: the mirrored file if there is one, else the mapped URL."""
    mirrored = F.when(F.coalesce(path, F.lit("")) != "", F.concat(mirror_base, F.lit("/"), path))
    return F.coalesce(mirrored, markdown_url(permalink))


def escape_attribute(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("&"), F.lit("&#038;")), F.lit("'"), F.lit("&#039;"))


def alternate_links(rows: DataFrame) -> DataFrame:
    """Link tag, link header and robots line of exposable documents that have a twin.

    *rows* carries ``reason, known_empty, permalink, mirrored_path, home_url`` and the
    site's ``advertise_enabled`` and ``markdown_enabled``.
    """
    shown = rows.filter(F.col("reason").isNull() & ~F.col("known_empty")
                        & F.col("advertise_enabled") & F.col("markdown_enabled") & (F.col("permalink") != ""))
    url = markdown_url(F.col("permalink"))
    mirror_base = F.concat(F.col("home_url"), F.lit("uploads/md"))
    return shown.select(
        *KEY,
        F.concat(F.lit('<link rel="alternate" type="text/markdown" href="'), escape_attribute(url),
                 F.lit('" />\n')).alias("link_tag"),
        F.concat(F.lit("<"), url, F.lit('>; rel="alternate"; type="text/markdown"')).alias("link_header"),
        F.concat(F.lit(f"# AI-readable content index ({ENGINE_NAME.lower()}): "), F.col("home_url"),
                 F.lit("llms.txt")).alias("robots_line"),
        twin_url(F.col("permalink"), mirror_base, F.col("mirrored_path")).alias("twin_url"))


def augment_robots(body: Column, line: Column) -> Column:
    return F.concat(F.rtrim(body, F.lit("\n")), F.lit("\n"), line, F.lit("\n"))


# --- channel files -------------------------------------------------------------------


def site_label(site_name: Column, home_url: Column) -> Column:
    name = tx.trim(F.regexp_replace(F.coalesce(site_name, F.lit("")), r"[\r\n]+", " "))
    return F.when(name != "", name).otherwise(url_host(home_url))


def channel_documents(profile: DataFrame) -> DataFrame:
    """ai.txt, policy and layer documents of every site."""
    name, home = site_label(F.col("site_name"), F.col("home_url")), F.col("home_url")
    sitemap = F.coalesce("sitemap_url", F.lit(""))
    inference, training = F.col("allow_inference"), F.col("allow_training")

    def stance(flag: Column) -> Column:
        return F.when(flag, F.lit("allowed")).otherwise(F.lit("disallowed"))

    lines = F.array_compact(F.array(
        F.concat(F.lit("# ai.txt for "), name),
        F.lit(f"# AI-agent guidance. Served dynamically by the {ENGINE_NAME} plugin."),
        F.lit(""), F.lit("User-agent: *"), F.lit("Allow: /"), F.lit(""),
        F.concat(F.lit("LLMs-Index: "), home, F.lit("llms.txt")),
        F.when(sitemap != "", F.concat(F.lit("Sitemap: "), sitemap)),
        F.lit(""), F.lit("# Usage policy (declarative — see /.well-known/llms-policy.json)"),
        F.concat(F.lit("Inference: "), stance(inference)), F.concat(F.lit("Training: "), stance(training)),
        F.lit("")))
    policy = F.struct(
        F.lit(PAYLOAD_VERSION).alias("version"), name.alias("organization"), home.alias("website"),
        F.concat(home, F.lit("llms.txt")).alias("llms_txt"),
        F.struct(inference.alias("allow_inference"), training.alias("allow_training")).alias("policy"),
        F.nullif(sitemap, F.lit("")).alias("sitemap"))
    layer = F.struct(
        F.lit(PAYLOAD_VERSION).alias("version"), name.alias("name"), home.alias("website"),
        F.lit(ENGINE_NAME.lower()).alias("generator"),
        F.struct(F.concat(home, F.lit("llms.txt")).alias("llms_txt"), F.concat(home, F.lit("ai.txt")).alias("ai_txt"),
                 F.concat(home, F.lit(".well-known/llms-policy.json")).alias("llms_policy"),
                 F.col("markdown_enabled").alias("markdown_views")).alias("channels"))
    return profile.select("site_id", F.array_join(lines, "\n").alias("ai_txt"),
                          F.to_json(policy).alias("llms_policy"), F.to_json(layer).alias("ai_layer"))


# --- structured data -----------------------------------------------------------------


def _hex_tags(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit("<"), F.lit("\\u003C")), F.lit(">"), F.lit("\\u003E"))


def iso_time(column: Column) -> Column:
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def structured_data(rows: DataFrame, type_of: Column | None = None) -> DataFrame:
    """JSON-LD of each weakly exposed document: the node types its site lacks.

    *rows* carries the content columns, ``gap`` (array of types), ``weakly_exposed``,
    ``structured_data_enabled``, ``home_url``, ``site_name`` and ``language``.
    """
    default_type = F.when(F.col("post_type") == "post", F.lit("Article")).otherwise(F.lit("WebPage"))
    node_type = type_of if type_of is not None else default_type
    context = F.lit("https://schema.org").alias("@context")
    home, url = F.col("home_url"), F.col("permalink")

    def node(type_name: str, *fields: Column) -> Column:
        return F.to_json(F.struct(context, F.lit(type_name).alias("@type"), *fields))

    site = node("WebSite", F.concat(home, F.lit("#website")).alias("@id"), home.alias("url"),
                F.col("site_name").alias("name"), F.col("language").alias("inLanguage"))
    organization = node("Organization", F.concat(home, F.lit("#organization")).alias("@id"),
                        F.col("site_name").alias("name"), home.alias("url"))
    page = node("WebPage", F.concat(url, F.lit("#webpage")).alias("@id"), url.alias("url"),
                F.col("title").alias("name"),
                F.struct(F.concat(home, F.lit("#website")).alias("@id")).alias("isPartOf"))
    article = node("Article", F.concat(url, F.lit("#article")).alias("@id"), F.col("title").alias("headline"),
                   iso_time(F.col("published_at")).alias("datePublished"),
                   iso_time(F.col("modified_at")).alias("dateModified"),
                   F.struct(F.concat(url, F.lit("#webpage")).alias("@id")).alias("mainEntityOfPage"),
                   url.alias("url"))
    shown = F.col("weakly_exposed")

    def wanted(type_name: str, condition: Column, json: Column) -> Column:
        return F.when(F.array_contains("gap", type_name) & condition, json)

    nodes = F.array_compact(F.array(
        wanted("WebSite", F.lit(True), site), wanted("Organization", F.lit(True), organization),
        wanted("WebPage", shown & (node_type == "WebPage"), page),
        wanted("Article", shown & (node_type == "Article"), article)))
    many = F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]"))
    payload = F.when(F.size(nodes) == 1, nodes[0]).when(F.size(nodes) > 1, many)
    return (rows.filter("structured_data_enabled")
            .select(*KEY, F.size(nodes).alias("nodes"), _hex_tags(payload).alias("json_ld"))
            .filter(F.col("json_ld").isNotNull()))


# --- single documents ----------------------------------------------------------------


def front_matter(content_id: Column, title: Column, url: Column, generated_at: Column) -> Column:
    return F.concat(
        F.lit("---\nid: "), content_id.cast("string"),
        F.lit("\ntitle: "), tx.json_string(title),
        F.lit("\ncanonical_url: "), tx.json_string(url),
        F.lit("\ngenerated_at: "), tx.json_string(generated_at), F.lit("\n---\n\n"))


def document_preview(rows: DataFrame) -> DataFrame:
    """What an agent sees of each document, and why not where it does not.

    *rows* carries content, ``reason``, ``markdown_enabled``, the stored ``markdown``, the
    index entry's ``entry_title``, ``entry_url``, ``entry_description`` (null without an
    entry) and the cached description ``cached``.
    """
    html = F.coalesce("body_html", F.lit(""))
    has_twin = tx.trim(F.coalesce("markdown", F.lit(""))) != ""
    open_doc = F.col("markdown_enabled") & F.col("reason").isNull()
    verdict = (F.when(~F.col("markdown_enabled"), F.lit("module_disabled"))
               .when(F.col("reason").isNotNull(), F.lit("not_exposable"))
               .when(~has_twin, F.lit("error")).otherwise(F.lit("exposable")))
    why = (F.when(~F.col("markdown_enabled"), F.lit("markdown_views"))
           .when(F.col("reason").isNotNull(), F.col("reason"))
           .when(~has_twin, F.lit("empty_content")))
    listed = F.col("entry_url").isNotNull()
    words = F.coalesce("entry_description", F.lit(""))
    tail = F.when(words != "", F.concat(F.lit(": "), words)).otherwise(F.lit(""))
    line = F.concat(F.lit("- ["), F.col("entry_title"), F.lit("]("), F.col("entry_url"), F.lit(")"), tail)
    source = (F.when(~listed | (words == ""), F.lit("none"))
              .when(F.coalesce("cached", F.lit("")) != "", F.lit("llm")).otherwise(F.lit("excerpt")))
    return rows.select(
        *KEY, F.coalesce(tx.present(F.col("title")), F.lit("(no title)")).alias("title"),
        F.octet_length(html).cast("bigint").alias("html_bytes"),
        (F.octet_length(html) > RAW_HTML_CAP).alias("html_truncated"),
        F.octet_length(tx.cut_bytes(html, RAW_HTML_CAP)).cast("bigint").alias("html_shown_bytes"),
        F.when(open_doc & has_twin, F.col("markdown")).otherwise(F.lit("")).alias("markdown"),
        verdict.alias("verdict"), why.alias("verdict_reason"),
        F.when(listed, line).otherwise(F.lit("")).alias("line"), source.alias("description_source"),
        F.when(listed, F.array_join(instruction_flags(words), ",")).otherwise(F.lit("")).alias("advisory"))


# --- mirror --------------------------------------------------------------------------


def mirror_wanted(content: DataFrame, home_path: str = "/") -> DataFrame:
    return content.withColumn("path", mirror_path(F.col("permalink"), F.lit(home_path), F.col("content_id")))


def mirror_delta(content: DataFrame, present: DataFrame, newest: int | None = None) -> DataFrame:
    """What to do with each mirrored file.

    *content* has ``path, modified_at, has_twin`` for documents of exposed type and
    status; *present* has ``present_path, written_at``.  All are compared; *newest* looks only
    at the last modified documents of each site, as a frequent light run does.
    """
    rows = content
    if newest is not None:
        rows = top_per_group(rows, ["site_id"], [F.desc("modified_at"), F.desc("content_id")], newest,
                             ["content_id"]).drop("rank")
        present = present.join(rows.select(*KEY), KEY, "left_semi")
    joined = rows.join(present, KEY, "full_outer")
    stored, wanted = F.col("present_path"), F.col("path")
    fresh = (stored == wanted) & (F.col("written_at") >= F.col("modified_at"))
    action = (
        F.when(F.coalesce(fresh, F.lit(False)), F.lit("keep"))
        .when(~F.coalesce("has_twin", F.lit(False)), F.when(stored.isNotNull(), F.lit("delete"))
              .otherwise(F.lit("none")))
        .when(stored.isNull(), F.lit("write"))
        .when(stored != wanted, F.lit("move"))
        .otherwise(F.lit("rewrite")))
    return joined.select(*KEY, wanted.alias("path"), stored.alias("present_path"), action.alias("action"))


#: Mirrored documents as they should be and as they are, kept by bucket of the key.
WANTED = "site_id string, content_id bigint, path string, modified_at timestamp_ntz, has_twin boolean"
PRESENT = "site_id string, content_id bigint, present_path string, written_at timestamp_ntz"


def save_mirror_states(content: DataFrame, present: DataFrame, wanted_path: str, present_path: str,
                       tops: int = digest.TOPS, lows: int = digest.LOWS) -> None:
    """Both sides with digests that are equal where every file is as it should be.

    Only documents with a twin are compared: one without is either absent on both sides, or present and so different.
    """
    wanted = content.select(*KEY, "path", "modified_at", F.coalesce("has_twin", F.lit(False)).alias("has_twin"))
    digest.save(wanted, wanted_path, KEY, ["path", "modified_at"], F.col("has_twin"), tops, lows)
    digest.save(present.select(*KEY, "present_path", "written_at"), present_path, KEY, ["present_path", "written_at"], None, tops, lows)


def mirror_digest_delta(spark: SparkSession, wanted_path: str, present_path: str) -> DataFrame:
    """The files to write, move, rewrite or delete, as :func:`mirror_delta` finds them; only buckets that differ are read."""
    buckets = digest.differing_buckets(spark, wanted_path, present_path)
    wanted = digest.read_buckets(spark, wanted_path, WANTED, buckets)
    present = digest.read_buckets(spark, present_path, PRESENT, buckets)
    return mirror_delta(wanted, present).filter(~F.col("action").isin("keep", "none"))


# --- status --------------------------------------------------------------------------


def index_status(artifacts: DataFrame, profile: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Key/value status lines of each site's index."""
    rows = (profile.select("site_id").join(artifacts, "site_id", "left")
            .join(conflicts.select("site_id", F.col("conflicts").alias("_conflicts")), "site_id", "left"))
    known = F.col("entry_count").isNotNull()
    fields = {
        "cache_populated": F.when(known, F.lit("yes")).otherwise(F.lit("no")),
        "entry_count": F.coalesce("entry_count", F.lit(0)).cast("string"),
        "body_bytes": F.coalesce("body_bytes", F.lit(0)).cast("string"),
        "conflicts_detected": F.coalesce("_conflicts", F.lit(0)).cast("string"),
    }
    wide = rows.select("site_id", *[value.alias(name) for name, value in fields.items()])
    return wide.unpivot(["site_id"], list(fields), "field", "value").withColumn(
        "line", F.concat_ws("=", "field", "value"))
