"""Registered queries: descriptions, index, audit, narrative, publishing, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucidex.functions import text as tx
from lucidex.operators import audit, conflicts as cf, descriptions as ds, exposure, guard, narrative, publish
from lucidex.operators import site_index, store
from lucidex.plans import statements as st
from lucidex.plans.catalog_content import seconds
from lucidex.plans.inputs import Inputs
from lucidex.plans.registry import query
from lucidex.sources import samples
from lucidex.streaming import triggers

KEY = ["site_id", "content_id"]

# --- descriptions --------------------------------------------------------------------

_HAS_MANUAL = st.trim("coalesce(manual, '')") + " <> ''"
_HAS_AUTO = st.trim("coalesce(auto, '')") + " <> ''"
_OUTDATED = "(generated_for IS NULL OR generated_for < g.modified_at OR coalesce(generator_version, '') <> '1')"

_CONSIDERED = """
(SELECT g.*, auto, manual, generated_for, generator_version, job_status FROM gate g
 LEFT JOIN described d USING (site_id, content_id)
 WHERE list_contains(exposed_types, post_type) AND list_contains(exposed_statuses, status))"""


@query("description_stale", st.statement(f"""
SELECT g.site_id, g.content_id, {_HAS_AUTO} AND {_OUTDATED} AS stale
FROM gate g LEFT JOIN described d USING (site_id, content_id)""", "gate", "described"))
def description_stale(spark, folder):
    inputs = Inputs(spark, folder)
    rows = inputs.light.join(inputs.descriptions, KEY, "left")
    stale = ds.is_stale(F.col("auto"), F.col("generated_for"), F.col("modified_at"), F.col("generator_version"))
    return rows.select(*KEY, stale.alias("stale"))


_ELIGIBLE = f"""descriptions_enabled AND client_configured AND reason IS NULL AND NOT ({_HAS_MANUAL})
 AND (NOT ({_HAS_AUTO}) OR {_OUTDATED})"""


@query("description_queue", st.statement(f"""
SELECT site_id, 'queued' AS kind, content_id, CAST(queue_rank AS INTEGER) AS queue_rank, NULL::BIGINT AS scheduled, NULL::BIGINT AS skipped FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY g.published_at DESC, content_id DESC) AS queue_rank
 FROM {_CONSIDERED} g WHERE {_ELIGIBLE}) WHERE queue_rank <= 10
UNION ALL SELECT site_id, 'totals', NULL, NULL, least(10, count(CASE WHEN {_ELIGIBLE} THEN 1 END)),
 count(*) - least(10, count(CASE WHEN {_ELIGIBLE} THEN 1 END)) FROM {_CONSIDERED} g GROUP BY site_id""", "gate", "described"))
def description_queue(spark, folder):
    rows, limit = Inputs(spark, folder).eligible, ds.run_limit(0)
    queued = ds.take_budget(rows, limit).select(
        "site_id", F.lit("queued").alias("kind"), "content_id", "queue_rank",
        F.lit(None).cast("bigint").alias("scheduled"), F.lit(None).cast("bigint").alias("skipped"))
    totals = ds.run_counts(rows, limit).select(
        "site_id", F.lit("totals").alias("kind"), F.lit(None).cast("bigint").alias("content_id"),
        F.lit(None).cast("int").alias("queue_rank"), "scheduled", "skipped")
    return queued.unionByName(totals)


@query("description_page", st.statement(f"""
SELECT site_id, content_id, CAST(position AS INTEGER) AS position, total, CAST(ceil(total / 20) AS BIGINT) AS pages, stale FROM (
 SELECT g.site_id, g.content_id, row_number() OVER (PARTITION BY site_id ORDER BY g.published_at DESC, content_id DESC) AS position,
  count(*) OVER (PARTITION BY site_id) AS total, {_HAS_AUTO} AND {_OUTDATED} AS stale
 FROM {_CONSIDERED} g WHERE auto IS NOT NULL) WHERE position BETWEEN 21 AND 40""", "gate", "described"))
def description_page(spark, folder):
    shown = ds.page_of(Inputs(spark, folder).eligible.filter(ds.status_filter("stale")), page=2, size=20)
    return shown.select(*KEY, "position", "total", "pages", "stale")


@query("description_listings", st.statement(f"""
SELECT site_id, listing, content_id, CAST(position AS INTEGER) AS position, total, stale FROM (
 SELECT g.site_id, g.content_id, listing, {_HAS_AUTO} AND {_OUTDATED} AS stale,
  row_number() OVER (PARTITION BY site_id, listing ORDER BY g.published_at DESC, content_id DESC) AS position,
  count(*) OVER (PARTITION BY site_id, listing) AS total
 FROM {_CONSIDERED} g, (SELECT unnest(['all', 'missing', 'cached', 'manual', 'stale', 'pending', 'failed', 'needs-retry']) AS listing)
 WHERE CASE listing WHEN 'all' THEN true WHEN 'missing' THEN auto IS NULL AND manual IS NULL WHEN 'cached' THEN auto IS NOT NULL
  WHEN 'manual' THEN manual IS NOT NULL WHEN 'stale' THEN auto IS NOT NULL ELSE job_status = listing END) WHERE position <= 5""", "gate", "described"))
def description_listings(spark, folder):
    shown = ds.listings(Inputs(spark, folder).eligible, page=1, size=5)
    return shown.select("site_id", "listing", "content_id", "position", "total", "stale")


@query("content_search", st.statement("""
SELECT site_id, content_id, title, CAST(position AS INTEGER) AS position, total FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY published_at DESC, content_id DESC) AS position,
  count(*) OVER (PARTITION BY site_id) AS total
 FROM content WHERE status = 'publish' AND (contains(lower(title), 'the') OR contains(lower(excerpt), 'the') OR contains(lower(body_html), 'the')))
WHERE position <= 50""", "content"))
def content_search(spark, folder):
    found = ds.search(Inputs(spark, folder).content, "The", page=1, size=0)
    return found.select(*KEY, "title", "position", "total")


_STATE = f"""CASE WHEN {_HAS_MANUAL} THEN 'manual_set' WHEN {_HAS_AUTO} THEN 'auto_cached' WHEN job_status = 'pending' THEN 'pending'
 WHEN job_status = 'needs-retry' THEN 'needs_retry' WHEN job_status = 'failed' THEN 'failed' ELSE 'missing' END"""


@query("description_status", st.statement(f"""
SELECT site_id, count(*) AS exposed_total, {', '.join(f"count(CASE WHEN state = '{s}' THEN 1 END) AS {s}" for s in
 ("manual_set", "auto_cached", "pending", "needs_retry", "failed", "missing"))}
FROM (SELECT site_id, {_STATE} AS state FROM {_CONSIDERED} g) GROUP BY site_id""", "gate", "described"))
def description_status(spark, folder):
    inputs = Inputs(spark, folder)
    ids = inputs.light.select("site_id", "content_id", "post_type", "status", "published_at")
    rows = ds.considered_rows(inputs.sited(ids)).join(inputs.descriptions, KEY, "left")
    return ds.status_tally(rows)


@query("description_resolve", st.statement(
    "SELECT site_id, content_id, description, source FROM words", "words"))
def description_resolve(spark, folder):
    inputs = Inputs(spark, folder)
    rows = inputs.light.join(inputs.descriptions, KEY, "left")
    manual, auto, excerpt = F.col("manual"), F.col("auto"), F.col("excerpt")
    return rows.select(
        *KEY, ds.resolved_description(F.lit(None).cast("string"), manual, auto, excerpt).alias("description"),
        ds.description_source(manual, auto, excerpt).alias("source"))


@query("content_floor", f"""
SELECT doc_id, strlen({st.strip("text || '<b></b>'")}) < 100 + doc_id % 900 AS below FROM documents""")
def content_floor(spark, folder):
    html = F.concat(F.lit("[gone a=1]"), F.col("text"), F.lit("<b></b>"))
    floor = F.lit(100) + F.col("doc_id") % 900
    return samples.table(spark, folder, "documents").select("doc_id", ds.below_floor(html, floor).alias("below"))


@query("prompt_rows", f"""
SELECT doc_id, 'Title: ' || source || chr(10) || 'URL: https://' || source || '/' || doc_id || chr(10) || 'Excerpt (may be truncated):' || chr(10) ||
 {st.cap('plain', 500, '…', 499)} AS description_prompt,
 'Page content:' || chr(10) || chr(10) || CASE WHEN length({st.trim('text')}) > 2000 THEN {st.rtrim('left(' + st.trim('text') + ', 2000)')} ELSE {st.trim('text')} END AS summary_prompt
FROM (SELECT *, {st.strip('text')} AS plain FROM documents)""")
def prompt_rows(spark, folder):
    url = F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return samples.table(spark, folder, "documents").select(
        "doc_id", ds.description_prompt(F.col("source"), url, F.col("text")).alias("description_prompt"),
        ds.summary_prompt(F.col("text")).alias("summary_prompt"))


_GENERATED = st.cap("line", 160, "...", 157)


@query("description_apply", st.statement(f"""
SELECT site_id, content_id, 'result' AS kind,
 CASE WHEN k = 0 AND coalesce(auto, '') <> '' THEN NULL WHEN k = 3 THEN {_GENERATED} ELSE auto END AS auto,
 manual, CASE k WHEN 0 THEN 'skipped' WHEN 1 THEN CASE WHEN content_id % 2 = 0 THEN 'needs-retry' ELSE 'failed' END WHEN 2 THEN 'failed'
  WHEN 3 THEN 'done' ELSE job_status END AS job_status,
 CASE k WHEN 0 THEN coalesce(auto, '') <> '' WHEN 3 THEN coalesce(auto, '') <> {_GENERATED} ELSE false END AS changed
FROM (SELECT *, content_id % 5 AS k, {st.collapse("('Reply ' || content_id || ' ' || coalesce(auto, ''))")} AS line FROM described)
UNION ALL
SELECT site_id, content_id, 'request',
 CASE WHEN r = 'reset' OR (r = 'regenerate' AND job_status <> 'pending') THEN NULL ELSE auto END,
 CASE r WHEN 'set' THEN CASE WHEN content_id % 10 = 0 THEN NULL ELSE 'Own words' END WHEN 'clear' THEN NULL WHEN 'reset' THEN NULL ELSE manual END,
 CASE WHEN r = 'reset' OR (r = 'regenerate' AND job_status <> 'pending') THEN NULL ELSE job_status END,
 CASE r WHEN 'set' THEN CASE WHEN content_id % 10 = 0 THEN coalesce(manual, '') <> '' ELSE true END WHEN 'clear' THEN coalesce(manual, '') <> ''
  WHEN 'reset' THEN coalesce(manual, '') <> '' OR coalesce(auto, '') <> '' ELSE false END
FROM (SELECT *, CASE content_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'clear' WHEN 2 THEN 'regenerate' WHEN 3 THEN 'reset' ELSE '' END AS r FROM described)""",
    "described"))
def description_apply(spark, folder):
    rows = Inputs(spark, folder).descriptions
    cid, kind = F.col("content_id"), F.col("content_id") % 5
    results = rows.filter(kind < 4).select(
        *KEY, (kind == 0).alias("below_floor"),
        F.when(kind == 1, F.lit("network")).alias("error_code"), (cid % 2 == 0).alias("needs_retry"),
        F.when(kind == 2, F.lit("EMPTY"))
        .otherwise(F.concat(F.lit("Summary: Reply "), cid.cast("string"), F.lit(" "), F.coalesce("auto", F.lit(""))))
        .alias("reply"), F.expr(samples.MODIFIED).alias("modified_at"))
    requests = rows.filter(kind < 4).select(
        *KEY, samples.case_of(kind, {0: "set", 1: "clear", 2: "regenerate"}, "reset").alias("request"),
        F.when(cid % 10 == 0, F.lit(" <b></b> ")).otherwise(F.lit("Description:  Own\nwords")).alias("manual_text"))
    shown = (*KEY, "kind", "auto", "manual", "job_status", "changed")
    applied = ds.apply_results(rows, results).withColumn("kind", F.lit("result")).select(*shown)
    asked = ds.apply_requests(rows, requests).withColumn("kind", F.lit("request")).select(*shown)
    return applied.unionByName(asked)


# --- index ---------------------------------------------------------------------------


@query("index_entries", st.statement("""
SELECT site_id, content_id, label, CAST(type_order AS INTEGER) AS type_order, CAST(type_rank AS INTEGER) AS type_rank, title, url, description FROM entries""", "entries"))
def index_entries(spark, folder):
    return Inputs(spark, folder).entries.select(*KEY, "label", "type_order", "type_rank", "title", "url", "description")


@query("index_sections", st.statement("""
SELECT site_id, CAST(section_kind AS INTEGER) AS section_kind, CAST(section_pos AS BIGINT) AS section_pos, label, count(*) AS entries,
 count(CASE WHEN entry_kind = 0 THEN 1 END) AS curated FROM placed GROUP BY ALL""", "placed"))
def index_sections(spark, folder):
    rows = Inputs(spark, folder).rows
    return rows.groupBy("site_id", "section_kind", "section_pos", "label").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("entry_kind") == 0).alias("curated"))


@query("index_line", st.statement("SELECT site_id, label, content_id, url, line FROM lined", "lined"))
def index_line(spark, folder):
    return Inputs(spark, folder).lines.select("site_id", "label", "content_id", "url", "line")


@query("index_body", st.statement("SELECT site_id, body, lines FROM site_bodies", "site_bodies"))
def index_body(spark, folder):
    return Inputs(spark, folder).bodies_of_sites.select("site_id", "body", "lines")


@query("index_parts", st.statement(f"""
SELECT site_id, '' AS part, CASE WHEN site_name = '' AND site_id NOT IN (SELECT site_id FROM lined) THEN '' ELSE header END AS body, 0::BIGINT AS lines FROM heads
UNION ALL
SELECT site_id, format('{{:d}} {{:019d}} {{}} {{:d}} {{:019d}} {{:019d}}', section_kind, section_pos, hex(label), entry_kind, place, slot),
 CASE WHEN bool_or(first) THEN chr(10) || '## ' || {st.escape_inline('label')} || chr(10) || chr(10) ELSE '' END
  || string_agg(line || chr(10), '' ORDER BY entry_pos), count(*)
FROM (SELECT *, CASE entry_kind WHEN 1 THEN group_pos ELSE 0 END AS place, entry_pos // 100 AS slot,
  row_number() OVER (PARTITION BY site_id, label ORDER BY entry_kind, group_pos, entry_pos) = 1 AS first FROM lined)
GROUP BY site_id, section_kind, section_pos, entry_kind, place, slot, label""", "lined", "heads"))
def index_parts(spark, folder):
    inputs = Inputs(spark, folder)
    return site_index.index_parts(inputs.lines, inputs.profile, lines_per_piece=100)


@query("index_artifact", st.statement(r"""
SELECT site_id, CAST(strlen(body) AS BIGINT) AS body_bytes, CAST(len(regexp_extract_all(body, '\n- ')) AS BIGINT) AS entry_count, sha1(body) AS head_sha1
FROM site_bodies""", "site_bodies"))
def index_artifact(spark, folder):
    return site_index.index_artifact(Inputs(spark, folder).bodies_of_sites)


@query("full_index", st.statement("""
SELECT site_id, CAST(section_kind AS INTEGER) AS section_kind, CAST(section_pos AS BIGINT) AS section_pos, label, entry_pos, content_id, text FROM full_rows""", "full_rows"))
def full_index(spark, folder):
    return Inputs(spark, folder).full_rows


@query("full_artifact", st.statement(r"""
SELECT h.site_id, CAST(strlen(CASE WHEN f.n IS NULL AND site_name = '' THEN '' ELSE header END) + coalesce(bytes, 0) AS BIGINT) AS body_bytes,
 coalesce(heads, 0)::BIGINT AS doc_count_text, coalesce(docs, 0) AS doc_count
FROM heads h LEFT JOIN (SELECT site_id, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, count(content_id) AS docs,
 sum(len(regexp_extract_all(text, '\n### ')))::BIGINT AS heads FROM full_rows GROUP BY site_id) f USING (site_id)""", "full_rows", "heads"))
def full_artifact(spark, folder):
    inputs = Inputs(spark, folder)
    return site_index.full_artifact(inputs.full_rows, inputs.profile)


@query("index_status", st.statement(r"""
SELECT site_id, field, value, field || '=' || value AS line FROM (
 SELECT site_id, unnest(['cache_populated', 'entry_count', 'body_bytes', 'conflicts_detected']) AS field,
  unnest(['yes', CAST(len(regexp_extract_all(body, '\n- ')) AS VARCHAR), CAST(strlen(body) AS VARCHAR), CAST(coalesce(n, 0) AS VARCHAR)]) AS value
 FROM site_bodies LEFT JOIN (SELECT regexp_extract(site_id, '([^.]+\.[^.]+)$', 1) AS site_id, sum(conflicts)::BIGINT AS n FROM printed GROUP BY 1) USING (site_id))""",
    "site_bodies", "printed"))
def index_status(spark, folder):
    inputs = Inputs(spark, folder)
    artifacts = site_index.index_artifact(inputs.bodies_of_sites)
    counts = cf.fingerprints(inputs.conflicts).groupBy(
        F.regexp_extract("site_id", r"([^.]+\.[^.]+)$", 1).alias("site_id")).agg(F.sum("conflicts").alias("conflicts"))
    return publish.index_status(artifacts, inputs.profile, counts)


# --- conflicts and coverage ----------------------------------------------------------


@query("conflicts", st.statement("SELECT site_id, kind, slug, name, url, shape, path, rule FROM conflicted", "conflicted"))
def conflicts(spark, folder):
    return Inputs(spark, folder).conflicts.select("site_id", "kind", "slug", "name", "url", "shape", "path", "rule")


@query("conflict_fingerprint", st.statement("SELECT site_id, fingerprint, conflicts FROM printed", "printed"))
def conflict_fingerprint(spark, folder):
    return cf.fingerprints(Inputs(spark, folder).conflicts)


@query("conflicts_open", st.statement(
    "SELECT site_id, fingerprint, conflicts FROM printed WHERE conflicts <> 2", "printed"))
def conflicts_open(spark, folder):
    prints = cf.fingerprints(Inputs(spark, folder).conflicts)
    dismissed = prints.select("site_id", F.when(F.col("conflicts") == 2, F.col("fingerprint"))
                              .otherwise(F.lit("another")).alias("fingerprint"))
    return cf.open_conflicts(prints, dismissed)


@query("seo_posture", st.statement("""
SELECT site_id, CASE o WHEN 0 THEN 'yoast' WHEN 1 THEN 'rank_math' WHEN 2 THEN 'aioseo' ELSE 'none' END AS posture,
 CASE o WHEN 0 THEN 'Yoast SEO' WHEN 1 THEN 'Rank Math' WHEN 2 THEN 'All in One SEO' ELSE '' END AS label,
 CASE WHEN o IS NULL THEN '' ELSE 'plugin_file' END AS detected_via
FROM (SELECT site_id, min(CASE split_part(slug, '/', 1) WHEN 'wordpress-seo' THEN 0 WHEN 'seo-by-rank-math' THEN 1 WHEN 'all-in-one-seo-pack' THEN 2 END) AS o
 FROM plugins GROUP BY site_id)""", "plugins"))
def seo_posture(spark, folder):
    return cf.seo_posture(Inputs(spark, folder).sample("active_plugins"))


_PARTIAL = {"yoast": ("WebSite", "Organization", "WebPage", "Article", "BreadcrumbList"),
            "rank_math": ("Organization", "BreadcrumbList", "WebSite")}


@query("coverage_gap", st.statement("""
SELECT site_id, CASE WHEN o = 0 THEN '' WHEN o = 1 THEN 'WebPage|Article' ELSE 'WebSite|Organization|WebPage|Article' END AS gap,
 CASE WHEN o = 0 THEN 'WebSite|Organization|WebPage|Article' WHEN o = 1 THEN 'WebSite|Organization' ELSE '' END AS deferred
FROM (SELECT site_id, min(CASE split_part(slug, '/', 1) WHEN 'wordpress-seo' THEN 0 WHEN 'seo-by-rank-math' THEN 1 WHEN 'all-in-one-seo-pack' THEN 2 END) AS o
 FROM plugins GROUP BY site_id)""", "plugins"))
def coverage_gap(spark, folder):
    postures = cf.seo_posture(Inputs(spark, folder).sample("active_plugins"))
    return postures.select(
        "site_id", F.array_join(cf.coverage_gap(F.col("posture"), matrix=_PARTIAL), "|").alias("gap"),
        F.array_join(cf.coverage_deferred(F.col("posture"), matrix=_PARTIAL), "|").alias("deferred"))


# --- measures ------------------------------------------------------------------------


@query("markdown_stats", st.statement("""
SELECT site_id, count(*) AS rows_total, count(quality_score) AS rows_with_score, round(avg(quality_score), 9) AS mean_quality,
 count(CASE WHEN quality_score >= 70 THEN 1 END) AS rows_above_threshold FROM bodies GROUP BY site_id""", "bodies"))
def markdown_stats(spark, folder):
    return audit.markdown_stats(Inputs(spark, folder).bodies).withColumn("mean_quality", F.round("mean_quality", 9))


@query("body_quality", st.statement("SELECT site_id, content_id, is_empty, is_noisy FROM judged", "judged"))
def body_quality(spark, folder):
    return audit.body_quality(Inputs(spark, folder).bodies).select(*KEY, "is_empty", "is_noisy")


_RATES = """
SELECT site_id, count(*) AS sampled, round(avg(is_empty::INT), 9) AS empty_ratio, round(avg(is_noisy::INT), 9) AS noisy_ratio
FROM judged {} GROUP BY site_id"""


def _rounded_rates(rates):
    return rates.withColumns({c: F.round(c, 9) for c in ("empty_ratio", "noisy_ratio")})


@query("body_quality_rates", st.statement(_RATES.format(""), "judged"))
def body_quality_rates(spark, folder):
    return _rounded_rates(audit.body_quality_rates(Inputs(spark, folder).bodies))


@query("body_quality_sample", st.statement(_RATES.format(
    "WHERE (site_id, content_id) IN (SELECT site_id, content_id FROM judged QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY content_id) <= 50)"),
    "judged"))
def body_quality_sample(spark, folder):
    return _rounded_rates(audit.body_quality_rates(Inputs(spark, folder).bodies, sample=audit.SAMPLE_LIMIT))


@query("worst_documents", st.statement("""
SELECT s.site_id, s.content_id, s.quality_score, CAST(rank AS INTEGER) AS rank, c.title, c.permalink
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY quality_score, content_id) AS rank FROM stored WHERE quality_score IS NOT NULL) s
JOIN content c USING (site_id, content_id) WHERE rank <= 5""", "stored", "content"))
def worst_documents(spark, folder):
    inputs = Inputs(spark, folder)
    return audit.worst_documents(inputs.store, inputs.content)


@query("description_coverage", st.statement("""
SELECT site_id, count(*) AS total_entries, count(CASE WHEN description <> '' THEN 1 END) AS entries_with_description
FROM entries GROUP BY site_id""", "entries"))
def description_coverage(spark, folder):
    return audit.description_coverage(Inputs(spark, folder).entries)


def _channels(inputs: Inputs):
    probes = inputs.sample("root_files").groupBy("site_id").agg(
        F.bool_or(F.col("path") == "/llms.txt").alias("has_ai_txt"),
        F.bool_or(F.col("path") == "/sub/llms.txt").alias("has_ai_layer"),
        F.count(F.lit(1)).alias("_n")).select(
            "*", (F.col("_n") > 3).alias("has_policy"), (F.col("_n") > 4).alias("has_openapi_json"),
            F.lit(None).cast("boolean").alias("has_openapi_yaml"), (F.col("_n") == 1).alias("has_swagger"))
    sites = inputs.sample("hosts").groupBy("site_id").agg(
        (F.min("page_id") % 2 == 0).alias("channels_enabled")).withColumn(
            "home_url", F.concat(F.lit("https://"), "site_id", F.lit("/")))
    providers = cf.active_provider(inputs.sample("active_plugins"), sites)
    return audit.channel_presence(probes.drop("_n"), sites, providers)


@query("channel_presence", st.statement("""
SELECT site_id, own OR f0 AS ai_txt_present, own OR f1 OR provided AS ai_layer_present, own OR n > 3 AS policy_present,
 n > 4 OR n = 1 AS openapi_present, CASE WHEN provided THEN 'AI Layer' END AS provider_name,
 CASE WHEN provided THEN 'https://' || site_id || '/wp-admin/admin.php?page=ai-layer' END AS provider_config_url
FROM (SELECT site_id, min(page_id) % 2 = 0 AS own, bool_or(page_id % 6 = 0) AS f0, bool_or(page_id % 6 = 1) AS f1, count(*) AS n,
 bool_or(page_id % 11 = 6) AS provided FROM hosted GROUP BY site_id)""", "hosted"))
def channel_presence(spark, folder):
    return _channels(Inputs(spark, folder)).drop("provider_slug")


# --- audit ---------------------------------------------------------------------------


@query("site_signals", st.statement("""
SELECT p.site_id, len(exposed_types)::INTEGER AS types, coalesce(entries, 0) AS entry_count, coalesce(rows_total, 0) AS rows_total,
 coalesce(rows_with_score, 0) AS rows_with_score, round(coalesce(mean, 0), 9) AS mean_quality, coalesce(above, 0) AS rows_above_threshold,
 coalesce(total, 0) AS total_entries, coalesce(described, 0) AS entries_with_description, seo_posture AS seo_plugin, client_configured,
 coalesce(entries, 0) > 0 AS index_populated, p.channels_enabled AS ai_txt_present, coalesce(kinds, '') AS conflict_kinds, coalesce(worst, '') AS worst
FROM profile p
LEFT JOIN (SELECT site_id, len(regexp_extract_all(body, chr(10) || '- ')) AS entries FROM site_bodies) USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS rows_total, count(quality_score) AS rows_with_score, avg(quality_score) AS mean,
 count(CASE WHEN quality_score >= 70 THEN 1 END) AS above FROM stored GROUP BY site_id) USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS total, count(CASE WHEN description <> '' THEN 1 END) AS described FROM entries GROUP BY site_id) USING (site_id)
LEFT JOIN (SELECT regexp_extract(site_id, '([^.]+[.][^.]+)$', 1) AS site_id, string_agg(DISTINCT kind, ',' ORDER BY kind DESC) AS kinds FROM conflicted GROUP BY 1) USING (site_id)
LEFT JOIN (SELECT site_id, string_agg(title, '|' ORDER BY quality_score, content_id) AS worst FROM (
 SELECT * FROM stored JOIN content USING (site_id, content_id) WHERE quality_score IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY quality_score, content_id) <= 5) GROUP BY site_id) USING (site_id)""",
    "profile", "site_bodies", "stored", "entries", "conflicted"))
def site_signals(spark, folder):
    signals = assembled_signals(Inputs(spark, folder))
    # The SQL orders kinds by name, so the detection order is not compared here.
    kinds = F.array_join(F.reverse(F.sort_array("conflict_kinds")), ",")
    return signals.select(
        "site_id", F.size("exposed_types").alias("types"), "entry_count", "rows_total", "rows_with_score",
        F.round("mean_quality", 9).alias("mean_quality"), "rows_above_threshold", "total_entries",
        "entries_with_description", "seo_plugin", "client_configured", "index_populated", "ai_txt_present",
        kinds.alias("conflict_kinds"), F.array_join("worst_titles", "|").alias("worst"))


def assembled_signals(inputs: Inputs):
    """The full audit input of the three page sites, from all their tables."""
    site = F.regexp_extract("site_id", r"([^.]+\.[^.]+)$", 1)
    found = inputs.conflicts.withColumn("site_id", site)
    presence = inputs.profile.select(
        "site_id", F.col("channels_enabled").alias("ai_txt_present"), F.col("channels_enabled").alias("ai_layer_present"),
        F.col("channels_enabled").alias("policy_present"), F.lit(False).alias("openapi_present"),
        F.lit(None).cast("string").alias("provider_slug"), F.lit(None).cast("string").alias("provider_name"),
        F.lit(None).cast("string").alias("provider_config_url"))
    return audit.assemble_signals(
        inputs.profile, site_index.index_measures(inputs.rows), found,
        audit.markdown_stats(inputs.store), audit.body_quality_rates(inputs.store, sample=None),
        audit.worst_documents(inputs.store, inputs.content), presence)


def _audit_query(key: str, name: str) -> None:
    sql = st.statement(f"""
SELECT site_id, name, CAST(value AS INTEGER) AS value, CAST(weight AS INTEGER) AS weight, codes FROM sub WHERE name = '{name}'""", "sub")

    @query(key, sql)
    def run(spark, folder):
        scores = audit.sub_scores(Inputs(spark, folder).signals, only=[name])
        codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
        return scores.select("site_id", "name", "value", "weight", codes.alias("codes"))


for _key, _name in (
        ("audit_discoverability", "discoverability"), ("audit_readability", "content_readability"),
        ("audit_schema", "schema_coverage"), ("audit_safety", "exposure_safety"),
        ("audit_integration", "integration_health"), ("audit_conversion", "md_conversion_quality"),
        ("audit_channels", "multi_channel_discovery")):
    _audit_query(_key, _name)


_ARGS = """CASE code WHEN 'disc_cpt_exposed' THEN types::VARCHAR WHEN 'disc_entries_listed' THEN entry_count::VARCHAR
 WHEN 'cr_coverage_good' THEN pct::VARCHAR WHEN 'cr_coverage_medium' THEN pct::VARCHAR WHEN 'cr_coverage_low' THEN pct::VARCHAR
 WHEN 'sc_seo_plugin_detected' THEN plugin WHEN 'es_risky_statuses' THEN risky_csv
 WHEN 'ih_llms_txt_conflict' THEN CASE WHEN rewritten THEN 'plugin, rewrite' ELSE 'plugin' END
 WHEN 'mcq_mean_quality' THEN rows_with_score || '|' || mean_int WHEN 'mcq_above_threshold' THEN above_pct || '|70'
 WHEN 'mcq_empty_bodies' THEN empty_pct || '|' || n WHEN 'mcq_noisy_bodies' THEN noisy_pct || '|' || n
 WHEN 'mcd_channels_detected' THEN channels::VARCHAR WHEN 'mcd_provider_detected' THEN 'AI Layer'
 WHEN 'mcd_provider_configurable' THEN 'AI Layer|https://a.example/wp-admin/admin.php?page=ai-layer' ELSE '' END"""


def _reason_text() -> str:
    branches = []
    for code, template in audit.REASONS.items():
        count = template.replace("%%", "").count("%")
        args = [f"split_part(args, '|', {i + 1})" for i in range(count)]
        branches.append(f"WHEN '{code}' THEN {st.text_format(template, *args)}")
    return "CASE code " + " ".join(branches) + " END"


@query("audit_reasons", st.statement(f"""
SELECT site_id, name, position, code, args, {_reason_text()} AS text FROM (
 SELECT s.site_id, name, CAST(position AS INTEGER) AS position, code, {_ARGS} AS args
 FROM (SELECT site_id, name, unnest(string_split(codes, ',')) AS code, unnest(range(len(string_split(codes, ',')))) AS position FROM sub) r
 JOIN scored_sites s USING (site_id))""", "sub"))
def audit_reasons(spark, folder):
    return audit.reason_rows(audit.sub_scores(Inputs(spark, folder).signals))


@query("overall_score", st.statement(
    "SELECT site_id, CAST(floor(sum(value * weight) / 100) AS INTEGER) AS overall FROM sub GROUP BY site_id", "sub"))
def overall_score(spark, folder):
    return audit.overall(audit.sub_scores(Inputs(spark, folder).signals, details=False))


_LABELS = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in audit.LABELS.items())
_BEST = """SELECT site_id, coalesce((list(name ORDER BY (100 - value) * weight DESC, name) FILTER (value < 100))[1], '') AS best_name,
 count(CASE WHEN value < 100 THEN 1 END) AS below_target, CAST(floor(sum(value * weight) / 100) AS INTEGER) AS overall FROM sub GROUP BY site_id"""


@query("leverage", st.statement(
    f"SELECT site_id, best_name, CASE best_name {_LABELS} ELSE '' END AS best_label, below_target FROM ({_BEST})", "sub"))
def leverage(spark, folder):
    return audit.leverage(audit.sub_scores(Inputs(spark, folder).signals, details=False))


@query("health_band", st.statement(f"""
SELECT site_id, CASE WHEN audited THEN overall END AS overall,
 CASE WHEN NOT audited THEN 'recommended' WHEN overall >= 80 THEN 'good' WHEN overall >= 50 THEN 'recommended' ELSE 'critical' END AS status,
 CASE WHEN NOT audited THEN 'gray' WHEN overall >= 80 THEN 'green' WHEN overall >= 50 THEN 'orange' ELSE 'red' END AS badge,
 CASE WHEN NOT audited THEN '{audit.ENGINE_NAME} Context Score has not been computed yet.'
  WHEN overall >= 80 THEN '{audit.ENGINE_NAME} Context Score: ' || overall || '/100 — site is well-prepared for AI agent traffic.'
  ELSE '{audit.ENGINE_NAME} Context Score: ' || overall || '/100 — ' || below_target || ' sub-score(s) below target.' END AS label
FROM (SELECT *, site_id <> 'src5' AS audited FROM ({_BEST}))""", "sub"))
def health_band(spark, folder):
    signals = Inputs(spark, folder).signals
    scores = audit.sub_scores(signals, details=False)
    audited = audit.overall(scores).filter(F.col("site_id") != "src5")
    return audit.health(signals, audited, audit.leverage(scores)).drop("best_name")


@query("late_result", """
SELECT conv_id, count(*) FILTER (stamp = newest) AS kept FROM (
 SELECT conv_id, turn // 2 AS stamp, max(turn // 2) OVER (PARTITION BY conv_id) AS newest FROM conversations) GROUP BY conv_id""")
def late_result(spark, folder):
    turns = samples.table(spark, folder, "conversations")
    results = turns.select(F.col("conv_id").alias("site_id"), F.floor(F.col("turn") / 2).alias("computed_at"), "text")
    audits = results.groupBy("site_id").agg(F.max("computed_at").alias("computed_at"))
    kept = audit.keep_current(results, audits)
    return kept.groupBy(F.col("site_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("kept"))


# --- narrative -----------------------------------------------------------------------


def _rule_sql(part: int) -> str:
    """The expected sentence, restated as SQL conditions over the same facts."""

    def say(area: str, case: str, *args: str) -> str:
        template = narrative.RULE_TEXT[area][case][part]
        used = args[:template.replace("%%", "").count("%")]
        return st.text_format(template, *used) if template else "''"

    d, c, s, e = "discoverability", "content_readability", "schema_coverage", "exposure_safety"
    i, m, x = "integration_health", "md_conversion_quality", "multi_channel_discovery"
    index_url = "('https://' || site_id || '.example/llms.txt')"
    fix_c = f"CASE WHEN wanted THEN {say(c, 'fix_on')} ELSE {say(c, 'fix_off')} END"
    fix_m = f"CASE WHEN k % 2 = 1 THEN {say(m, 'fix_worst', chr(39) + 'First title, Second, title' + chr(39))} ELSE {say(m, 'fix_any')} END"

    def mixed(area, case, fix, *args):
        return say(area, case, *args) if part == 0 else fix

    return f"""CASE name
 WHEN '{d}' THEN CASE WHEN rewritten THEN {say(d, 'conflict')} WHEN populated AND advertised AND static_robots THEN {say(d, 'static_robots', index_url)}
  WHEN value >= 100 THEN {say(d, 'good')} WHEN NOT populated THEN {say(d, 'empty')} WHEN types = 0 THEN {say(d, 'no_types')}
  WHEN entry_count <= 0 THEN {say(d, 'no_entries')} ELSE {say(d, 'partial')} END
 WHEN '{c}' THEN CASE WHEN value >= 100 THEN {say(c, 'good')} WHEN total_entries <= 0 THEN {say(c, 'no_entries')}
  WHEN value < 50 THEN {mixed(c, 'critical', fix_c, 'pct')} ELSE {mixed(c, 'partial', fix_c, 'pct')} END
 WHEN '{s}' THEN CASE WHEN value >= 100 AND plugin <> '' THEN {say(s, 'plugin', 'plugin')} WHEN value >= 100 AND native THEN {say(s, 'native')} ELSE {say(s, 'none')} END
 WHEN '{e}' THEN CASE WHEN value >= 100 THEN {say(e, 'good')} WHEN risky > 0 THEN {say(e, 'risky', 'risky')} WHEN types = 0 THEN {say(e, 'no_types')} ELSE {say(e, 'partial')} END
 WHEN '{i}' THEN CASE WHEN value >= 100 AND wanted THEN {say(i, 'good_on')} WHEN value >= 100 THEN {say(i, 'good_off')}
  WHEN wanted AND NOT client THEN {say(i, 'unconfigured')} WHEN conflicts > 0 THEN {say(i, 'conflict', 'conflicts')} ELSE {say(i, 'partial')} END
 WHEN '{m}' THEN CASE WHEN value >= 100 THEN {say(m, 'good')} WHEN rows_total <= 0 THEN {say(m, 'no_rows')}
  WHEN empty_pct > 0 AND empty_pct >= noisy_pct THEN {mixed(m, 'empty', fix_m, 'empty_pct', 'n', 'rows_total')}
  WHEN noisy_pct > 0 THEN {mixed(m, 'noisy', fix_m, 'noisy_pct', 'n', 'rows_total')}
  WHEN value < 50 THEN {say(m, 'critical', 'mean_int', 'above_pct')} ELSE {say(m, 'partial', 'mean_int', 'above_pct')} END
 ELSE CASE WHEN value >= 100 AND provided THEN {say(x, 'good_provider', "'AI Layer'")} WHEN value >= 100 THEN {say(x, 'good')} WHEN value <= 0 THEN {say(x, 'none')}
  WHEN provided THEN {say(x, 'partial_provider', 'channels', "'AI Layer'")} ELSE {say(x, 'partial', 'channels')} END END"""


_RULED = f"""(SELECT site_id, name, k, value, weight, {st.cap('why_raw', 140, '…', 139)} AS why, {st.cap('fix_raw', 140, '…', 139)} AS fix
 FROM (SELECT *, {_rule_sql(0)} AS why_raw, {_rule_sql(1)} AS fix_raw FROM sub JOIN scored_sites USING (site_id)))"""


@query("rule_narrative", st.statement(f"SELECT site_id, name, why, fix FROM {_RULED}", "sub"))
def rule_narrative(spark, folder):
    return narrative.rule_narrative(audit.sub_scores(Inputs(spark, folder).signals)).select("site_id", "name", "why", "fix")


@query("narrative_parse", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE names END AS names, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE {st.cap('line', 140, '…', 139)} END AS why
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'a' ELSE 'a,b' END AS names, {st.collapse(st.strip("('W ' || text)"))} AS line FROM documents)""")
def narrative_parse(spark, folder):
    why = F.concat(F.lit("W "), F.col("text"))
    pair = F.struct(why.alias("why"), F.lit("do it").alias("fix"))
    half = F.struct(F.lit(" ").alias("why"), F.lit("x").alias("fix"))
    doc = F.col("doc_id") % 4
    whole = F.to_json(F.struct(pair.alias("a"), pair.alias("b")))
    partial = F.to_json(F.struct(pair.alias("a"), half.alias("b"), F.lit("text").alias("c")))
    reply = (F.when(doc == 0, whole).when(doc == 1, partial)
             .when(doc == 2, F.concat(F.lit(" ```json\n"), whole, F.lit("\n``` thanks")))
             .otherwise(F.concat(F.lit("not json "), whole)))
    parsed = narrative.parse_reply(reply)
    return samples.table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.sort_array(F.map_keys(parsed)), ",").alias("names"),
        F.try_element_at(parsed, F.lit("a"))["why"].alias("why"))


@query("allowlist", st.statement(r"""
SELECT site_id, name, list_aggregate(list_sort(list_distinct(list_concat(nums, list_transform(nums, lambda x: x || '%'), list_transform(nums, lambda x: x || '/100')))), 'string_agg', ' ') AS numbers FROM (
 SELECT site_id, name, list_distinct(list_concat([CAST(value AS VARCHAR), CAST(weight AS VARCHAR)], CASE name
  WHEN 'exposure_safety' THEN list_concat([CAST(types AS VARCHAR), CAST(risky AS VARCHAR)], [])
  WHEN 'integration_health' THEN [wanted::INT::VARCHAR, client::INT::VARCHAR, CAST(conflicts AS VARCHAR)]
  WHEN 'content_readability' THEN [CAST(total_entries AS VARCHAR), CAST(least(described, total_entries) AS VARCHAR), CAST(pct AS VARCHAR), wanted::INT::VARCHAR]
  WHEN 'schema_coverage' THEN [native::INT::VARCHAR]
  WHEN 'discoverability' THEN list_concat([populated::INT::VARCHAR, CAST(types AS VARCHAR), CAST(entry_count AS VARCHAR), rewritten::INT::VARCHAR,
    static_robots::INT::VARCHAR, advertised::INT::VARCHAR], regexp_extract_all(site_id, '[0-9]+'))
  WHEN 'md_conversion_quality' THEN list_concat([CAST(rows_total AS VARCHAR), CAST(rows_with_score AS VARCHAR), '70'], CASE WHEN has_scores THEN
    list_concat([CAST(mean_int AS VARCHAR), '100', CAST(rows_above AS VARCHAR), CAST(above_pct AS VARCHAR), CAST(n AS VARCHAR), CAST(empty_pct AS VARCHAR), CAST(noisy_pct AS VARCHAR)],
     CASE WHEN k % 2 = 1 THEN ['17'] ELSE [] END) ELSE ['0'] END)
  ELSE list_concat([populated::INT::VARCHAR, (k % 2 = 0)::INT::VARCHAR, layer::INT::VARCHAR, (k % 5 < 3)::INT::VARCHAR, openapi::INT::VARCHAR, CAST(channels AS VARCHAR)],
    CASE WHEN channels > 0 THEN ['4'] ELSE [] END) END)) AS nums
 FROM sub JOIN scored_sites USING (site_id))""", "sub"))
def allowlist(spark, folder):
    scores = audit.sub_scores(Inputs(spark, folder).signals)
    return scores.select("site_id", "name", F.array_join(F.sort_array(guard.allowed_numbers()), " ").alias("numbers"))


@query("narrative_guard", st.statement(f"""
SELECT site_id, name, CASE WHEN kept THEN 'The value is ' || value || '/100. Review the Context Profile.' ELSE why END AS why,
 CASE WHEN kept THEN 'Open the settings.' ELSE fix END AS fix, CASE WHEN kept THEN 'llm' ELSE 'rule_based' END AS source,
 CASE WHEN n = 0 THEN 'rule_based' WHEN n = 7 THEN 'llm' ELSE 'mixed' END AS mode, n = 0 AS degraded
FROM (SELECT *, count(CASE WHEN kept THEN 1 END) OVER (PARTITION BY site_id) AS n FROM (
 SELECT *, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN name <> 'exposure_safety' WHEN 2 THEN false ELSE name = 'discoverability' END AS kept FROM {_RULED}))""", "sub"))
def narrative_guard(spark, folder):
    ruled = narrative.rule_narrative(audit.sub_scores(Inputs(spark, folder).signals))
    number = F.regexp_extract("site_id", "([0-9]+)$", 1).cast("int") % 4
    good = F.concat(F.lit("The value is "), F.col("value").cast("string"), F.lit("/100. Review the Context Profile."))
    invented = F.lit("Please install Acme Booster Pro, 98765% better.")
    said = (F.when(number == 0, good).when((number == 1) & (F.col("name") == "exposure_safety"), invented)
            .when(number == 1, good).when(number == 2, invented).when(F.col("name") == "discoverability", good))
    entry = F.struct(F.col("name").alias("key"), F.struct(said.alias("why"), F.lit("Open the settings.").alias("fix"))
                     .alias("value"))
    # Seven sub-scores per site: the reply of a site is a small group by construction.
    replies = ruled.groupBy("site_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("reply"))
    return narrative.guarded_narrative(ruled, replies)


# --- publishing ----------------------------------------------------------------------


@query("channel_docs", st.statement(f"""
SELECT site_id, '# ai.txt for ' || name || chr(10) || '# AI-agent guidance. Served dynamically by the {audit.ENGINE_NAME} plugin.' || chr(10) || chr(10)
 || 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'LLMs-Index: ' || home_url || 'llms.txt' || chr(10)
 || CASE WHEN sitemap_url <> '' THEN 'Sitemap: ' || sitemap_url || chr(10) ELSE '' END || chr(10)
 || '# Usage policy (declarative — see /.well-known/llms-policy.json)' || chr(10)
 || 'Inference: ' || CASE WHEN allow_inference THEN 'allowed' ELSE 'disallowed' END || chr(10)
 || 'Training: ' || CASE WHEN allow_training THEN 'allowed' ELSE 'disallowed' END || chr(10) AS ai_txt,
 '{{"version":1,"organization":"' || name || '","website":"' || home_url || '","llms_txt":"' || home_url || 'llms.txt","policy":{{"allow_inference":'
 || allow_inference || ',"allow_training":' || allow_training || '}}' || CASE WHEN sitemap_url <> '' THEN ',"sitemap":"' || sitemap_url || '"' ELSE '' END || '}}' AS llms_policy,
 '{{"version":1,"name":"' || name || '","website":"' || home_url || '","generator":"{audit.ENGINE_NAME.lower()}","channels":{{"llms_txt":"' || home_url || 'llms.txt","ai_txt":"'
 || home_url || 'ai.txt","llms_policy":"' || home_url || '.well-known/llms-policy.json","markdown_views":' || markdown_enabled || '}}}}' AS ai_layer
FROM (SELECT *, CASE WHEN site_name = '' THEN site_id ELSE replace(site_name, chr(10), ' ') END AS name FROM profile)""", "profile"))
def channel_docs(spark, folder):
    return publish.channel_documents(Inputs(spark, folder).profile)


def _with_twin_state(inputs: Inputs):
    state = store.known_empty(inputs.gated(), inputs.store)
    mirrored = inputs.light.filter(F.col("content_id") % 4 == 0).select(
        *KEY, F.concat(F.col("content_id").cast("string"), F.lit(".md")).alias("mirrored_path"))
    return state.join(mirrored, KEY, "left")


@query("alternate_links", st.statement(f"""
SELECT site_id, content_id, '<link rel="alternate" type="text/markdown" href="' || replace(md, '&', '&#038;') || '" />' || chr(10) AS link_tag,
 '<' || md || '>; rel="alternate"; type="text/markdown"' AS link_header,
 '# AI-readable content index ({audit.ENGINE_NAME.lower()}): ' || home_url || 'llms.txt' AS robots_line,
 CASE WHEN content_id % 4 = 0 THEN home_url || 'uploads/md/' || content_id || '.md' ELSE md END AS twin_url
FROM (SELECT g.*, {st.markdown_url('permalink')} AS md FROM gate g LEFT JOIN stored s USING (site_id, content_id)
 WHERE reason IS NULL AND advertise_enabled AND markdown_enabled AND NOT coalesce({st.trim('markdown')} = '', false))""", "gate", "stored"))
def alternate_links(spark, folder):
    return publish.alternate_links(_with_twin_state(Inputs(spark, folder)))


@query("structured_data", st.statement(r"""
SELECT site_id, content_id, CAST(len(nodes) AS INTEGER) AS nodes,
 replace(replace(CASE len(nodes) WHEN 1 THEN nodes[1] ELSE '[' || array_to_string(nodes, ',') || ']' END, '<', '\u003C'), '>', '\u003E') AS json_ld
FROM (SELECT *, list_filter([
 CASE WHEN ending = '.com' THEN '{"@context":"https://schema.org","@type":"WebSite","@id":"' || home_url || '#website","url":"' || home_url || '","name":' || to_json(site_name) || ',"inLanguage":"en-US"}' END,
 CASE WHEN ending = '.com' THEN '{"@context":"https://schema.org","@type":"Organization","@id":"' || home_url || '#organization","name":' || to_json(site_name) || ',"url":"' || home_url || '"}' END,
 CASE WHEN weak AND post_type <> 'post' THEN '{"@context":"https://schema.org","@type":"WebPage","@id":"' || permalink || '#webpage","url":"' || permalink || '","name":' || to_json(title) || ',"isPartOf":{"@id":"' || home_url || '#website"}}' END,
 CASE WHEN weak AND post_type = 'post' THEN '{"@context":"https://schema.org","@type":"Article","@id":"' || permalink || '#article","headline":' || to_json(title)
  || ',"datePublished":"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","dateModified":"' || strftime(modified_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","mainEntityOfPage":{"@id":"' || permalink || '#webpage"},"url":"' || permalink || '"}' END
 ], lambda n: n IS NOT NULL) AS nodes FROM (SELECT *, list_contains(exposed_types, post_type) AND list_contains(exposed_statuses, status) AS weak FROM flags WHERE structured_data_enabled))
WHERE len(nodes) > 0""", "flags"))
def structured_data(spark, folder):
    inputs = Inputs(spark, folder)
    rows = inputs.sited()
    posture = F.when(F.col("site_id").endswith(".com"), F.lit("none")).otherwise(F.lit("rank_math"))
    gap = cf.coverage_gap(posture, matrix=_PARTIAL)
    return publish.structured_data(rows.withColumns({"gap": gap, "weakly_exposed": exposure.weakly_exposed()}))


@query("front_matter", st.statement(r"""
SELECT content_id, '---' || chr(10) || 'id: ' || content_id || chr(10) || 'title: ' || to_json(title) || chr(10) || 'canonical_url: ' || to_json(permalink)
 || chr(10) || 'generated_at: "' || strftime(modified_at, '%Y-%m-%dT%H:%M:%S') || '+00:00"' || chr(10) || '---' || chr(10) || chr(10) AS head FROM content""", "content"))
def front_matter(spark, folder):
    head = publish.front_matter(F.col("content_id"), F.col("title"), F.col("permalink"),
                                publish.iso_time(F.col("modified_at")))
    return Inputs(spark, folder).light.select("content_id", head.alias("head"))


_TWIN = st.trim("coalesce(markdown, '')") + " <> ''"


@query("document_preview", st.statement(f"""
SELECT site_id, content_id, CASE WHEN {st.trim('g.title')} = '' THEN '(no title)' ELSE g.title END AS title,
 CAST(strlen(body_html) AS BIGINT) AS html_bytes, strlen(body_html) > 20000 AS html_truncated,
 CAST(CASE WHEN strlen(body_html) <= 20000 THEN strlen(body_html)
  ELSE strlen(left(body_html, list_max(list_filter(range(greatest(0, 20000 - (strlen(body_html) - length(body_html)))::BIGINT, 20001), lambda i: strlen(left(body_html, i)) <= 20000))::BIGINT)) END AS BIGINT) AS html_shown_bytes,
 CASE WHEN markdown_enabled AND reason IS NULL AND {_TWIN} THEN markdown ELSE '' END AS markdown,
 CASE WHEN NOT markdown_enabled THEN 'module_disabled' WHEN reason IS NOT NULL THEN 'not_exposable' WHEN {_TWIN} THEN 'exposable' ELSE 'error' END AS verdict,
 CASE WHEN NOT markdown_enabled THEN 'markdown_views' WHEN reason IS NOT NULL THEN reason WHEN {_TWIN} THEN NULL ELSE 'empty_content' END AS verdict_reason,
 CASE WHEN e.url IS NULL THEN '' ELSE '- [' || e.title || '](' || e.url || ')' || CASE WHEN e.description <> '' THEN ': ' || e.description ELSE '' END END AS line,
 CASE WHEN e.url IS NULL OR e.description = '' THEN 'none' WHEN {_HAS_MANUAL} OR {_HAS_AUTO} THEN 'llm' ELSE 'excerpt' END AS description_source,
 '' AS advisory
FROM gate g LEFT JOIN stored s USING (site_id, content_id) LEFT JOIN described d USING (site_id, content_id)
LEFT JOIN (SELECT site_id, content_id, title, url, description FROM entries) e USING (site_id, content_id)""", "gate", "stored", "described", "entries"))
def document_preview(spark, folder):
    inputs = Inputs(spark, folder)
    entries = inputs.entries.select(*KEY, F.col("title").alias("entry_title"), F.col("url").alias("entry_url"),
                                    F.col("description").alias("entry_description"))
    cached = inputs.descriptions.select(*KEY, F.coalesce(
        tx.present(F.col("manual")), tx.present(F.col("auto")), F.lit("")).alias("cached"))
    rows = (inputs.gated(inputs.sited(inputs.content)).join(inputs.store.select(*KEY, "markdown"), KEY, "left")
            .join(entries, KEY, "left").join(cached, KEY, "left"))
    return publish.document_preview(rows)


def mirror_states(inputs: Inputs):
    """Mirrored documents as they should be, and files as they are."""
    rows = publish.mirror_wanted(inputs.gated()).filter(~F.coalesce("reason", F.lit("")).isin("cpt", "status"))
    cid = F.col("content_id")
    wanted = rows.select(*KEY, "path", "modified_at", F.col("reason").isNull().alias("has_twin"))
    present = publish.mirror_wanted(inputs.light).filter(cid % 3 != 0).select(
        *KEY, F.when(cid % 5 == 0, F.lit("old.md")).otherwise(F.col("path")).alias("present_path"),
        F.when(cid % 4 == 0, F.col("modified_at") - F.make_dt_interval(F.lit(1))).otherwise(F.col("modified_at"))
        .alias("written_at"))
    return wanted, present


def _mirror(inputs: Inputs, newest):
    return publish.mirror_delta(*mirror_states(inputs), newest)


def _mirror_sql(limit: str) -> str:
    path = st.mirror_path("permalink", "content_id")
    batch = f"(SELECT * FROM wanted QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY modified_at DESC, content_id DESC) <= {limit})" if limit else "wanted"
    keep = "SEMI JOIN w USING (site_id, content_id)" if limit else ""
    return st.statement(f"""
SELECT site_id, content_id, w.path, p.present_path,
 CASE WHEN p.present_path = w.path AND p.written_at >= w.modified_at THEN 'keep'
  WHEN NOT coalesce(w.has_twin, false) THEN CASE WHEN p.present_path IS NULL THEN 'none' ELSE 'delete' END
  WHEN p.present_path IS NULL THEN 'write' WHEN p.present_path <> w.path THEN 'move' ELSE 'rewrite' END AS action
FROM (SELECT * FROM {batch}) w FULL JOIN (SELECT * FROM present {keep}) p USING (site_id, content_id)""", "gate").replace(
        "\nSELECT site_id, content_id, w.path", f""",
wanted AS (SELECT site_id, content_id, {path} AS path, modified_at, reason IS NULL AS has_twin FROM gate WHERE coalesce(reason, '') NOT IN ('cpt', 'status')),
w AS (SELECT * FROM {batch}),
present AS (SELECT site_id, content_id, CASE WHEN content_id % 5 = 0 THEN 'old.md' ELSE {path} END AS present_path,
 CASE WHEN content_id % 4 = 0 THEN modified_at - INTERVAL 1 DAY ELSE modified_at END AS written_at FROM gate WHERE content_id % 3 <> 0)
SELECT site_id, content_id, w.path""", 1)


@query("mirror_delta", _mirror_sql(""))
def mirror_delta(spark, folder):
    return _mirror(Inputs(spark, folder), newest=None)


@query("mirror_delta_batch", _mirror_sql("50"))
def mirror_delta_batch(spark, folder):
    return _mirror(Inputs(spark, folder), newest=publish.MIRROR_BATCH)


# --- changes -------------------------------------------------------------------------

_RELEVANT = """list_contains(exposed_types, post_type) AND CASE kind WHEN 'meta' THEN event_id % 2 = 0
 WHEN 'term' THEN event_id % 3 IN (0, 1) AND right(site_id, 4) <> '.org' ELSE true END"""


@query("relevant_changes", st.statement(f"""
SELECT event_id, site_id, content_id, kind FROM feed JOIN profile USING (site_id) WHERE {_RELEVANT}""", "feed", "profile"))
def relevant_changes(spark, folder):
    inputs = Inputs(spark, folder)
    found = triggers.relevant_changes(Inputs(spark, folder).sample("changes"), inputs.light, inputs.profile)
    return found.select("event_id", "site_id", "content_id", "kind")


@query("rebuild_triggers", st.statement(f"""
SELECT site_id, due AS fire_second FROM fires""", "feed", "profile").replace(
    "WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT site_id, due AS fire_second", f""",
marks AS (SELECT DISTINCT site_id, second FROM feed JOIN profile USING (site_id) WHERE {_RELEVANT}),
fires AS (SELECT site_id, min(second) + 5 AS due FROM marks GROUP BY site_id
 UNION ALL SELECT f.site_id, (SELECT min(m.second) + 5 FROM marks m WHERE m.site_id = f.site_id AND m.second >= f.due) AS due
 FROM fires f WHERE EXISTS (SELECT 1 FROM marks m WHERE m.site_id = f.site_id AND m.second >= f.due))
SELECT site_id, due AS fire_second""", 1))
def rebuild_triggers(spark, folder):
    inputs = Inputs(spark, folder)
    found = triggers.relevant_changes(Inputs(spark, folder).sample("changes"), inputs.light, inputs.profile)
    return triggers.rebuild_triggers(found)


@query("retry_plan", """
SELECT sha1(prompt || chr(31) || '{}') AS job, min(second) + 300 AS due_second, arg_min(failure, second * 100000 + rnk) AS first_failure FROM (
 SELECT 'Describe page ' || (user_id % 97) AS prompt, CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS second,
  CASE event_type WHEN 'error' THEN 'network' WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'unknown' ELSE 'permanent' END AS failure,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rnk FROM events) WHERE failure <> 'permanent' GROUP BY 1""")
def retry_plan(spark, folder):
    failure = samples.case_of(F.col("event_type"), {"error": "network", "view": "rate_limit", "click": "unknown"}, "permanent")
    log = samples.table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("Describe page "), (F.col("user_id") % 97).cast("string")).alias("prompt"),
        F.lit("{}").alias("options"), failure.alias("failure"))
    timed = log.join(Inputs(spark, folder).sample("changes").select("event_id", "second"), "event_id")
    return triggers.retry_plan(timed)
