"""Registered queries: what a change costs, instead of doing all again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucidex.functions import text as tx
from lucidex.operators import audit, conflicts as cf, exposure, index_chunks as ic, measures, paging, publish, site_index, text_index
from lucidex.plans import catalog_sites, jobs, statements as st
from lucidex.plans.inputs import Inputs
from lucidex.plans.registry import query
from lucidex.sources import samples, snapshots
from lucidex.sources.work import work_path, written
from lucidex.streaming import retries, triggers

KEY = ["site_id", "content_id"]

# --- pages that miss -----------------------------------------------------------------

_FETCH_SQL = st.statement("""
SELECT h.site_id, h.content_id, hash AS content_hash, sha1(body_html) AS page_sha1, CAST(strlen(body_html) AS BIGINT) AS page_bytes
FROM hashed h LEFT JOIN stored s USING (site_id, content_id)
WHERE NOT coalesce(s.content_hash = hash AND converter_version = '5', false)""", "hashed", "stored")


def _fetched(spark, folder, broadcast_keys):
    inputs = Inputs(spark, folder)
    pages, _ = jobs.fetch_missing(inputs.content, inputs.store, broadcast_keys=broadcast_keys)
    return pages.select(*KEY, "content_hash", F.sha1("body_html").alias("page_sha1"),
                        F.octet_length("body_html").cast("bigint").alias("page_bytes"))


@query("conversion_fetch", _FETCH_SQL)
def conversion_fetch(spark, folder):
    return _fetched(spark, folder, None)


@query("conversion_fetch_filtered", _FETCH_SQL)
def conversion_fetch_filtered(spark, folder):
    """The way for more keys than are broadcast."""
    return _fetched(spark, folder, 0)


# --- index parts ---------------------------------------------------------------------

#: Lines of a part on average, so that the samples have many parts.
AVERAGE = 8


def _latest_kinds(spark, folder):
    """The kind of the last event of each document."""
    events = samples.table(spark, folder, "events")
    return events.groupBy((F.col("user_id") + 1).alias("content_id")).agg(F.max_by("event_type", "event_id").alias("last_kind"))


def _index_lines(spark, folder):
    """Curated lines, and lines of entries with the last change of their documents."""
    inputs = Inputs(spark, folder)
    curated = site_index.index_lines(site_index.curated_rows(inputs.editorial))
    entries = site_index.index_lines(inputs.entries).join(_latest_kinds(spark, folder), "content_id", "left")
    return inputs, curated, entries.withColumn("last_kind", F.coalesce("last_kind", F.lit("")))


_LINES_SQL = """
latest AS (SELECT user_id + 1 AS content_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1),
keyed AS (
 SELECT l.site_id, label, CAST(entry_kind AS INTEGER) AS entry_kind, CASE entry_kind WHEN 1 THEN CAST(group_pos AS BIGINT) ELSE 0 END AS group_pos,
  CASE entry_kind WHEN 1 THEN -epoch_us(published_at) ELSE entry_pos END AS spot, CASE entry_kind WHEN 1 THEN -l.content_id ELSE 0 END AS spot_id,
  CASE entry_kind WHEN 1 THEN CAST(l.content_id AS VARCHAR) ELSE entry_pos || ' ' || l.url END AS entry_key, line, coalesce(kind, '') AS kind
 FROM lined l LEFT JOIN content c ON c.site_id = l.site_id AND c.content_id = l.content_id LEFT JOIN latest ON latest.content_id = l.content_id),
"""


def _parts_sql(name: str, rows: str) -> str:
    return f"""
{name} AS (
 SELECT site_id, label, entry_kind, group_pos, coalesce(mark.a, CAST('-9223372036854775808' AS BIGINT)) AS start,
  coalesce(mark.b, CAST('-9223372036854775808' AS BIGINT)) AS start_id, count(*) AS lines, min(spot) AS first_at,
  string_agg(line, chr(10) ORDER BY spot, spot_id, entry_key) || chr(10) AS body
 FROM (SELECT *, last_value(CASE WHEN CAST('0x' || substr(md5(site_id || '/' || entry_kind || '/' || entry_key), 1, 8) AS BIGINT) % {AVERAGE} = 0
   THEN {{'a': CAST(spot AS BIGINT), 'b': CAST(spot_id AS BIGINT)}} END IGNORE NULLS) OVER (PARTITION BY site_id, label, entry_kind, group_pos ORDER BY spot, spot_id, entry_key) AS mark
  FROM ({rows})) GROUP BY ALL)"""


@query("index_chunks", st.statement("""
SELECT site_id, label, entry_kind, group_pos, start, start_id, lines, sha1(body) AS body_sha1 FROM whole""", "lined", "content").replace(
    "\nSELECT site_id, label, entry_kind, group_pos, start,", "," + _LINES_SQL + _parts_sql("whole", "SELECT * EXCLUDE (kind) FROM keyed")
    + "\nSELECT site_id, label, entry_kind, group_pos, start,", 1))
def index_chunks(spark, folder):
    _, curated, entries = _index_lines(spark, folder)
    parts = ic.parts_of(ic.with_parts(ic.entry_lines(curated, entries), AVERAGE))
    return parts.select(*ic.GROUP, *ic.START, "lines", F.sha1("body").alias("body_sha1"))


@query("index_chunk_bodies", st.statement("SELECT site_id, body, lines FROM site_bodies", "site_bodies"))
def index_chunk_bodies(spark, folder):
    """The same texts as index_body gives, from parts that survive edits."""
    inputs, curated, entries = _index_lines(spark, folder)
    parts = written(ic.parts_of(ic.with_parts(ic.entry_lines(curated, entries), AVERAGE)), "index-parts")
    ordered = F.array_sort(F.collect_list(F.struct("place", "body")))
    texts = ic.text_rows(parts, inputs.profile).groupBy("site_id").agg(F.array_join(F.transform(ordered, lambda p: p["body"]), "").alias("body"))
    counts = parts.groupBy("site_id").agg(F.sum("lines").alias("lines"))
    return texts.join(counts, "site_id", "left").select("site_id", "body", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("index_parts_delta", st.statement("""
SELECT site_id, label, entry_kind, group_pos, start, start_id, CASE WHEN n.body IS NULL THEN 'drop' ELSE 'put' END AS change, n.lines, sha1(n.body) AS body_sha1
FROM now_parts n FULL JOIN old_parts o USING (site_id, label, entry_kind, group_pos, start, start_id)
WHERE n.body IS DISTINCT FROM o.body""", "lined", "content").replace(
    "\nSELECT site_id, label, entry_kind, group_pos, start,", "," + _LINES_SQL
    + _parts_sql("old_parts", "SELECT * EXCLUDE (kind) FROM keyed WHERE kind <> 'signup'") + ","
    + _parts_sql("now_parts", "SELECT * EXCLUDE (kind) REPLACE (CASE kind WHEN 'click' THEN line || ' (edited)' ELSE line END AS line) FROM keyed WHERE kind <> 'error'")
    + "\nSELECT site_id, label, entry_kind, group_pos, start,", 1))
def index_parts_delta(spark, folder):
    """The index stood without the documents inserted last; then these came, some were edited and some went."""
    _, curated, entries = _index_lines(spark, folder)
    lines = written(entries, "index-entries")
    placed = written(ic.with_parts(ic.entry_lines(curated, lines.filter("last_kind <> 'signup'")), AVERAGE), "index-placed")
    parts = written(ic.parts_of(placed), "index-parts")
    edited = lines.filter("last_kind IN ('signup', 'click')").withColumn(
        "line", F.when(F.col("last_kind") == "click", F.concat("line", F.lit(" (edited)"))).otherwise(F.col("line")))
    puts = ic.entry_lines(curated.limit(0), edited)
    drops = ic.entry_lines(curated.limit(0), lines.filter("last_kind = 'error'"))
    change = ic.change_parts(placed, parts, puts, drops, AVERAGE)
    return change.parts.select(*ic.GROUP, *ic.START, "change", "lines", F.sha1("body").alias("body_sha1"))


# --- measures that follow the log ----------------------------------------------------

_CHANGED_SQL = """
kinds AS (
 SELECT user_id + 1 AS content_id, arg_max(event_type, event_id) FILTER (WHERE event_id < (SELECT max(event_id) // 2 FROM events)) AS k1,
  arg_max(event_type, event_id) FILTER (WHERE event_id >= (SELECT max(event_id) // 2 FROM events)) AS k2 FROM events GROUP BY 1),
changed AS (
 SELECT * REPLACE (CASE k WHEN 'click' THEN (coalesce(quality_score, 0) + 37) % 101 ELSE quality_score END AS quality_score) FROM (
  SELECT j.*, n_chars > 600 AS described, coalesce(CASE WHEN k2 IN ('error', 'click', 'signup') THEN k2 WHEN k1 IN ('error', 'click', 'signup') THEN k1 END, '') AS k
  FROM judged j JOIN documents d ON d.doc_id + 1 = j.content_id LEFT JOIN kinds ON kinds.content_id = j.content_id) WHERE k <> 'error')
"""


def _with_changed(body: str) -> str:
    whole = st.statement("SELECT 0 AS placeholder", "judged")
    return whole.replace("\nSELECT 0 AS placeholder", "," + _CHANGED_SQL + body, 1)


def _followed(spark, folder):
    """All stored bodies, then two batches: documents that went, came again, or got another score."""
    docs = samples.table(spark, folder, "documents").select((F.col("doc_id") + 1).alias("content_id"), "n_chars")
    bodies = Inputs(spark, folder).bodies.join(docs, "content_id")
    listed = tx.present(F.col("markdown")).isNotNull()
    facts = written(measures.facts_of(bodies, listed, F.col("n_chars") > 600), "measure-facts")
    now, start = measures.measure(facts, reserve=8), facts
    now = measures.Measures(written(now.sites, "measure-sites"), written(now.worst, "measure-worst"))
    events = samples.table(spark, folder, "events")
    middle = events.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    halves = written(events.groupBy((F.col("user_id") + 1).alias("content_id"), (F.col("event_id") >= middle).alias("late"))
                     .agg(F.max_by("event_type", "event_id").alias("kind")), "measure-kinds")
    for late in (False, True):
        batch = start.join(halves.filter(F.col("late") == late), "content_id")
        again = F.when(F.col("kind") == "click", (F.coalesce("quality_score", F.lit(0)) + 37) % 101).otherwise(F.col("quality_score"))
        puts = batch.filter("kind IN ('click', 'signup')").withColumn("quality_score", again.cast("int")).select(*facts.columns)
        now, facts = measures.follow(now, facts, puts, batch.filter("kind = 'error'"), reserve=8)
        now = measures.Measures(written(now.sites, "measure-sites"), written(now.worst, "measure-worst"))
        facts = written(facts, "measure-facts")
    return now


@query("site_measures_delta", _with_changed("""
SELECT site_id, count(*) AS rows_total, count(quality_score) AS rows_with_score, round(coalesce(avg(quality_score), 0), 9) AS mean_quality,
 count(CASE WHEN quality_score >= 70 THEN 1 END) AS rows_above_threshold, round(avg(is_empty::INT), 9) AS empty_ratio, round(avg(is_noisy::INT), 9) AS noisy_ratio,
 count(CASE WHEN """ + st.trim("coalesce(markdown, '')") + """ <> '' THEN 1 END) AS total_entries,
 count(CASE WHEN """ + st.trim("coalesce(markdown, '')") + """ <> '' AND described THEN 1 END) AS entries_with_description
FROM changed GROUP BY site_id"""))
def site_measures_delta(spark, folder):
    told = _followed(spark, folder).report()
    return told.withColumns({c: F.round(c, 9) for c in ("mean_quality", "empty_ratio", "noisy_ratio")})


@query("worst_documents_delta", _with_changed("""
SELECT site_id, content_id, quality_score, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY quality_score, content_id) AS rank FROM changed WHERE quality_score IS NOT NULL) WHERE rank <= 5"""))
def worst_documents_delta(spark, folder):
    return _followed(spark, folder).shown(audit.WORST_LIMIT).select(*KEY, "quality_score", "rank")


# --- mirror by digests ---------------------------------------------------------------


@query("mirror_digest_delta", f"SELECT * FROM ({catalog_sites._mirror_sql('')}) WHERE action NOT IN ('keep', 'none')")
def mirror_digest_delta(spark, folder):
    wanted, present = catalog_sites.mirror_states(Inputs(spark, folder))
    paths = work_path(spark, "mirror-wanted"), work_path(spark, "mirror-present")
    publish.save_mirror_states(wanted, present, *paths, tops=8, lows=8)
    return publish.mirror_digest_delta(spark, *paths)


# --- published versions --------------------------------------------------------------


@query("index_snapshot", st.statement("""
SELECT version, version = 2 AS current, site_id, count(*) AS lines, sha1(string_agg(url, ',' ORDER BY url)) AS urls_sha1
FROM (SELECT unnest([1, 2]) AS version), keyed
WHERE version = 1 OR kind <> 'error' GROUP BY version, site_id""", "lined", "content").replace(
    "\nSELECT version, version = 2", "," + _LINES_SQL.rstrip().rstrip(",").replace("line, coalesce(kind, '') AS kind", "line, l.url, coalesce(kind, '') AS kind")
    + "\nSELECT version, version = 2", 1))
def index_snapshot(spark, folder):
    """A version of all documents, one without those that went last, and a run that fails: readers have the second."""
    inputs, root = Inputs(spark, folder), work_path(spark, "index-versions")
    # Each run reads its inputs many times: they are derived from the tables once.
    once = lambda rows, name: written(rows, f"snapshot-{name}")
    content = once(inputs.light.join(_latest_kinds(spark, folder), "content_id", "left"), "content")
    tables = (once(inputs.profile, "profile"), once(inputs.sample("content_meta"), "meta"), once(inputs.sample("robots"), "robots"),
              inputs.descriptions, once(inputs.editorial, "editorial"), once(inputs.store.select(*KEY, "markdown"), "store"))
    first = jobs.publish_snapshot(root, "first", content.drop("last_kind"), *tables)
    jobs.publish_snapshot(root, "second", content.filter("coalesce(last_kind, '') <> 'error'").drop("last_kind"), *tables, base=first.version)
    try:
        jobs.publish_snapshot(root, "third", content.drop("last_kind"), *tables, base=first.version)
    except snapshots.Conflict:  # it started from a version that isn't current any more
        pass
    now = snapshots.latest(spark, root)
    urls = F.array_join(F.array_sort(F.collect_list("url")), ",")
    shown = [s.table("lines").groupBy("site_id").agg(F.count(F.lit(1)).alias("lines"), F.sha1(urls).alias("urls_sha1"))
             .select(F.lit(s.version).alias("version"), F.lit(s == now).alias("current"), "site_id", "lines", "urls_sha1")
             for s in (snapshots.open_version(spark, root, v) for v in snapshots.versions(spark, root))]
    return shown[0].unionByName(shown[1])


# --- search by postings --------------------------------------------------------------

#: Terms of one to thirty characters, with and without hits.
TERMS = ("z", "<p", "The", "</title>", "no such words in any text here")

_HELD = " OR ".join(f"contains(lower({c}), lower(term))" for c in ("title", "excerpt", "body_html"))


@query("content_search_indexed", st.statement(f"""
SELECT term, site_id, content_id, title, CAST(position AS INTEGER) AS position, total FROM (
 SELECT *, row_number() OVER (PARTITION BY term, site_id ORDER BY published_at DESC, content_id DESC) AS position,
  count(*) OVER (PARTITION BY term, site_id) AS total
 FROM content, (SELECT unnest({list(TERMS)}) AS term) WHERE status = 'publish' AND ({_HELD})) WHERE position <= 50""", "content"))
def content_search_indexed(spark, folder):
    path = work_path(spark, "text-index")
    text_index.build(Inputs(spark, folder).content, path)
    found = None
    for term in TERMS:
        own = text_index.search(spark, path, term, page=1, size=0).select(F.lit(term).alias("term"), *KEY, "title", "position", "total")
        found = own if found is None else found.unionByName(own)
    return found


# --- deep pages ----------------------------------------------------------------------


@query("description_deep_page", st.statement(f"""
SELECT site_id, content_id, CAST(position AS INTEGER) AS position, total, CAST(ceil(total / 5) AS BIGINT) AS pages FROM (
 SELECT g.site_id, g.content_id, row_number() OVER (PARTITION BY site_id ORDER BY g.published_at DESC, content_id DESC) AS position,
  count(*) OVER (PARTITION BY site_id) AS total
 FROM {catalog_sites._CONSIDERED} g) WHERE position BETWEEN 31 AND 35""", "gate", "described"))
def description_deep_page(spark, folder):
    rows = Inputs(spark, folder).eligible.select(*KEY, "published_at")
    shown = paging.deep_page_of(rows, page=7, size=5, rank_rows=3)
    return shown.select(*KEY, "position", "total", "pages")


# --- capped queue --------------------------------------------------------------------

#: Jobs pending on a site at a time, and seconds until a job is done.
CAP, DELAY = 3, 90


@query("queue_admissions", st.statement(f"""
SELECT site_id, content_id, second, outcome, due AS due_second FROM decided""", "feed").replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT site_id, content_id, second, outcome", f""",
asked AS (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY second, content_id) AS i FROM (SELECT DISTINCT site_id, content_id, second FROM feed)),
decided AS (
 SELECT site_id, content_id, second, i, 'queued' AS outcome, second + {DELAY} AS due, [{{'doc': content_id, 'due': second + {DELAY}}}] AS waiting FROM asked WHERE i = 1
 UNION ALL
 SELECT site_id, content_id, second, i, CASE WHEN held IS NOT NULL THEN 'pending' WHEN len(alive) >= {CAP} THEN 'refused' ELSE 'queued' END,
  CASE WHEN held IS NOT NULL THEN held WHEN len(alive) < {CAP} THEN second + {DELAY} END,
  CASE WHEN held IS NOT NULL OR len(alive) >= {CAP} THEN alive ELSE list_append(alive, {{'doc': content_id, 'due': second + {DELAY}}}) END FROM (
   SELECT *, list_filter(alive, lambda p: p.doc = content_id)[1].due AS held FROM (
    SELECT a.site_id, a.content_id, a.second, a.i, list_filter(d.waiting, lambda p: p.due > a.second) AS alive
    FROM decided d JOIN asked a ON a.site_id = d.site_id AND a.i = d.i + 1)))
SELECT site_id, content_id, second, outcome""", 1))
def queue_admissions(spark, folder):
    feed = Inputs(spark, folder).sample("changes")
    return triggers.queue_admissions(feed, CAP, DELAY)


# --- audit from tables ---------------------------------------------------------------

_SITE = r"regexp_extract(site_id, '([^.]+[.][^.]+)$', 1)"

st._define("table_signals", ("profile", "lined", "entries", "stored", "conflicted", "plugins", "hosted"), rf"""
SELECT p.site_id, exposed_types, exposed_statuses, len(exposed_types)::INTEGER AS types, len(list_filter(exposed_statuses, lambda s: s <> 'publish'))::INTEGER AS risky,
 descriptions_enabled AS wanted, advertise_enabled AS advertised, structured_data_enabled AS native, p.ending = '.net' AS static_robots, client_configured AS client,
 home_url || 'llms.txt' AS index_url, coalesce(l.n, 0) > 0 AS populated, coalesce(l.n, 0) AS entry_count, coalesce(c.kinds, '') AS kinds, coalesce(c.n, 0)::BIGINT AS conflicts,
 coalesce(c.rewritten, false) AS rewritten, coalesce(s.n, 0) AS rows_total, coalesce(s.scored, 0) AS rows_with_score, coalesce(s.mean, 0.0) AS mean_quality,
 coalesce(s.above, 0) AS rows_above, coalesce(q.n, 0) AS n, coalesce(q.empties, 0.0) AS empty_ratio, coalesce(q.noises, 0.0) AS noisy_ratio,
 coalesce(w.titles, '') AS worst_titles, coalesce(w.refs, '') AS worst_refs,
 CASE g.o WHEN 0 THEN 'yoast' WHEN 1 THEN 'rank_math' WHEN 2 THEN 'aioseo' ELSE '' END AS plugin,
 coalesce(e.total, 0) AS total_entries, coalesce(e.described, 0) AS described,
 channels_enabled OR coalesce(f.a, false) AS ai_txt, channels_enabled OR coalesce(f.b, false) OR coalesce(g.provided, false) AS layer,
 channels_enabled OR coalesce(f.n, 0) > 3 AS policy, coalesce(f.n, 0) > 4 OR coalesce(f.n, 0) = 1 AS openapi, coalesce(g.provided, false) AS provided, true AS provider_url,
 (coalesce(l.n, 0) > 0)::INT + (channels_enabled OR coalesce(f.a, false))::INT + (channels_enabled OR coalesce(f.b, false) OR coalesce(g.provided, false))::INT
  + (channels_enabled OR coalesce(f.n, 0) > 3)::INT AS channels, home_url
FROM profile p
LEFT JOIN (SELECT site_id, count(*) AS n FROM lined GROUP BY 1) l USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS total, count(CASE WHEN description <> '' THEN 1 END) AS described FROM entries GROUP BY 1) e USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n, count(quality_score) AS scored, avg(quality_score) AS mean, count(CASE WHEN quality_score >= 70 THEN 1 END) AS above FROM stored GROUP BY 1) s USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n, avg(is_empty::INT) AS empties, avg(is_noisy::INT) AS noises FROM ({st.CTES['judged'][1].replace('FROM bodies', 'FROM stored')}) GROUP BY 1) q USING (site_id)
LEFT JOIN (SELECT site_id, string_agg(title, '|' ORDER BY quality_score, content_id) AS titles, string_agg(content_id || ' ' || permalink, '|' ORDER BY quality_score, content_id) AS refs FROM (
 SELECT * FROM stored JOIN content USING (site_id, content_id) WHERE quality_score IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY quality_score, content_id) <= 5) GROUP BY 1) w USING (site_id)
LEFT JOIN (SELECT {_SITE} AS site_id, count(*) AS n, bool_or(kind = 'rewrite') AS rewritten,
 concat_ws(',', CASE WHEN bool_or(kind = 'plugin') THEN 'plugin' END, CASE WHEN bool_or(kind = 'filesystem') THEN 'filesystem' END, CASE WHEN bool_or(kind = 'rewrite') THEN 'rewrite' END) AS kinds
 FROM conflicted GROUP BY 1) c USING (site_id)
LEFT JOIN (SELECT {_SITE} AS site_id, bool_or(page_id % 6 = 0) AS a, bool_or(page_id % 6 = 1) AS b, count(*) AS n FROM hosted GROUP BY 1) f USING (site_id)
LEFT JOIN (SELECT {_SITE} AS site_id, bool_or(split_part(slug, '/', 1) = 'ai-layer') AS provided,
 min(CASE split_part(slug, '/', 1) WHEN 'wordpress-seo' THEN 0 WHEN 'seo-by-rank-math' THEN 1 WHEN 'all-in-one-seo-pack' THEN 2 END) AS o FROM plugins GROUP BY 1) g USING (site_id)""")


def table_signals(spark, folder):
    """The audit input of every site, from its tables."""
    inputs = Inputs(spark, folder)
    by_site = lambda rows: rows.withColumn("site_id", F.regexp_extract("site_id", r"([^.]+\.[^.]+)$", 1))
    plugins = by_site(inputs.sample("active_plugins")).distinct()
    return audit.signals_from_tables(
        inputs.profile, cf.seo_posture(plugins), cf.active_provider(plugins, inputs.profile), audit.probed_files(by_site(inputs.sample("root_files"))),
        by_site(inputs.conflicts), site_index.index_measures(inputs.rows), inputs.store, inputs.content)


@query("site_signals_all", st.statement("""
SELECT site_id, array_to_string(exposed_types, ',') AS exposed_types, array_to_string(exposed_statuses, ',') AS exposed_statuses, wanted AS descriptions_enabled,
 advertised AS advertise_enabled, native AS structured_data_enabled, populated AS index_populated, entry_count, kinds AS conflict_kinds, conflicts AS conflict_count,
 static_robots, index_url, rows_total, rows_with_score, round(mean_quality, 9) AS mean_quality, rows_above AS rows_above_threshold, n AS sampled,
 round(empty_ratio, 9) AS empty_ratio, round(noisy_ratio, 9) AS noisy_ratio, worst_titles, worst_refs, plugin AS seo_plugin, client AS client_configured,
 total_entries, described AS entries_with_description, ai_txt AS ai_txt_present, layer AS ai_layer_present, policy AS policy_present, openapi AS openapi_present,
 CASE WHEN provided THEN 'ai_layer' END AS provider_slug, CASE WHEN provided THEN 'AI Layer' END AS provider_name,
 CASE WHEN provided THEN home_url || 'wp-admin/admin.php?page=ai-layer' END AS provider_config_url
FROM table_signals""", "table_signals"))
def site_signals_all(spark, folder):
    signals = table_signals(spark, folder)
    lists = {c: "|" if c.startswith("worst") else "," for c in ("exposed_types", "exposed_statuses", "conflict_kinds", "worst_titles", "worst_refs")}
    return signals.withColumns({
        **{c: F.array_join(c, mark) for c, mark in lists.items()},
        **{c: F.round(c, 9) for c in ("mean_quality", "empty_ratio", "noisy_ratio")}})


st._define("table_scored", ("table_signals",), st.CTES["scored_sites"][1].replace("FROM signals", "FROM table_signals").replace(
    "CAST(floor(rows_above * 100 / rows_with_score) AS INTEGER)", "CASE WHEN rows_with_score > 0 THEN CAST(floor(rows_above * 100 / rows_with_score) AS INTEGER) END"))
st._define("table_sub", ("table_scored",), st.CTES["sub"][1].replace("FROM scored_sites", "FROM table_scored"))


@query("site_audit", st.statement("""
SELECT site_id, name, CAST(value AS INTEGER) AS value, CAST(weight AS INTEGER) AS weight, codes,
 CAST(floor(sum(value * weight) OVER (PARTITION BY site_id) / 100) AS INTEGER) AS overall FROM table_sub""", "table_sub"))
def site_audit(spark, folder):
    """All sub-scores of every site with their reasons and the overall score, from the tables."""
    scores = audit.sub_scores(written(table_signals(spark, folder), "audit-signals"))
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    overall = audit.overall(scores).select("site_id", "overall")
    return scores.select("site_id", "name", "value", "weight", codes.alias("codes")).join(overall, "site_id")


@query("structured_gap", st.statement(r"""
SELECT site_id, content_id, gap FROM (
 SELECT f.site_id, f.content_id, array_to_string(list_filter(CASE WHEN o = 0 THEN [] WHEN o = 1 THEN ['WebPage', 'Article'] ELSE ['WebSite', 'Organization', 'WebPage', 'Article'] END,
  lambda t: t IN ('WebSite', 'Organization') OR (weak AND t = CASE post_type WHEN 'post' THEN 'Article' ELSE 'WebPage' END)), '|') AS gap
 FROM (SELECT *, list_contains(exposed_types, post_type) AND list_contains(exposed_statuses, status) AS weak FROM flags WHERE structured_data_enabled) f
 LEFT JOIN (SELECT regexp_extract(site_id, '([^.]+[.][^.]+)$', 1) AS site_id,
  min(CASE split_part(slug, '/', 1) WHEN 'wordpress-seo' THEN 0 WHEN 'seo-by-rank-math' THEN 1 WHEN 'all-in-one-seo-pack' THEN 2 END) AS o FROM plugins GROUP BY 1) g USING (site_id))
WHERE gap <> ''""", "flags", "plugins"))
def structured_gap(spark, folder):
    """Node types of each document that its site's active SEO plug-in leaves open."""
    inputs = Inputs(spark, folder)
    plugins = inputs.sample("active_plugins").withColumn("site_id", F.regexp_extract("site_id", r"([^.]+\.[^.]+)$", 1))
    gaps = cf.seo_posture(plugins.distinct()).select("site_id", "posture")
    rows = inputs.sited().join(gaps, "site_id", "left").withColumn("gap", cf.coverage_gap(F.coalesce("posture", F.lit("none")), matrix=catalog_sites._PARTIAL))
    nodes = publish.structured_data(rows.withColumn("weakly_exposed", exposure.weakly_exposed()))
    types = F.regexp_extract_all("json_ld", F.lit('"@context":"https://schema.org","@type":"([A-Za-z]+)"'), F.lit(1))
    return nodes.select(*KEY, F.array_join(types, "|").alias("gap"))


# --- retries -------------------------------------------------------------------------


@query("retry_schedule", """
WITH RECURSIVE log AS (
 SELECT sha1('Describe page ' || (user_id % 97) || chr(31) || '{}') AS job, CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS second,
  CASE event_type WHEN 'error' THEN 'network' WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'unknown' END AS failure FROM events
 WHERE event_type IN ('error', 'view', 'click')),
marks AS (SELECT job, second, min(failure) AS failure FROM log GROUP BY job, second),
fires AS (SELECT job, min(second) AS second FROM marks GROUP BY job
 UNION ALL SELECT f.job, (SELECT min(m.second) FROM marks m WHERE m.job = f.job AND m.second >= f.second + 300) AS second
 FROM fires f WHERE EXISTS (SELECT 1 FROM marks m WHERE m.job = f.job AND m.second >= f.second + 300))
SELECT job, second + 300 AS due_second, failure AS first_failure FROM fires JOIN marks USING (job, second)""")
def retry_schedule(spark, folder):
    """All retries of the feed: a failure after one opens a new wait."""
    failure = samples.case_of(F.col("event_type"), {"error": "network", "view": "rate_limit", "click": "unknown"}, "permanent")
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    log = samples.table(spark, folder, "events").select(
        F.concat(F.lit("Describe page "), (F.col("user_id") % 97).cast("string")).alias("prompt"), F.lit("{}").alias("options"), failure.alias("failure"),
        F.floor(F.timestamp_diff("SECOND", epoch, F.col("ts").cast("timestamp_ntz")) / 60).cast("bigint").alias("second"))
    return retries.retry_schedule(log)
