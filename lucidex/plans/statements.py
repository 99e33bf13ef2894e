"""Building blocks of the checking SQL (DuckDB dialect).

They restate the sample adapters and text rules in plain SQL, on their own.
"""

from __future__ import annotations

BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(13))"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def rtrim(x: str) -> str:
    return f"rtrim({x}, {BLANKS})"


def collapse(x: str) -> str:
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def strip(x: str) -> str:
    blocks = rf"regexp_replace({x}, '(?is)<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>', '', 'g')"
    notes = rf"regexp_replace({blocks}, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    return trim(rf"regexp_replace({notes}, '<(?:[^\s>][^>]*)?(?:>|\z)', '', 'g')")


def cut(x: str, size: int) -> str:
    """Longest prefix of at most *size* bytes."""
    return (f"left({x}, list_max(list_filter(range(0, {size + 1}), "
            f"lambda i: strlen(left({x}, i)) <= {size}))::BIGINT)")


def cap(x: str, limit: int, tail: str, keep: int) -> str:
    return f"CASE WHEN strlen({x}) > {limit} THEN {rtrim(cut(x, keep))} || '{tail}' ELSE {x} END"


def decode(x: str) -> str:
    return f"replace(replace({x}, '&mdash;', '—'), '&amp;', '&')"


def escape_inline(x: str) -> str:
    line = trim(rf"regexp_replace({decode(x)}, '\r\n|\r|\n', ' ', 'g')")
    return rf"regexp_replace({line}, '([\\*_])', '\\\1', 'g')"


def escape_text(x: str) -> str:
    return rf"regexp_replace({escape_inline(x)}, '([\[\]])', '\\\1', 'g')"


def escape_url(x: str) -> str:
    return rf"replace(replace(regexp_replace({x}, '\s+', '', 'g'), '(', '%28'), ')', '%29')"


def markdown_url(x: str) -> str:
    query = rf"regexp_extract({x}, '^[^?#]*\?([^#]*)', 1)"
    path = rf"regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return (f"CASE WHEN {query} <> '' AND contains(lower({query}), 'format=md') THEN {x} "
            f"WHEN {query} <> '' THEN {x} || '&format=md' "
            f"WHEN ends_with({path}, '.md') THEN {x} "
            f"WHEN rtrim({path}, '/') = '' THEN rtrim({x}, '/') || '/?format=md' "
            f"ELSE rtrim({x}, '/') || '.md' END")


def mirror_path(x: str, cid: str) -> str:
    query = rf"regexp_extract({x}, '^[^?#]*\?([^#]*)', 1)"
    path = rf"trim(regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')"
    return (f"CASE WHEN {query} <> '' THEN 'post-' || {cid} || '.md' WHEN {path} = '' THEN 'index.md' "
            f"ELSE {path} || '.md' END")


def text_format(template: str, *args: str) -> str:
    """SQL concatenation of a %d/%s template."""
    parts, rest, left = [], template.replace("%%", "\x02"), list(args)
    import re

    for piece in re.split("(%[ds])", rest):
        if piece in ("%d", "%s"):
            parts.append(f"CAST({left.pop(0)} AS VARCHAR)")
        elif piece:
            parts.append("'" + piece.replace("\x02", "%").replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _define(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def statement(body: str, *needs: str) -> str:
    """The body with the named building blocks and what they need in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in CTES[name][0]:
            add(inner)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order) + "\n" + body


_define("sited", (), """
SELECT *, doc_id + 1 AS content_id, coalesce(source, 'none') || CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 3
 WHEN 0 THEN '.com' WHEN 1 THEN '.net' ELSE '.org' END AS site_id FROM documents""")

_define("content", ("sited",), r"""
SELECT *, modified_base + to_days(CAST(content_id % 7 AS INTEGER)) AS modified_at FROM (
 SELECT regexp_extract(url, '^[a-z]+://[^/?#:]*?([^./?#:]+\.[^./?#:]+)(?:[:/?#]|$)', 1) AS site_id,
  page_id + 1 AS content_id,
  CASE (page_id + 1) % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'page' ELSE 'product' END AS post_type,
  CASE (page_id + 1) % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' ELSE 'publish' END AS status,
  CASE WHEN (page_id + 1) % 17 = 0 THEN 'x' ELSE '' END AS password,
  CASE WHEN (page_id + 1) % 41 = 0 THEN 'hello-world' WHEN (page_id + 1) % 43 = 0 THEN 'sample-page'
       ELSE regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*?([^/?#]+)/?(?:[?#]|$)', 1) END AS slug,
  CASE WHEN (page_id + 1) % 23 = 0 THEN '  ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE WHEN (page_id + 1) % 4 = 0 THEN '' ELSE regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) END AS excerpt,
  html AS body_html, url AS permalink,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id + 1) AS published_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id + 1) AS modified_base,
  regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]{2})/', 1) AS lang
 FROM (SELECT page_id, url, html FROM pages UNION ALL SELECT doc_id,
  'https://' || site_id || '/' || coalesce(lang, 'en') || '/d' || doc_id,
  '<title>Doc ' || doc_id || ' ' || regexp_extract(coalesce(text, ''), '^[A-Za-z ]{0,40}') || '</title><div class="ad">'
   || regexp_extract(coalesce(text, ''), '^[A-Za-z ,.\n]{0,80}') || '</div><p>' || coalesce(text, '') || '</p>' FROM sited))""")

_define("profile", ("content",), """
SELECT site_id, right(site_id, 4) AS ending,
 CASE right(site_id, 4) WHEN '.com' THEN ['post', 'page'] WHEN '.net' THEN ['post', 'page', 'product']
   ELSE ['page', 'product'] END AS exposed_types,
 CASE right(site_id, 4) WHEN '.net' THEN ['publish', 'private'] ELSE ['publish'] END AS exposed_statuses,
 CASE right(site_id, 4) WHEN '.com' THEN [7, 12] WHEN '.net' THEN [-1] ELSE [33] END AS excluded_ids,
 CASE right(site_id, 4) WHEN '.com' THEN ['foo-bar', '825'] ELSE ['!'] END AS excluded_slugs,
 CASE right(site_id, 4) WHEN '.com' THEN ['fr'] WHEN '.net' THEN ['de'] ELSE ['!'] END AS excluded_langs,
 CASE right(site_id, 4) WHEN '.com' THEN [21, 23] ELSE [-1] END AS utility_ids,
 right(site_id, 4) <> '.org' AS exclude_samples,
 right(site_id, 4) <> '.net' AS descriptions_enabled,
 right(site_id, 4) <> '.org' AS markdown_enabled,
 right(site_id, 4) <> '.org' AS advertise_enabled,
 right(site_id, 4) <> '.net' AS channels_enabled,
 right(site_id, 4) <> '.net' AS structured_data_enabled,
 right(site_id, 4) <> '.org' AS client_configured,
 right(site_id, 4) <> '.org' AS allow_inference,
 right(site_id, 4) = '.net' AS allow_training,
 CASE right(site_id, 4) WHEN '.com' THEN 'yoast' WHEN '.net' THEN 'rank_math' ELSE 'aioseo' END AS seo_posture,
 CASE right(site_id, 4) WHEN '.com' THEN 'Alpha &amp; Co' WHEN '.net' THEN 'Beta_' || chr(10) || 'Site' ELSE '' END AS site_name,
 CASE right(site_id, 4) WHEN '.com' THEN 'Tools &mdash; tactics' ELSE '' END AS tagline,
 'https://' || site_id || '/' AS home_url,
 CASE right(site_id, 4) WHEN '.com' THEN 'https://' || site_id || '/sitemap.xml' ELSE '' END AS sitemap_url
FROM (SELECT DISTINCT site_id FROM content)""")

_define("flags", ("content", "profile"), """
SELECT c.*, p.* EXCLUDE (site_id),
 CASE seo_posture WHEN 'yoast' THEN content_id % 19 = 0 WHEN 'rank_math' THEN content_id % 11 = 0
   ELSE content_id % 5 = 0 AND content_id % 2 = 1 AND content_id % 3 = 0 END AS noindex,
 list_contains(excluded_langs, lang) AS term_denied,
 content_id % 13 = 0 OR list_contains(excluded_ids, content_id) OR (slug <> '' AND list_contains(excluded_slugs, slug))
   OR list_contains(utility_ids, content_id) OR list_contains(excluded_langs, lang) AS denied,
 exclude_samples AND slug IN ('hello-world', 'sample-page') AS sample
FROM content c JOIN profile p USING (site_id)""")

_define("gate", ("flags",), """
SELECT *, CASE
  WHEN NOT list_contains(exposed_types, post_type) THEN 'cpt'
  WHEN NOT list_contains(exposed_statuses, status) THEN 'status'
  WHEN password <> '' THEN 'password' WHEN noindex THEN 'noindex'
  WHEN denied THEN 'excluded' WHEN sample THEN 'sample' END AS reason
FROM flags""")

_define("described", ("content", "sited"), """
SELECT c.site_id, c.content_id, c.modified_at, c.published_at,
 CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 29 = 1 THEN '  ' ELSE text END AS auto,
 CASE WHEN doc_id % 7 = 0 THEN ' ' || text WHEN doc_id % 7 = 1 THEN '   ' END AS manual,
 CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN c.modified_at - INTERVAL 1 DAY ELSE c.modified_at END AS generated_for,
 CASE WHEN doc_id % 11 = 0 THEN '0' ELSE '1' END AS generator_version,
 CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs-retry' WHEN 2 THEN 'failed' WHEN 3 THEN 'done'
   WHEN 4 THEN '' ELSE 'skipped' END AS job_status
FROM sited d JOIN content c USING (site_id, content_id)""")

_define("hashed", ("content",), """
SELECT *, sha1(body_html || excerpt || strftime(modified_at, '%Y-%m-%d %H:%M:%S') || title) AS hash FROM content""")

_define("stored", ("hashed", "sited"), """
SELECT c.site_id, c.content_id,
 CASE WHEN doc_id % 4 = 0 THEN 'outdated' ELSE c.hash END AS content_hash,
 CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) ELSE text END AS markdown,
 CASE WHEN doc_id % 6 = 0 THEN '4' ELSE '5' END AS converter_version,
 c.published_at AS generated_at,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 101 AS INTEGER) END AS quality_score
FROM sited d JOIN hashed c USING (site_id, content_id)""")

_define("bodies", (), """
SELECT source AS site_id, doc_id + 1 AS content_id,
 CASE WHEN doc_id % 8 = 0 THEN text || ' ' || repeat('QWxhZGRpbg', length(text) % 40)
  WHEN doc_id % 10 = 1 THEN '[vc_row full="1"]<script src="a.js"></script>' || text || '[/vc_row]'
  ELSE text END AS markdown,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 101 AS INTEGER) END AS quality_score
FROM documents""")


def _chars(pattern: str) -> str:
    return (f"coalesce(list_sum(list_transform(regexp_extract_all(markdown, '{pattern}'), "
            f"lambda h: length(h))), 0)")


_define("judged", ("bodies",), f"""
SELECT *, length({trim('markdown')}) < 48 AS is_empty,
 length({trim('markdown')}) >= 48 AND (({_chars('[A-Za-z0-9+/]{60,}={0,2}')}
  + {_chars('(?i)</?(?:script|style)' + chr(92) + 'b[^>]*>|setREVStartSize' + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')')}
  + {_chars('(?i)' + chr(92) + '[[a-z][a-z0-9_-]*(?:' + chr(92) + 's[^' + chr(92) + ']]*)?' + chr(92) + ']')})
  / length(markdown)) > 0.30 AS is_noisy
FROM bodies""")

_NORM = cap("line", 160, "...", 157)

_define("words", ("gate", "described"), f"""
SELECT site_id, content_id, CASE WHEN line IS NULL THEN '' ELSE {_NORM} END AS description,
 CASE WHEN {trim("coalesce(manual, '')")} <> '' THEN 'manual' WHEN {trim("coalesce(auto, '')")} <> '' THEN 'auto'
  WHEN {trim('excerpt')} <> '' THEN 'excerpt' ELSE 'none' END AS source
FROM (SELECT *, {collapse(strip('first'))} AS line FROM (
 SELECT g.site_id, g.content_id, g.excerpt, d.manual, d.auto,
  CASE WHEN {trim("coalesce(manual, '')")} <> '' THEN manual WHEN {trim("coalesce(auto, '')")} <> '' THEN auto
   WHEN {trim('excerpt')} <> '' THEN excerpt END AS first
 FROM gate g LEFT JOIN described d USING (site_id, content_id)))""")

_define("entries", ("gate", "words", "stored"), f"""
SELECT g.site_id, g.content_id, g.post_type, g.type_rank, g.type_order, g.post_type AS label,
 CASE WHEN {trim('g.title')} = '' THEN '(no title)' ELSE g.title END AS title,
 CASE WHEN markdown_enabled THEN {markdown_url('g.permalink')} ELSE g.permalink END AS url,
 w.description
FROM (SELECT *, row_number() OVER (PARTITION BY site_id, post_type ORDER BY published_at DESC, content_id DESC) AS type_rank,
  list_position(exposed_types, post_type) AS type_order
 FROM gate WHERE list_contains(exposed_types, post_type) AND list_contains(exposed_statuses, status)) g
JOIN words w USING (site_id, content_id) LEFT JOIN stored s USING (site_id, content_id)
WHERE g.reason IS NULL
 AND NOT (markdown_enabled AND s.content_id IS NOT NULL AND {trim('s.markdown')} = '')""")

_define("curated", ("content",), f"""
SELECT site_id, content_id AS position, 'Pick ' || content_id AS title,
 CASE WHEN content_id % 6 = 1 THEN 'mailto:' ELSE 'https://' END || 'x.example/' || content_id AS url,
 CASE WHEN content_id % 3 = 0 THEN '' ELSE {collapse("('Note ' || slug)")} END AS description,
 CASE WHEN content_id % 8 = 1 THEN 'Resources' WHEN content_id % 8 = 2 THEN 'Custom' ELSE 'Featured' END AS section,
 CASE WHEN content_id % 8 = 2 THEN 'page' ELSE '' END AS section_label,
 CASE WHEN content_id % 8 = 1 THEN 'Resources' WHEN content_id % 8 = 2 THEN 'page' ELSE 'Featured' END AS rendered_label
FROM content WHERE content_id % 7 <> 0 AND content_id % 6 NOT IN (0, 2)""")

_define("placed", ("curated", "entries"), """
SELECT *, first_value(entry_kind) OVER w AS section_kind, first_value(group_pos) OVER w AS section_pos FROM (
 SELECT site_id, rendered_label AS label, 0 AS entry_kind, position AS group_pos, position AS entry_pos,
  NULL::BIGINT AS content_id, title, url, description FROM curated
 UNION ALL
 SELECT site_id, label, 1, type_order, type_rank, content_id, title, url, description FROM entries)
WINDOW w AS (PARTITION BY site_id, label ORDER BY entry_kind, group_pos)""")

_define("lined", ("placed",), f"""
SELECT *, '- [' || {escape_text('title')} || '](' || {escape_url('url')} || ')'
 || CASE WHEN description <> '' THEN ': ' || {escape_inline('description')} ELSE '' END AS line FROM placed""")

_define("heads", ("profile",), f"""
SELECT site_id, site_name, '# ' || {escape_inline('site_name')} || chr(10)
 || CASE WHEN tagline <> '' THEN '> ' || {escape_inline('tagline')} || chr(10) ELSE '' END AS header FROM profile""")

_define("site_bodies", ("lined", "heads"), f"""
SELECT h.site_id, CASE WHEN b.text IS NULL AND site_name = '' THEN '' ELSE header || coalesce(b.text, '') END AS body,
 coalesce(b.lines, 0) AS lines
FROM heads h LEFT JOIN (
 SELECT site_id, string_agg(text, '' ORDER BY section_kind, section_pos, label) AS text, sum(lines)::BIGINT AS lines FROM (
  SELECT site_id, section_kind, section_pos, label, count(*) AS lines,
   chr(10) || '## ' || {escape_inline('label')} || chr(10) || chr(10)
    || string_agg(line || chr(10), '' ORDER BY entry_kind, group_pos, entry_pos) AS text
  FROM lined GROUP BY site_id, section_kind, section_pos, label) GROUP BY site_id) b USING (site_id)""")

_define("docs_full", ("entries", "stored"), f"""
SELECT e.site_id, 1 AS section_kind, CAST(type_order AS BIGINT) AS section_pos, label, CAST(type_rank AS BIGINT) AS entry_pos,
 e.content_id,
 CASE WHEN type_rank = min(type_rank) OVER (PARTITION BY e.site_id, label, type_order)
  THEN chr(10) || '## ' || {escape_inline('label')} || chr(10) ELSE chr(10) || '---' || chr(10) END
 || chr(10) || '### ' || {escape_inline('title')} || chr(10) || chr(10) || 'URL: ' || {escape_url('url')} || chr(10)
 || CASE WHEN {trim("coalesce(markdown, '')")} <> '' THEN chr(10) || {trim('markdown')} || chr(10) ELSE '' END AS text
FROM entries e LEFT JOIN stored s USING (site_id, content_id)""")

_define("full_rows", ("docs_full", "lined"), f"""
SELECT site_id, 0 AS section_kind, first_value(entry_pos) OVER w AS section_pos, label, entry_pos, NULL::BIGINT AS content_id,
 CASE WHEN row_number() OVER w = 1 THEN chr(10) || '## ' || {escape_inline('label')} || chr(10) || chr(10) ELSE '' END
  || line || chr(10) AS text
FROM lined WHERE entry_kind = 0 WINDOW w AS (PARTITION BY site_id, label ORDER BY entry_pos)
UNION ALL SELECT * FROM docs_full""")

_define("hosted", (), r"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS site_id, page_id FROM pages""")

_define("plugins", ("hosted",), """
SELECT DISTINCT site_id, CASE page_id % 11 WHEN 0 THEN 'website-llms-txt/website-llms-txt.php'
 WHEN 1 THEN 'markdown-mirror/markdown-mirror.php' WHEN 2 THEN 'seo-by-rank-math/rank-math.php'
 WHEN 3 THEN 'wordpress-seo/wp-seo.php' WHEN 4 THEN 'akismet/akismet.php'
 WHEN 5 THEN 'llms-txt-generator/llms-txt-generator.php' WHEN 6 THEN 'ai-layer/ai-layer.php'
 WHEN 7 THEN 'all-in-one-seo-pack/all_in_one_seo_pack.php' ELSE 'hello.php' END AS slug FROM hosted""")

_define("conflicted", ("plugins", "hosted"), """
SELECT site_id, 'plugin' AS kind, slug,
 CASE split_part(slug, '/', 1) WHEN 'website-llms-txt' THEN 'Website LLMs.txt' WHEN 'markdown-mirror' THEN 'Markdown Mirror'
  ELSE 'LLMs.txt Generator' END AS name,
 'https://wordpress.org/plugins/' || split_part(slug, '/', 1) || '/' AS url,
 CASE split_part(slug, '/', 1) WHEN 'website-llms-txt' THEN 'hybrid' ELSE 'rewrite' END AS shape,
 NULL AS path, NULL AS rule
FROM plugins WHERE split_part(slug, '/', 1) IN ('website-llms-txt', 'markdown-mirror', 'llms-txt-generator')
UNION ALL SELECT DISTINCT site_id, 'filesystem', NULL, NULL, NULL, NULL, '/llms.txt', NULL FROM hosted WHERE page_id % 6 = 0
UNION ALL SELECT site_id, 'rewrite', NULL, NULL, NULL, NULL, NULL, min('index.php?other=' || (page_id % 4))
 FROM hosted WHERE page_id % 3 = 0 GROUP BY site_id""")

_define("printed", ("conflicted",), """
SELECT site_id, sha1('[' || string_agg(record, ',' ORDER BY record) || ']') AS fingerprint, count(*) AS conflicts FROM (
 SELECT site_id, CASE kind
  WHEN 'plugin' THEN '{"kind":"plugin","name":"' || name || '","shape":"' || shape || '","slug":"' || slug || '","url":"' || url || '"}'
  WHEN 'filesystem' THEN '{"kind":"filesystem","path":"' || path || '"}'
  ELSE '{"kind":"rewrite","rule":"' || rule || '"}' END AS record FROM conflicted) GROUP BY site_id""")

_define("feed", ("content",), """
SELECT c.site_id, c.post_type, user_id + 1 AS content_id, event_id,
 CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'save' WHEN 'view' THEN 'meta' WHEN 'purchase' THEN 'term'
  ELSE 'trash' END AS kind, event_type,
 CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS second
FROM events e JOIN content c ON c.content_id = e.user_id + 1""")

_define("signals", (), """
SELECT source AS site_id, k, n, scored AS rows_with_score, mean AS mean_quality, above AS rows_above, longs,
 CASE WHEN k % 10 = 9 THEN 0 ELSE n END AS rows_total,
 CASE WHEN k % 3 = 0 THEN 0.0 ELSE shorts / n END AS empty_ratio,
 CASE WHEN k % 4 = 0 THEN 0.0 ELSE ninths / n END AS noisy_ratio,
 (k % 5 <> 0)::INT + (k % 2 = 0)::INT AS types,
 (k % 3 = 1)::INT + (k % 6 = 4)::INT AS risky,
 CASE WHEN k % 3 = 1 THEN CASE WHEN k % 6 = 4 THEN 'draft, private' ELSE 'draft' END ELSE '' END AS risky_csv,
 (k % 4 = 1)::INT + (k % 8 = 5)::INT AS conflicts, k % 8 = 5 AS rewritten,
 k % 7 <> 3 AND longs > 0 AS populated, CASE WHEN k % 7 = 3 THEN 0 ELSE longs END AS entry_count,
 k % 2 = 0 AS wanted, k % 3 <> 1 AS client, k % 4 = 2 AS native,
 CASE k % 4 WHEN 0 THEN 'yoast' WHEN 1 THEN 'aioseo' ELSE '' END AS plugin,
 CASE WHEN k % 11 = 10 THEN 0 ELSE n END AS total_entries,
 CASE WHEN k % 6 = 0 THEN n ELSE longs END AS described,
 k % 3 = 0 AS advertised, k % 9 = 0 AS static_robots,
 (k % 7 <> 3 AND longs > 0)::INT + (k % 2 = 0)::INT + (k % 3 <> 2)::INT + (k % 5 < 3)::INT AS channels,
 k % 3 <> 2 AS layer, k % 4 = 3 AS openapi, k % 5 = 0 AS provided, k % 10 = 0 AS provider_url
FROM (SELECT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS k, count(*) AS n,
  count(CASE WHEN doc_id % 13 <> 0 THEN 1 END) AS scored, avg(CASE WHEN doc_id % 13 <> 0 THEN doc_id % 101 END) AS mean,
  count(CASE WHEN doc_id % 13 <> 0 AND doc_id % 101 >= 70 THEN 1 END) AS above,
  count(CASE WHEN n_chars > 600 THEN 1 END) AS longs, count(CASE WHEN n_chars < 200 THEN 1 END) AS shorts,
  count(CASE WHEN doc_id % 9 = 0 THEN 1 END) AS ninths
 FROM documents GROUP BY source)""")

_define("scored_sites", ("signals",), """
SELECT *, CASE WHEN total_entries > 0 THEN CAST(floor(least(described, total_entries) * 100 / total_entries) AS INTEGER) ELSE 0 END AS pct,
 rows_total > 0 AND rows_with_score > 0 AS has_scores, CAST(floor(mean_quality) AS INTEGER) AS mean_int,
 CAST(floor(rows_above * 100 / rows_with_score) AS INTEGER) AS above_pct,
 CAST(round(empty_ratio * 100) AS INTEGER) AS empty_pct, CAST(round(noisy_ratio * 100) AS INTEGER) AS noisy_pct
FROM signals""")

_define("sub", ("scored_sites",), """
SELECT site_id, 'discoverability' AS name, 10 AS weight,
 (CASE WHEN populated THEN 50 ELSE 0 END + CASE WHEN types > 0 THEN 25 ELSE 0 END + CASE WHEN entry_count > 0 THEN 15 ELSE 0 END
  + CASE WHEN rewritten THEN 0 ELSE 10 END) AS value,
 concat_ws(',', CASE WHEN populated THEN 'disc_llms_txt_populated' ELSE 'disc_llms_txt_empty' END,
  CASE WHEN types > 0 THEN 'disc_cpt_exposed' ELSE 'disc_no_cpt_exposed' END,
  CASE WHEN entry_count > 0 THEN 'disc_entries_listed' ELSE 'disc_zero_entries' END,
  CASE WHEN rewritten THEN 'disc_rewrite_conflict' END) AS codes FROM scored_sites
UNION ALL SELECT site_id, 'content_readability', 15, pct,
 CASE WHEN total_entries <= 0 THEN 'cr_no_exposed_entries' WHEN pct >= 90 THEN 'cr_coverage_good'
  WHEN pct >= 50 THEN 'cr_coverage_medium' ELSE 'cr_coverage_low' END FROM scored_sites
UNION ALL SELECT site_id, 'schema_coverage', 10, CASE WHEN plugin <> '' OR native THEN 100 ELSE 60 END,
 CASE WHEN plugin <> '' THEN 'sc_seo_plugin_detected' WHEN native THEN 'sc_native_jsonld' ELSE 'sc_no_structured_data' END
 FROM scored_sites
UNION ALL SELECT site_id, 'exposure_safety', 15, greatest(0, 60 - 15 * risky) + CASE WHEN types > 0 THEN 40 ELSE 0 END,
 CASE WHEN risky = 0 THEN 'es_only_published' ELSE 'es_risky_statuses' END || ',' ||
 CASE WHEN types > 0 THEN 'es_cpt_explicit' ELSE 'es_no_cpt' END FROM scored_sites
UNION ALL SELECT site_id, 'integration_health', 15,
 CASE WHEN wanted AND NOT client THEN 0 ELSE 60 END + CASE WHEN conflicts = 0 THEN 40 ELSE 0 END,
 concat_ws(',', CASE WHEN wanted AND NOT client THEN 'ih_llm_unconfigured' WHEN wanted THEN 'ih_llm_configured' ELSE 'ih_llm_disabled' END,
  CASE WHEN conflicts > 0 THEN 'ih_llms_txt_conflict' END) FROM scored_sites
UNION ALL SELECT site_id, 'md_conversion_quality', 25, CASE WHEN NOT has_scores THEN 0 ELSE
  greatest(0, least(100, CAST(floor(mean_int * 60 / 100) + floor(above_pct * 40 / 100) - round(40 * empty_ratio) - round(30 * noisy_ratio) AS INTEGER))) END,
 CASE WHEN NOT has_scores THEN 'mcq_no_cache' ELSE concat_ws(',', 'mcq_mean_quality', 'mcq_above_threshold',
  CASE WHEN empty_pct > 0 THEN 'mcq_empty_bodies' END, CASE WHEN noisy_pct > 0 THEN 'mcq_noisy_bodies' END) END FROM scored_sites
UNION ALL SELECT site_id, 'multi_channel_discovery', 10, channels * 25,
 concat_ws(',', CASE WHEN channels = 0 THEN 'mcd_no_channels' ELSE 'mcd_channels_detected' END,
  CASE WHEN openapi THEN 'mcd_openapi_bonus' END,
  CASE WHEN provided AND layer THEN CASE WHEN provider_url THEN 'mcd_provider_configurable' ELSE 'mcd_provider_detected' END END)
 FROM scored_sites""")
