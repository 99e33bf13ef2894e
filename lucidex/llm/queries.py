"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from lucidex.llm import alignment, bpe, chat, lines, lm, mixture, quality, ranked, repeats, rules, secrets, simhash, spotsigs
from lucidex.llm.common import table, whole_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query("op1_attention_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_spot_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints_and_edits(table(spark, sf_dir, "documents"), bare=True, sparse=spotsigs.SPARSE)


REPEATS_SQL = """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(length(h) // 2 - 49)) AS s, h FROM texts WHERE length(h) >= 100),
named AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS name FROM starts),
least AS (SELECT name, min(doc_id) AS first FROM named GROUP BY name),
again AS (SELECT n.doc_id, n.s FROM named n JOIN least l USING (name) WHERE l.first < n.doc_id),
placed AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS opens FROM again),
runs AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM placed),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM runs GROUP BY doc_id, run),
ordered AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
    SELECT t.doc_id, count(o.a) AS n_spans, coalesce(sum(o.b - o.a), 0) AS n_removed,
           coalesce(string_agg(substr(t.h, 2 * o.before + 1, 2 * (o.a - o.before)), '' ORDER BY o.a), '') || substr(any_value(t.h), 2 * coalesce(max(o.b), 0) + 1) AS kept,
           any_value(length(t.h) // 2) AS n_bytes
    FROM texts t LEFT JOIN ordered o ON t.doc_id = o.doc_id GROUP BY t.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM cut
"""


@query("op3_repeated_strings", REPEATS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_simhash_groups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_bpe_encoding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


LINES_SQL = rf"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
every AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM cut),
lines AS (SELECT * FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, min({{'d': doc_id, 'n': line_no}}) AS first FROM lines GROUP BY line),
variants AS (
    SELECT line, first, p, left(line, p - 1) || substr(line, p + 1) AS variant
    FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS p FROM firsts WHERE length(line) >= {lines.MIN_CHARS})),
near AS (
    SELECT a.line FROM variants a JOIN variants b ON a.variant = b.variant AND a.p = b.p AND a.line <> b.line AND b.first < a.first
    UNION SELECT f.line FROM firsts f JOIN variants v ON v.variant = f.line AND v.first < f.first WHERE length(f.line) >= {lines.MIN_CHARS}
    UNION SELECT v.line FROM firsts f JOIN variants v ON v.variant = f.line AND f.first < v.first WHERE length(f.line) >= {lines.MIN_CHARS}),
gone AS (
    SELECT l.doc_id, l.line_no FROM lines l JOIN firsts f USING (line)
    WHERE f.first <> {{'d': l.doc_id, 'n': l.line_no}} OR l.line IN (SELECT line FROM near))
SELECT e.doc_id, count(l.line_no) AS n_lines, count(g.line_no) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (WHERE g.line_no IS NULL), '')) AS kept_sha256
FROM every e LEFT JOIN lines l ON e.doc_id = l.doc_id AND e.line_no = l.line_no
LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line_no = g.line_no GROUP BY e.doc_id
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_and_link(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


MIX_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5(name || '|' || (row_number() OVER (PARTITION BY name) - 1)), 1, 15) AS BIGINT) AS hash
    FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS name FROM documents)),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
    SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight
    FROM sources),
levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least(source_size * 2.0::DOUBLE,
           coalesce(max(CASE WHEN level * weight <= source_size * 2.0::DOUBLE THEN level END) OVER () * weight, source_size * 2.0::DOUBLE)) AS target
    FROM levels),
plans AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
           target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
    FROM targets),
bars AS (
    SELECT source, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto
    FROM sizes GROUP BY source, hash),
edges AS (
    SELECT p.source, min(CASE WHEN b.upto > p.rest THEN b.hash END) AS edge,
           arg_min(b.upto - p.rest < p.rest - (b.upto - b.size), CASE WHEN b.upto > p.rest THEN b.hash END) AS take_it
    FROM plans p LEFT JOIN bars b ON p.source IS NOT DISTINCT FROM b.source GROUP BY p.source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * least(2, p.whole + CASE WHEN e.edge IS NULL OR s.hash < e.edge OR (s.hash = e.edge AND e.take_it) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""


@query("op9_source_mixture", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


SEARCH_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
sized AS (SELECT row, doc_id, terms, 25 + (75 * n * n_docs) // n_terms AS m FROM docs, totals),
items AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY item_id, term),
occurrences AS (SELECT row, doc_id, m, unnest(terms) AS term FROM sized),
postings AS (SELECT row, doc_id, m, term, count(*) AS tf FROM occurrences WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM postings, totals GROUP BY term),
scores AS (
    SELECT item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) GROUP BY item_id, row, doc_id),
ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TAILS = "|".join(re.escape(c[1:]) for c in chat.CONTROLS)
CHAT_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, CAST(length('<|im_start|>') + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),
                   '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')) + 1
              + length(regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')) + length('<|im_end|>') + 1 AS BIGINT) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op12_chat_formatting", CHAT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_all(spark, table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
