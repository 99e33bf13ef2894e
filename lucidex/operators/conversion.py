"""HTML corpus to Markdown with quality signals and a score.

Preparation and scoring are native.  One narrow ``mapInPandas`` step in between
walks the document trees; it runs right after the scan, so the pages of a big table
are never shuffled.  Lower ``spark.sql.files.maxPartitionBytes`` for more, smaller
tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lucidex.functions import text as tx
from lucidex.operators import html_tree

#: Bumping this makes every stored conversion a miss.
CONVERTER_VERSION = "5"

#: The size gate and the score weights.
MAX_INPUT_BYTES = 5_242_880
SCORE_WEIGHTS = {
    "tag_strip_rate": 25,
    "orphan_inline_style_rate": 20,
    "table_fragment_rate": 15,
    "deep_div_nesting_rate": 10,
    "image_only_paragraph_rate": 10,
    "empty_line_run_rate": 10,
    "shortcode_residue_rate": 10,
}

_COUNTERS = html_tree.COUNTERS


def _map_documents(rows: DataFrame, key: list[str], source: str, outputs: list[tuple[str, T.DataType]],
                   work: Callable[[str], tuple]) -> DataFrame:
    """Apply *work* to one text column; only the key and that column reach Python."""
    slim = rows.select(*key, source)
    schema = T.StructType([slim.schema[name] for name in key] + [T.StructField(n, t) for n, t in outputs])
    names = [name for name, _ in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [work(text) for text in batch[source]]
            out = batch[key].copy()
            for i, name in enumerate(names):
                out[name] = [row[i] for row in done]
            yield out

    return slim.mapInPandas(run, schema)


#: Markup, with scripts and styles as a whole, and what counts as text outside of it.
_TAGS = re.compile(r"(?is)<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?-->|<[^>]*>")
_HAS_TEXT = re.compile(r"\w")


def _render(source: str) -> tuple:
    if not source:
        return ("",) + (0,) * len(_COUNTERS)
    markdown, counts = html_tree.to_markdown(source)
    return (markdown,) + tuple(counts[name] for name in _COUNTERS)


def tidy(markdown: Column) -> Column:
    """Final form: LF only, at most one blank line, no blanks at the ends, one newline."""
    unix = F.regexp_replace(markdown, r"\r\n|\r", "\n")
    return F.concat(tx.trim(F.regexp_replace(unix, r"\n{3,}", "\n\n")), F.lit("\n"))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def quality_signals(markdown: Column) -> Column:
    """The 18 signals from the counters of a row and its Markdown."""
    kilobytes = F.greatest(F.lit(1.0), F.octet_length(markdown) / F.lit(1024.0))
    blank_runs = F.regexp_count(markdown, F.lit(r"(?:\n[ \t]*+){3,}+"))
    leftovers = F.regexp_count(markdown, F.lit(r"(?i)\[[a-z][a-z0-9_-]*[\s\]/]"))

    def capped(value: Column) -> Column:
        return F.least(F.lit(1.0), value)

    return F.struct(
        _rate("empty_tags", "tags").alias("tag_strip_rate"),
        F.col("empty_tags").alias("tag_strip_count"),
        F.col("tags").alias("tag_total_count"),
        capped(F.col("styled_tags") / kilobytes / F.lit(10.0)).alias("orphan_inline_style_rate"),
        F.col("styled_tags").alias("orphan_inline_style_count"),
        _rate("broken_tables", "tables").alias("table_fragment_rate"),
        F.col("broken_tables").alias("table_fragment_count"),
        F.col("tables").alias("table_total_count"),
        _rate("deep_divs", "divs").alias("deep_div_nesting_rate"),
        F.col("deep_divs").alias("deep_div_count"),
        F.col("divs").alias("div_total_count"),
        _rate("image_paragraphs", "paragraphs").alias("image_only_paragraph_rate"),
        F.col("image_paragraphs").alias("image_only_paragraph_count"),
        F.col("paragraphs").alias("paragraph_total_count"),
        capped(blank_runs / F.lit(10.0)).alias("empty_line_run_rate"),
        blank_runs.alias("empty_line_run_count"),
        capped(leftovers / F.lit(5.0)).alias("shortcode_residue_rate"),
        leftovers.alias("shortcode_residue_count"),
    )


def quality_score(signals: Column) -> Column:
    """100 minus the weighted rates, subtracted in order, within 0..100, half up."""
    score = F.lit(100.0)
    for name, weight in SCORE_WEIGHTS.items():
        score = score - F.lit(float(weight)) * signals[name]
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))).cast("int")


def score_rows(rows: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Add ``signals`` and ``quality_score`` to rows that carry the counters."""
    return (rows.withColumn("signals", quality_signals(F.col(markdown)))
            .withColumn("quality_score", quality_score(F.col("signals"))))


def convert(rows: DataFrame, key: list[str], html: str = "body_html") -> DataFrame:
    """Markdown, signals and score of each document.

    Empty and oversize inputs give an empty text and a score of 100.  ``status`` says why a text is empty:
    ``empty`` (no input), ``oversize``, ``failed`` (nested deeper than the walk goes) or ``nothing_kept`` (the
    input has text and none of it was kept, as deep inside other elements); else it is ``ok``.
    """
    source = F.col(html)
    fits = (source != "") & (F.octet_length(source) <= MAX_INPUT_BYTES)
    oversize = F.octet_length(source) > MAX_INPUT_BYTES
    prepared = rows.select(*key, F.when(fits, tx.prepare_html(source)).when(oversize, F.lit(None)).otherwise(F.lit("")).alias("_prepared"))
    outputs = [("_markdown", T.StringType()), ("_has_input", T.BooleanType()), ("_status", T.StringType())]
    outputs += [(name, T.IntegerType()) for name in _COUNTERS]

    def work(text: str | None) -> tuple:
        if not text:
            return ("", False, "oversize" if text is None else "empty") + (0,) * len(_COUNTERS)
        try:
            markdown, *counts = _render(text)
        except RecursionError:
            return ("", False, "failed") + (0,) * len(_COUNTERS)
        return (markdown, True, "ok" if markdown.strip() or not _HAS_TEXT.search(_TAGS.sub("", text)) else "nothing_kept", *counts)

    rendered = _map_documents(prepared, key, "_prepared", outputs, work)  # an oversize input stays in the JVM
    final = F.when(F.col("_has_input"), tidy(F.col("_markdown"))).otherwise(F.lit(""))
    return (score_rows(rendered.withColumn("markdown", final))
            .select(*key, "markdown", "quality_score", "signals", *_COUNTERS, F.col("_status").alias("status")))


def main_regions(rows: DataFrame, key: list[str], html: str = "body_html") -> DataFrame:
    """Inner HTML of the main region of each page."""
    return _map_documents(rows, key, html, [("region_html", T.StringType())],
                          lambda text: (html_tree.main_region(text or ""),))


def signal_totals(converted: DataFrame) -> DataFrame:
    """Quality counters summed per site, with the rates over the sums."""
    sums = [F.sum(name).alias(name) for name in _COUNTERS]
    totals = converted.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("documents"), F.avg("quality_score").alias("mean_quality"), *sums)
    return totals.withColumns({
        "tag_strip_rate": _rate("empty_tags", "tags"),
        "table_fragment_rate": _rate("broken_tables", "tables"),
        "deep_div_nesting_rate": _rate("deep_divs", "divs"),
        "image_only_paragraph_rate": _rate("image_paragraphs", "paragraphs"),
    })


# --- where the HTML comes from -----------------------------------------------------


def source_html(body: Column, field_html: Column, region_html: Column,
                post_type: Column, short_text: Column) -> Column:
    """Body; if blank the custom-field text; if still blank the page's main region.

    A product's short text goes in front of its body before that choice.
    """
    body = F.coalesce(body, F.lit(""))
    short = F.coalesce(short_text, F.lit(""))
    fronted = F.when((post_type == "product") & (tx.trim(short) != ""),
                     F.concat(short, F.lit("\n"), body)).otherwise(body)

    def blank(html: Column) -> Column:
        return tx.strip_tags(F.coalesce(html, F.lit(""))) == ""

    with_fields = F.when(blank(fronted) & ~blank(field_html),
                         tx.trim(F.concat(field_html, F.lit("\n"), fronted))).otherwise(fronted)
    return F.when(blank(with_fields) & ~blank(region_html), tx.trim(region_html)).otherwise(with_fields)


# --- custom fields -----------------------------------------------------------------

#: Field types that hold text.
TEXT_FIELDS = frozenset(("text", "textarea", "wysiwyg", "email", "url"))


def _field_rows(fields_json: str) -> list[tuple[int, str, str]]:
    """(ordinal, type, trimmed text) of every text field, in field order."""
    import json

    def below(field: dict, value) -> list[tuple[dict, object]]:
        """The fields under one, with their values, in order."""
        kind = field.get("type")
        row_sets = []
        if kind in ("group", "clone") and isinstance(value, dict):
            row_sets = [(field.get("sub_fields"), value)]
        elif kind == "repeater" and isinstance(value, (list, dict)):
            rows = value.values() if isinstance(value, dict) else value
            row_sets = [(field.get("sub_fields"), row) for row in rows]
        elif kind == "flexible_content" and isinstance(value, (list, dict)):
            layouts = {one.get("name"): one.get("sub_fields") for one in field.get("layouts") or []
                       if isinstance(one, dict)}
            rows = value.values() if isinstance(value, dict) else value
            row_sets = [(layouts.get(row.get("acf_fc_layout")), row) for row in rows if isinstance(row, dict)]
        return [(sub, row.get(str(sub["name"]))) for sub_fields, row in row_sets if isinstance(row, dict)
                for sub in sub_fields or [] if isinstance(sub, dict) and "name" in sub]

    try:
        fields = json.loads(fields_json) if fields_json else {}
    except (ValueError, RecursionError):  # no JSON, or deeper than a parser goes
        return []
    fields = fields.values() if isinstance(fields, dict) else fields
    waiting = [(field, field.get("value")) for field in fields if isinstance(field, dict)][::-1]
    found = []
    while waiting:
        field, value = waiting.pop()
        if field.get("type") in TEXT_FIELDS:
            text = value.strip(html_tree._TRIM) if isinstance(value, str) else ""
            if text:
                found.append((len(found), field["type"], text))
        else:
            waiting.extend(below(field, value)[::-1])
    return found


def field_rows(rows: DataFrame, key: list[str], fields: str = "fields_json") -> DataFrame:
    """Custom fields flattened to one row per text value.

    The field tree is recursive, which no Spark type is, so the walk is in Python.
    """
    item = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()),
                         T.StructField("text", T.StringType())])
    packed = _map_documents(rows, key, fields, [("_items", T.ArrayType(item))],
                            lambda text: ([dict(zip(("ordinal", "kind", "text"), one)) for one in _field_rows(text)],))
    return packed.select(*key, F.inline("_items"))


def escape_html(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def field_html(flat: DataFrame, key: list[str]) -> DataFrame:
    """HTML of the text fields of each document, in field order."""
    safe = escape_html(F.col("text"))
    fragment = (
        F.when(F.col("kind") == "wysiwyg", F.col("text"))
        .when(F.col("kind") == "textarea",
              F.concat(F.lit("<p>"), F.regexp_replace(safe, r"(\r\n|\n\r|\n|\r)", "<br />$1"), F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))
    )
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", fragment.alias("html"))))
    return flat.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda o: o["html"]), "\n").alias("field_html"))
