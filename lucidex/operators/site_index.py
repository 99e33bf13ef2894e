"""The per-site content index: entries, sections, lines, bodies, full documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lucidex.functions import text as tx
from lucidex.functions.urls import markdown_url
from lucidex.operators.descriptions import resolved_description
from lucidex.operators.exposure import weakly_exposed
from lucidex.operators.skew import attach, rank_all, top_per_group
from lucidex.operators.store import is_empty_markdown

#: Two labels.
NO_TITLE = "(no title)"
DEFAULT_EDITORIAL_LABEL = "Editorial"

#: Positions of one piece of a body.
LINES_PER_PIECE = 2000

KEY = ["site_id", "content_id"]

#: Section order: curated sections first, then types in profile order.
EDITORIAL_KIND, TYPE_KIND = 0, 1


def newest_per_type(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """All documents of each exposed type and status, newest first, or the newest *cap*.

    *rows* is content with its site's profile.  A cap comes before the exposure gate:
    refused documents use up places.
    """
    listed = rows.filter(weakly_exposed())
    group, order = ["site_id", "post_type"], [F.desc("published_at"), F.desc("content_id")]
    if cap is None:
        hour = F.unix_seconds(F.date_trunc("hour", F.col("published_at")).cast("timestamp"))
        ranked = rank_all(listed, group, hour, order, rank="type_rank")
    else:
        ranked = top_per_group(listed, group, order, cap, ["content_id"], rank="type_rank")
    return ranked.withColumn("type_order", F.array_position("exposed_types", F.col("post_type")).cast("int"))


def shown_title(title: Column) -> Column:
    """The title, or a placeholder where it is blank."""
    return F.coalesce(tx.present(title), F.lit(NO_TITLE))


def index_entries(gated: DataFrame, descriptions: DataFrame, store: DataFrame,
                  labels: dict[str, str] | None = None, plugged: Column | None = None) -> DataFrame:
    """Entries of capped, gated content.

    An entry is exposable and, where Markdown is on, its twin is not empty.  *gated*
    is the capped content with ``reason``; *labels* names the section of a type.
    """
    texts = store.select(*KEY, is_empty_markdown(F.coalesce("markdown", F.lit(""))).alias("_empty"))
    rows = (gated.filter(F.col("reason").isNull())
            .join(descriptions.select(*KEY, "manual", "auto"), KEY, "left")
            .join(texts, KEY, "left"))
    rows = rows.filter(~(F.col("markdown_enabled") & F.coalesce("_empty", F.lit(False))))
    url = F.when(F.col("markdown_enabled"), markdown_url(F.col("permalink"))).otherwise(F.col("permalink"))
    label = F.col("post_type")
    if labels:
        pairs = [F.lit(part) for pair in labels.items() for part in pair]
        label = F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)
    entries = rows.select(
        *KEY, "post_type", "type_order", "type_rank", "published_at",
        label.alias("label"),
        shown_title(F.col("title")).alias("title"),
        url.alias("url"),
        resolved_description(plugged if plugged is not None else F.lit(None).cast("string"),
                             F.col("manual"), F.col("auto"), F.col("excerpt")).alias("description"),
    )
    return entries.filter((F.col("title") != "") & (F.col("url") != "") & (F.col("label") != ""))


ROW_COLUMNS = ("site_id", "section_kind", "section_pos", "label", "opens_section", "entry_kind", "group_pos",
               "entry_pos", "content_id", "title", "url", "description")


def _curated(editorial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated rows, and the first position of each of their labels."""
    label = F.when(F.col("rendered_label") != "", F.col("rendered_label")).otherwise(F.lit(DEFAULT_EDITORIAL_LABEL))
    rows = editorial.filter((F.col("title") != "") & (F.col("url") != "")).select(
        "site_id", label.alias("label"), F.col("position").cast("bigint").alias("entry_pos"),
        "title", "url", "description")
    return rows, rows.groupBy("site_id", "label").agg(F.min("entry_pos").alias("curated_pos"))


def curated_rows(editorial: DataFrame) -> DataFrame:
    """Curated entries in their sections; a label may be hot and is spread."""
    rows, places = _curated(editorial)
    placed = attach(rows, places, ["site_id", "label"], ["url", "entry_pos"], "inner")
    return placed.withColumns({
        "section_kind": F.lit(EDITORIAL_KIND), "section_pos": F.col("curated_pos"),
        "opens_section": F.col("entry_pos") == F.col("curated_pos"),
        "entry_kind": F.lit(EDITORIAL_KIND), "group_pos": F.col("entry_pos"),
        "content_id": F.lit(None).cast("bigint"),
    }).select(*ROW_COLUMNS)


def type_places(entries: DataFrame) -> DataFrame:
    """The first rank that each label and type of a site has an entry for."""
    return entries.groupBy("site_id", "label", "type_order").agg(F.min("type_rank").alias("first_rank"))


def automatic_rows(entries: DataFrame) -> DataFrame:
    """Automatic entries in their sections, in profile order.

    Where a section begins is an aggregate with one row per label and type, attached to the entries.
    """
    places = type_places(entries)
    by_label = Window.partitionBy("site_id", "label")
    sections = places.withColumn("section_pos", F.min("type_order").over(by_label).cast("bigint"))
    placed = attach(entries, sections, ["site_id", "label", "type_order"], ["content_id"], "inner")
    return placed.withColumns({
        "section_kind": F.lit(TYPE_KIND),
        "opens_section": (F.col("type_order") == F.col("section_pos")) & (F.col("type_rank") == F.col("first_rank")),
        "entry_kind": F.lit(TYPE_KIND), "group_pos": F.col("type_order").cast("bigint"),
        "entry_pos": F.col("type_rank").cast("bigint"),
    }).select(*ROW_COLUMNS)


def index_rows(editorial: DataFrame, entries: DataFrame) -> DataFrame:
    """Curated and automatic entries with the place of their section.

    ``section_kind, section_pos`` orders the sections of a site and ``entry_kind,
    group_pos, entry_pos`` the entries in one.  A label met twice keeps its first place,
    with curated entries ahead.  Places come from the curated table and the capped
    entries, so no site is sorted as a whole and the entries are computed once.
    """
    _, places = _curated(editorial)
    automatic = automatic_rows(entries).join(places, ["site_id", "label"], "left")
    shared = F.col("curated_pos").isNotNull()
    merged = automatic.withColumns({
        "section_kind": F.when(shared, F.lit(EDITORIAL_KIND)).otherwise(F.col("section_kind")),
        "section_pos": F.coalesce("curated_pos", "section_pos"),
        "opens_section": F.col("opens_section") & ~shared,
    }).select(*ROW_COLUMNS)
    return curated_rows(editorial).unionByName(merged)


def index_measures(rows: DataFrame) -> DataFrame:
    """Entries per site, and how many automatic ones carry a description."""
    automatic = F.col("entry_kind") == TYPE_KIND
    return rows.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if(automatic).alias("total_entries"),
        F.count_if(automatic & (F.coalesce("description", F.lit("")) != "")).alias("entries_with_description"))


def entry_line(title: Column, url: Column, description: Column) -> Column:
    """One Markdown list line; both texts are escaped in one pass."""
    words = F.transform(F.array(title, F.coalesce(description, F.lit(""))), tx.escape_inline)

    def line(text: Column) -> Column:
        link = F.concat(F.lit("- ["), tx.escape_brackets(text[0]), F.lit("]("), tx.escape_link_url(url), F.lit(")"))
        return F.when(description != "", F.concat(link, F.lit(": "), text[1])).otherwise(link)

    return tx.let(words, line)


def index_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line", entry_line(F.col("title"), F.col("url"), F.col("description")))


def identity_header(site_name: Column, tagline: Column) -> Column:
    words = F.transform(F.array(F.coalesce(site_name, F.lit("")), F.coalesce(tagline, F.lit(""))), tx.escape_inline)

    def lines(text: Column) -> Column:
        first = F.concat(F.lit("# "), text[0], F.lit("\n"))
        return F.when(tagline != "", F.concat(first, F.lit("> "), text[1], F.lit("\n"))).otherwise(first)

    return tx.let(words, lines)


def _pieces(lines: DataFrame, lines_per_piece: int) -> DataFrame:
    """Section texts in pieces of bounded length.

    Entries are cut by their position, so a piece holds at most *lines_per_piece*
    positions of one source and no section is gathered whole.
    """
    slot = F.floor(F.col("entry_pos") / F.lit(lines_per_piece)).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct("entry_pos", "content_id", "url", "line")))
    text = F.concat(F.array_join(F.transform(ordered, lambda o: o["line"]), "\n"), F.lit("\n"))
    place = F.struct("section_kind", "section_pos", "label", "entry_kind", "group_pos", "slot")
    by_source = F.when(F.col("entry_kind") == TYPE_KIND, F.col("group_pos")).otherwise(F.lit(0))
    heading = F.concat(F.lit("\n## "), tx.escape_inline(F.col("label")), F.lit("\n\n"))
    return (lines.withColumns({"slot": slot, "group_pos": by_source})
            .groupBy("site_id", "section_kind", "section_pos", "label", "entry_kind", "group_pos", "slot")
            .agg(text.alias("text"), F.count(F.lit(1)).alias("lines"), F.bool_or("opens_section").alias("opens"))
            .select("site_id", place.alias("place"), "lines",
                    F.when(F.col("opens"), F.concat(heading, F.col("text"))).otherwise(F.col("text")).alias("text")))


def index_parts(lines: DataFrame, profile: DataFrame, lines_per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """The index text of each site in ordered parts: ``site_id, part, body, lines``.

    Sorted by ``part`` and joined, a site's parts are its text; the head has an empty part.  No part
    holds more than *lines_per_piece* lines and no site is gathered.  A site without a name and
    without sections has an empty head.
    """
    key = F.format_string("%d %019d %s %d %019d %019d", *[
        F.hex("place.label") if c == "label" else F.col(f"place.{c}") for c in (
            "section_kind", "section_pos", "label", "entry_kind", "group_pos", "slot")])
    texts = _pieces(lines, lines_per_piece).select("site_id", key.alias("part"), F.col("text").alias("body"), "lines")
    listed = lines.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
    empty = (F.coalesce("site_name", F.lit("")) == "") & F.col("_n").isNull()
    heads = profile.join(listed, "site_id", "left").select(
        "site_id", F.lit("").alias("part"),
        F.when(empty, F.lit("")).otherwise(identity_header(F.col("site_name"), F.col("tagline"))).alias("body"),
        F.lit(0).cast("bigint").alias("lines"))
    return heads.unionByName(texts)


def index_body(parts: DataFrame) -> DataFrame:
    """The text of each site in one row: ``site_id, body, lines``.

    For sites whose text is meant to be served as one; the parts themselves have no such limit.
    """
    ordered = F.sort_array(F.collect_list(F.struct("part", "body")))
    return parts.groupBy("site_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["body"]), "").alias("body"), F.sum("lines").alias("lines"))


def index_artifact(bodies: DataFrame) -> DataFrame:
    """Stored form of an index: bytes, the textual entry count and the hash of the text, per site."""
    body = tx.strip_bom(F.col("body"))
    return bodies.select(
        "site_id", F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.regexp_count("body", F.lit(r"\n- ")).cast("bigint").alias("entry_count"), F.sha1(body).alias("head_sha1"))


# --- full index ---------------------------------------------------------------------


def full_index(editorial: DataFrame, entries: DataFrame, store: DataFrame) -> DataFrame:
    """The full-text index as ordered rows, one per document or curated line.

    Bodies run to megabytes, so a site's text is never gathered: reading the rows of a
    site in order of ``section_kind, section_pos, entry_pos`` and joining ``text`` gives
    it.  Curated sections come first and do not merge with those of documents.
    """
    texts = store.select(*KEY, tx.trim(F.coalesce("markdown", F.lit(""))).alias("_body"))
    placed = attach(entries, type_places(entries), ["site_id", "label", "type_order"], ["content_id"], "inner")
    docs = placed.withColumn("_opens", F.col("type_rank") == F.col("first_rank")).join(texts, KEY, "left")
    lead = F.when(F.col("_opens"), F.concat(F.lit("\n## "), tx.escape_inline(F.col("label")), F.lit("\n"))).otherwise(
        F.lit("\n---\n"))
    body = F.when(F.coalesce("_body", F.lit("")) != "", F.concat(F.lit("\n"), F.col("_body"), F.lit("\n"))).otherwise(
        F.lit(""))
    doc_text = F.concat(
        lead, F.lit("\n### "), tx.escape_inline(F.col("title")), F.lit("\n\nURL: "),
        tx.escape_link_url(F.col("url")), F.lit("\n"), body)
    doc_out = docs.select("site_id", F.lit(TYPE_KIND).alias("section_kind"),
                          F.col("type_order").cast("bigint").alias("section_pos"), "label",
                          F.col("type_rank").cast("bigint").alias("entry_pos"), "content_id", doc_text.alias("text"))
    curated = index_lines(curated_rows(editorial))
    heading = F.concat(F.lit("\n## "), tx.escape_inline(F.col("label")), F.lit("\n\n"))
    curated_text = F.concat(F.when(F.col("opens_section"), heading).otherwise(F.lit("")), F.col("line"), F.lit("\n"))
    curated_out = curated.select("site_id", "section_kind", "section_pos", "label", "entry_pos", "content_id",
                                 curated_text.alias("text"))
    return curated_out.unionByName(doc_out)


def full_artifact(full_rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Size and counts of the full text of each site.

    ``doc_count_text`` counts headings in the text, and so also those inside bodies;
    ``doc_count`` counts documents.
    """
    counts = full_rows.groupBy("site_id").agg(
        F.count("content_id").alias("_docs"),
        F.sum(F.octet_length("text").cast("bigint")).alias("_bytes"),
        F.sum(F.regexp_count("text", F.lit(r"\n### ")).cast("bigint")).alias("_headings"))
    headers = profile.select("site_id", F.coalesce("site_name", F.lit("")).alias("_name"),
                             identity_header(F.col("site_name"), F.col("tagline")).alias("_header"))
    empty = (F.col("_name") == "") & F.col("_bytes").isNull()
    head_bytes = F.when(empty, F.lit(0)).otherwise(F.octet_length("_header"))
    return headers.join(counts, "site_id", "left").select(
        "site_id",
        (head_bytes + F.coalesce("_bytes", F.lit(0))).cast("bigint").alias("body_bytes"),
        F.coalesce("_headings", F.lit(0)).alias("doc_count_text"),
        F.coalesce("_docs", F.lit(0)).alias("doc_count"))
