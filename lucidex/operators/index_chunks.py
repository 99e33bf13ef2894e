"""Index texts in parts that survive an edit.

Lines of a section are ordered by keys that don't move when others come or go: newest first by time and id,
curated lines by their position.  A part begins at each entry whose hash says so, one in *average*, and is
named by that entry's order key, so a new document changes the part it falls in (or cuts it in two) and no
other.  Headings aren't in parts: they follow from which parts there are.

A part is found from both ends: the full build carries the last beginning along ranges of the order, one row
per range and group; a change batch reads only the parts it touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lucidex.functions import text as tx
from lucidex.operators.site_index import EDITORIAL_KIND, TYPE_KIND, identity_header
from lucidex.sources.work import written

#: Lines of a part, on average.
AVERAGE_LINES = 1000

#: Where lines belong: curated lines of a label, or one type's documents under it.
GROUP = ["site_id", "label", "entry_kind", "group_pos"]

#: Where a line stands in its group, and where its part begins.
ORDER, START = ["at", "at_id"], ["start", "start_id"]

ENTRY = [*GROUP, *ORDER, "entry_key", "line"]

FIRST = -(1 << 63)
LAST = (1 << 63) - 1


def _micros(column: str) -> Column:
    """A zone-less time as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(column)).cast("bigint")


def entry_lines(curated: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines with keys that hold still: of curated rows, and of entries with ``published_at`` and a line.

    ``entry_key`` names a line in its group; documents without a time come last.
    """
    pinned = curated.select(
        "site_id", "label", F.lit(EDITORIAL_KIND).alias("entry_kind"), F.lit(0).cast("bigint").alias("group_pos"),
        F.col("entry_pos").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("at_id"),
        F.concat(F.col("entry_pos").cast("string"), F.lit(" "), F.col("url")).alias("entry_key"), "line")
    documents = entries.select(
        "site_id", "label", F.lit(TYPE_KIND).alias("entry_kind"), F.col("type_order").cast("bigint").alias("group_pos"),
        F.coalesce(-_micros("published_at"), F.lit(LAST)).alias("at"), (-F.col("content_id")).alias("at_id"),
        F.col("content_id").cast("string").alias("entry_key"), "line")
    return pinned.unionByName(documents)


def begins(average: int) -> Column:
    """If an entry begins a part: by its name alone, so that an edit of its text moves nothing."""
    name = F.concat_ws("/", "site_id", F.col("entry_kind").cast("string"), "entry_key")
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % average == 0


def _carried(rows: DataFrame, window, average: int) -> DataFrame:
    """The last beginning at or before each row of the window."""
    here = F.when(begins(average), F.struct(F.col("at").alias("start"), F.col("at_id").alias("start_id")))
    return rows.withColumn("_start", F.last(here, ignorenulls=True).over(window))


def with_parts(lines: DataFrame, average: int = AVERAGE_LINES) -> DataFrame:
    """Every line with the beginning of its part.

    Ranges of the order are written, however many lines share a site or a time; the last beginning of
    the ranges before is carried over one row per range and group.
    """
    keys = [*GROUP, *ORDER, "entry_key"]
    ranged = written(lines.select(*ENTRY).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "index-ranges")
    inside = Window.partitionBy(*GROUP, "_range").orderBy(*ORDER, "entry_key")
    carried = _carried(ranged, inside, average)
    ends = carried.groupBy(*GROUP, "_range").agg(F.max("_start").alias("_end"))
    before = Window.partitionBy(*GROUP).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*GROUP, "_range", F.last("_end", ignorenulls=True).over(before).alias("_ahead"))
    start = F.coalesce("_start", "_ahead")
    return (carried.join(ahead, [*GROUP, "_range"])
            .select(*ENTRY, F.coalesce(start["start"], F.lit(FIRST)).alias("start"), F.coalesce(start["start_id"], F.lit(FIRST)).alias("start_id")))


def parts_of(placed: DataFrame) -> DataFrame:
    """The text of each part, its number of lines and its first order key."""
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, "entry_key", "line")))
    body = F.concat(F.array_join(F.transform(ordered, lambda o: o["line"]), "\n"), F.lit("\n"))
    return placed.groupBy(*GROUP, *START).agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first_at"), body.alias("body"))


def sections_of(parts: DataFrame) -> DataFrame:
    """Places of the sections: site_id, label, section_kind, section_pos; narrow rows of the parts decide."""
    curated = F.col("entry_kind") == EDITORIAL_KIND
    places = parts.groupBy("site_id", "label").agg(
        F.min(F.when(curated, F.col("first_at"))).alias("_pinned"), F.min(F.when(~curated, F.col("group_pos"))).alias("_type"))
    return places.select("site_id", "label", F.when(F.col("_pinned").isNotNull(), EDITORIAL_KIND).otherwise(TYPE_KIND).alias("section_kind"),
                         F.coalesce("_pinned", "_type").alias("section_pos"))


def text_rows(parts: DataFrame, profile: DataFrame) -> DataFrame:
    """The texts of all sites as ordered rows: header, headings and parts; sorted by ``place`` and joined they are the index."""
    sections = sections_of(parts)

    def place(kind, pos, label, entry, group, start, start_id):
        return F.struct(*[c.cast(t).alias(n) for n, t, c in (
            ("kind", "int", kind), ("pos", "bigint", pos), ("label", "string", label), ("entry", "int", entry),
            ("group", "bigint", group), ("start", "bigint", start), ("start_id", "bigint", start_id))])

    kind, pos = F.col("section_kind"), F.col("section_pos")
    first = (F.lit(-1), F.lit(FIRST), F.lit(FIRST), F.lit(FIRST))
    headings = sections.select("site_id", place(kind, pos, F.col("label"), *first).alias("place"),
                               F.concat(F.lit("\n## "), tx.escape_inline(F.col("label")), F.lit("\n\n")).alias("body"))
    texts = parts.join(sections, ["site_id", "label"]).select(
        "site_id", place(kind, pos, F.col("label"), F.col("entry_kind"), F.col("group_pos"), F.col("start"), F.col("start_id")).alias("place"), "body")
    listed = sections.select("site_id", F.lit(True).alias("_listed")).distinct()
    empty = (F.coalesce("site_name", F.lit("")) == "") & F.col("_listed").isNull()
    heads = profile.join(listed, "site_id", "left").select(
        "site_id", place(F.lit(-1), F.lit(FIRST), F.lit(""), *first).alias("place"),
        F.when(empty, F.lit("")).otherwise(identity_header(F.col("site_name"), F.col("tagline"))).alias("body"))
    return heads.unionByName(headings).unionByName(texts)


def _covering(asked: DataFrame, starts: DataFrame) -> DataFrame:
    """The asked places (group, order) with the beginning of the part that covers each.

    Both sides are narrow: one row per part and one per changed line.
    """
    marks = starts.select(*GROUP, F.col("start").alias("at"), F.col("start_id").alias("at_id"), F.lit(True).alias("_mark"))
    both = marks.unionByName(asked.select(*GROUP, *ORDER, F.lit(False).alias("_mark")).distinct())
    window = Window.partitionBy(*GROUP).orderBy("at", "at_id", F.desc("_mark"))
    here = F.when(F.col("_mark"), F.struct(F.col("at").alias("start"), F.col("at_id").alias("start_id")))
    found = both.withColumn("_start", F.last(here, ignorenulls=True).over(window)).filter(~F.col("_mark"))
    return found.select(*GROUP, *ORDER, F.coalesce("_start.start", F.lit(FIRST)).alias("start"), F.coalesce("_start.start_id", F.lit(FIRST)).alias("start_id"))


@dataclass(frozen=True)
class Change:
    """What a batch does: parts put or dropped, and the lines of all parts that were looked at, as they are then."""

    parts: DataFrame
    touched: DataFrame
    lines: DataFrame

    def parts_after(self, parts: DataFrame) -> DataFrame:
        """The parts after the change; texts of the others stay where they are."""
        kept = parts.join(self.parts.select(*GROUP, *START), [*GROUP, *START], "left_anti")
        return kept.unionByName(self.parts.filter("change = 'put'").select(*parts.columns))

    def lines_after(self, placed: DataFrame) -> DataFrame:
        """The placed lines after the change."""
        kept = placed.join(self.touched, [*GROUP, *START], "left_anti")
        return kept.unionByName(self.lines.select(*placed.columns))


def change_parts(placed: DataFrame, parts: DataFrame, puts: DataFrame, drops: DataFrame, average: int = AVERAGE_LINES) -> Change:
    """What a change batch does to the parts.

    *placed* and *parts* are the lines and texts as they stand.  *puts* are whole new or changed lines
    (:data:`ENTRY`); *drops* name lines that go (site_id, entry_kind, entry_key); a line that is put leaves its
    old place by itself.  Changed parts have their group and beginning, ``change`` (put or drop), ``lines``,
    ``first_at`` and ``body``.
    """
    name = ["site_id", "entry_kind", "entry_key"]
    gone_keys = puts.select(*name).unionByName(drops.select(*name)).distinct()
    narrow = placed.select(*GROUP, *ORDER, *START, "entry_key")
    # Lines of the batch only; they are read three times below.
    gone = written(narrow.join(gone_keys, name, "left_semi"), "index-gone")
    lost = (gone.filter((F.col("at") == F.col("start")) & (F.col("at_id") == F.col("start_id")))
            .join(puts.select(*GROUP, *ORDER, "entry_key"), [*GROUP, *ORDER, "entry_key"], "left_anti").select(*GROUP, *START).distinct())
    staying = parts.select(*GROUP, *START).join(lost, [*GROUP, *START], "left_anti")
    # The parts that lose a line, those that get one, and those that take over from a beginning that goes.
    moved = gone.select(*GROUP, *ORDER).unionByName(puts.select(*GROUP, *ORDER))
    touched = written(gone.select(*GROUP, *START).unionByName(_covering(moved, staying).select(*GROUP, *START)).distinct(), "index-touched")
    rows = (placed.join(touched, [*GROUP, *START], "left_semi").join(gone_keys, name, "left_anti").select(*ENTRY)
            .unionByName(puts.select(*ENTRY)))
    carried = _carried(rows, Window.partitionBy(*GROUP).orderBy(*ORDER, "entry_key"), average)
    now = written(carried.select(*ENTRY, F.coalesce("_start.start", F.lit(FIRST)).alias("start"),
                                 F.coalesce("_start.start_id", F.lit(FIRST)).alias("start_id")), "index-touched-lines")
    before = parts.join(touched, [*GROUP, *START], "left_semi").select(*GROUP, *START, F.sha1("body").alias("_was"))
    after = parts_of(now).join(before, [*GROUP, *START], "full_outer").filter(~F.sha1("body").eqNullSafe(F.col("_was")))
    changed = after.select(*GROUP, *START, F.when(F.col("body").isNull(), "drop").otherwise("put").alias("change"), "lines", "first_at", "body")
    return Change(changed, touched, now)
