"""Pages deep in a listing, without ranking the rows before them.

Rows are counted by a coarse part of their order (the hour), the counts are summed from the front, and only the
buckets that the page lies in are looked at again, by a finer part (the time, then ranges of ids), until they
are small enough to be ranked.  A bulk import with one time is cut by its ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lucidex.operators.descriptions import MAX_PAGE_SIZE
from lucidex.sources.work import release, written

#: Rows of a bucket that are ranked in one task.
RANK_ROWS = 100_000

#: Bits of an id that the finer ranges leave open.
ID_BITS = (40, 30, 20, 10)

#: Before all times, for rows without one, which come last.
NO_TIME = -(1 << 62)


def _levels() -> list[Column]:
    """Parts of the order (newest first, then the greatest id), each finer than the one before; all descending."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("published_at")).cast("bigint")
    hour = F.floor(micros / 3_600_000_000).cast("bigint")
    return ([F.coalesce(hour, F.lit(NO_TIME)), F.coalesce(micros, F.lit(NO_TIME))]
            + [F.shiftright("content_id", bits) for bits in ID_BITS])


def deep_page_of(rows: DataFrame, page: int, size: int, group: Sequence[str] = ("site_id",), rank_rows: int | None = None) -> DataFrame:
    """What :func:`descriptions.page_of` gives, whatever the page's number.

    *rows* has ``published_at`` and ``content_id``; it is read once for each level that is needed (by its
    narrow columns) and once for the page.
    """
    page, size = max(1, page), min(MAX_PAGE_SIZE, max(1, size))
    first, last = (page - 1) * size, page * size
    group, levels = list(group), _levels()
    names = [f"_level{i}" for i in range(len(levels))]
    placed = rows.withColumns(dict(zip(names, levels)))
    chosen, totals = None, None
    for depth in range(len(levels)):
        above, now = names[:depth], names[:depth + 1]
        narrow = placed.select(*group, *now)
        inside = narrow.withColumn("_before", F.lit(0).cast("bigint")) if chosen is None else narrow.join(chosen.select(*group, *above, "_before"), [*group, *above])
        counts = inside.groupBy(*group, *now, "_before").agg(F.count(F.lit(1)).alias("_n"))
        counts = written(counts, "page-counts") if depth == 0 else counts
        ahead = Window.partitionBy(*group, *above).orderBy(F.desc(names[depth])).rowsBetween(Window.unboundedPreceding, -1)
        begun = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        picked = written(begun.filter((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)), "page-buckets")
        if totals is None:
            totals = written(counts.groupBy(*group).agg(F.sum("_n").alias("total")), "page-totals")
            release(counts)
        else:
            release(chosen)
        chosen = picked
        if (chosen.agg(F.max("_n")).first()[0] or 0) <= (RANK_ROWS if rank_rows is None else rank_rows):
            break
    inside = placed.join(chosen.select(*group, *now, "_before"), [*group, *now])
    order = Window.partitionBy(*group, *now).orderBy(F.desc("published_at"), F.desc("content_id"))
    ranked = inside.withColumn("position", (F.row_number().over(order) + F.col("_before")).cast("int"))
    shown = ranked.filter((F.col("position") > first) & (F.col("position") <= last)).drop("_before", *names)
    return (shown.join(totals, group)
            .withColumn("pages", F.ceil(F.col("total") / F.lit(size)).cast("bigint"))
            .withColumn("page", F.lit(page)))
