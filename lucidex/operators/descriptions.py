"""Entry descriptions: which one is used, which are due, and what a result does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.functions import text as tx
from lucidex.operators.exposure import weakly_exposed
from lucidex.operators.skew import top_per_group

GENERATOR_VERSION = "1"

#: Limits of listings and runs, and the shortest text worth describing.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
DEFAULT_RUN_LIMIT = 10
MAX_RUN_LIMIT = 100
MIN_CONTENT_BYTES = 50

#: The prompt sent for a description and for a page summary.
DESCRIPTION_PROMPT = "Title: %s\nURL: %s\nExcerpt (may be truncated):\n%s"
SUMMARY_PROMPT = "Page content:\n\n"

KEY = ["site_id", "content_id"]


# --- which description is used ------------------------------------------------------


def resolved_description(plugged: Column, manual: Column, auto: Column, excerpt: Column) -> Column:
    """Plug-in value, manual, automatic, excerpt, in this order; one clean line or ''."""
    first = F.coalesce(*[tx.trim(tx.present(c)) for c in (plugged, manual, auto, excerpt)])
    return F.coalesce(tx.normalise_description(first), F.lit(""))


def description_source(manual: Column, auto: Column, excerpt: Column) -> Column:
    return (F.when(~tx.is_blank(manual), F.lit("manual"))
            .when(~tx.is_blank(auto), F.lit("auto"))
            .when(~tx.is_blank(excerpt), F.lit("excerpt"))
            .otherwise(F.lit("none")))


# --- staleness and eligibility ------------------------------------------------------


def outdated(generated_for: Column, modified: Column, version: Column) -> Column:
    """The automatic text was made for an older document or by an older generator."""
    return (generated_for.isNull() | (generated_for < modified)
            | (F.coalesce(version, F.lit("")) != GENERATOR_VERSION))


def is_stale(auto: Column, generated_for: Column, modified: Column, version: Column) -> Column:
    return ~tx.is_blank(auto) & outdated(generated_for, modified, version)


def is_eligible() -> Column:
    """Whether a row of exposure joined with its description may be queued."""
    due = tx.is_blank(F.col("auto")) | outdated(
        F.col("generated_for"), F.col("modified_at"), F.col("generator_version"))
    return (F.col("descriptions_enabled") & F.col("client_configured") & F.col("reason").isNull()
            & tx.is_blank(F.col("manual")) & due)


def eligible_rows(exposed: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Exposure rows with their description state, ``eligible`` and ``stale``."""
    return exposed.join(descriptions, KEY, "left").withColumns({
        "eligible": is_eligible(),
        "stale": is_stale(F.col("auto"), F.col("generated_for"), F.col("modified_at"), F.col("generator_version")),
    })


def run_limit(requested: int) -> int:
    return min(MAX_RUN_LIMIT, requested if requested > 0 else DEFAULT_RUN_LIMIT)


def considered_rows(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Documents of exposed type and status: all, or the newest *cap* of each site.

    *rows* is content with its site's profile.
    """
    exposed = rows.filter(weakly_exposed())
    if cap is None:
        return exposed
    return top_per_group(exposed, ["site_id"],
                         [F.desc("published_at"), F.desc("content_id")], cap, ["content_id"],
                         rank="considered_rank")


def take_budget(rows: DataFrame, limit: int) -> DataFrame:
    """The first *limit* eligible rows of each site, newest first."""
    return top_per_group(rows.filter("eligible"), ["site_id"], [F.desc("published_at"), F.desc("content_id")],
                         limit, ["content_id"], rank="queue_rank")


def run_counts(rows: DataFrame, limit: int) -> DataFrame:
    """Scheduled and skipped documents per site under a run limit."""
    totals = rows.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_considered"), F.count_if("eligible").alias("_eligible"))
    scheduled = F.least(F.col("_eligible"), F.lit(limit))
    return totals.select("site_id", scheduled.alias("scheduled"),
                         (F.col("total_considered") - scheduled).alias("skipped"), "total_considered")


# --- listings -----------------------------------------------------------------------


def status_filter(status: str) -> Column:
    """Rows a listing shows for a status; ``stale`` shows a superset the row flag narrows."""
    has_auto, has_manual = F.col("auto").isNotNull(), F.col("manual").isNotNull()
    return {
        "missing": ~has_auto & ~has_manual,
        "cached": has_auto,
        "manual": has_manual,
        "stale": has_auto,
        "pending": F.coalesce(F.col("job_status") == "pending", F.lit(False)),
        "failed": F.coalesce(F.col("job_status") == "failed", F.lit(False)),
        "needs-retry": F.coalesce(F.col("job_status") == "needs-retry", F.lit(False)),
    }.get(status, F.lit(True))


#: The states a listing can be asked for.
LISTING_STATES = ("all", "missing", "cached", "manual", "stale", "pending", "failed", "needs-retry")


def listings(rows: DataFrame, page: int, size: int) -> DataFrame:
    """The same page of every listing state, in one pass: rows of :func:`page_of` with ``listing``."""
    asked = F.array_compact(F.array(*[F.when(status_filter(s), F.lit(s)) for s in LISTING_STATES]))
    return page_of(rows.withColumn("listing", F.explode(asked)), page, size, ["site_id", "listing"])


def page_of(rows: DataFrame, page: int, size: int, group: Sequence[str] = ("site_id",)) -> DataFrame:
    """One page per site (or other group), newest first, with the total and the number of pages.

    Only the rows up to the page's end are ranked, the total is a plain count, and
    neither gathers a site in one task.
    """
    page, size = max(1, page), min(MAX_PAGE_SIZE, max(1, size))
    order = [F.desc("published_at"), F.desc("content_id")]
    ranked = top_per_group(rows, list(group), order, page * size, ["content_id"], rank="position")
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    shown = ranked.filter(F.col("position") > (page - 1) * size)
    return (shown.join(totals, list(group))
            .withColumn("pages", F.ceil(F.col("total") / F.lit(size)).cast("bigint"))
            .withColumn("page", F.lit(page)))


def search(content: DataFrame, term: str, page: int, size: int) -> DataFrame:
    """Published documents whose title, excerpt or body holds the term."""
    needle = F.lit(term.lower())
    text_hit = F.lit(False)
    for column in ("title", "excerpt", "body_html"):
        text_hit = text_hit | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), needle)
    rows = content.filter(F.col("status") == "publish")
    if term:
        rows = rows.filter(text_hit)
    slim = rows.select("site_id", "content_id", "title", "post_type", "permalink", "published_at")
    return page_of(slim, page, size if size > 0 else 50)


def status_tally(rows: DataFrame) -> DataFrame:
    """Documents per site by the first state that holds."""
    state = (
        F.when(~tx.is_blank(F.col("manual")), F.lit("manual_set"))
        .when(~tx.is_blank(F.col("auto")), F.lit("auto_cached"))
        .when(F.col("job_status") == "pending", F.lit("pending"))
        .when(F.col("job_status") == "needs-retry", F.lit("needs_retry"))
        .when(F.col("job_status") == "failed", F.lit("failed"))
        .otherwise(F.lit("missing"))
    )
    states = ("manual_set", "auto_cached", "pending", "needs_retry", "failed", "missing")
    counts = [F.count_if(F.col("_state") == name).alias(name) for name in states]
    return (rows.withColumn("_state", state).groupBy("site_id")
            .agg(F.count(F.lit(1)).alias("exposed_total"), *counts))


# --- prompts and results ------------------------------------------------------------


def plain_content(html: Column) -> Column:
    return tx.trim(tx.strip_tags(tx.unwrap_shortcodes(F.coalesce(html, F.lit("")))))


def below_floor(html: Column, floor: int | Column = MIN_CONTENT_BYTES) -> Column:
    """Whether the text has fewer bytes than the floor, which may differ by row."""
    return F.octet_length(plain_content(html)) < F.greatest(F.lit(0), F.lit(floor) if isinstance(floor, int) else floor)


def description_prompt(title: Column, url: Column, html: Column, most_bytes: int = 500) -> Column:
    """The prompt with the text's first *most_bytes* bytes, which is what its template promises."""
    excerpt = tx.cap_bytes(plain_content(html), most_bytes, tx.ELLIPSIS, most_bytes - 1)
    return F.format_string(DESCRIPTION_PROMPT, title, url, excerpt)


def summary_prompt(markdown: Column, most_chars: int = 2000) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT), tx.cap_chars(tx.trim(markdown), most_chars, "", most_chars))


def apply_results(descriptions: DataFrame, results: DataFrame) -> DataFrame:
    """Descriptions after a batch of generation results.

    *results* has one row per document: ``error_code``, ``needs_retry``, ``below_floor``,
    ``reply``, ``modified_at``.  ``changed`` says where the shown text changed.  A document
    without stored description gets one.
    """
    rows = descriptions.join(results, KEY, "full_outer")
    has_result = F.col("below_floor").isNotNull()
    low = has_result & F.col("below_floor")
    failed = has_result & ~F.col("below_floor") & F.col("error_code").isNotNull()
    text = tx.normalise_generated(F.coalesce("reply", F.lit("")))
    empty = has_result & ~low & ~failed & text.isNull()
    done = has_result & ~low & ~failed & text.isNotNull()
    before = F.coalesce("auto", F.lit(""))
    status = (
        F.when(low, F.lit("skipped"))
        .when(failed & F.col("needs_retry"), F.lit("needs-retry"))
        .when(failed | empty, F.lit("failed"))
        .when(done, F.lit("done"))
        .otherwise(F.col("job_status"))
    )
    drop = low & (before != "")
    return rows.select(
        *KEY,
        F.when(drop, F.lit(None)).when(done, text).otherwise(F.col("auto")).alias("auto"),
        "manual",
        F.when(drop, F.lit(None)).when(done, F.col("modified_at"))
        .otherwise(F.col("generated_for")).alias("generated_for"),
        F.when(drop, F.lit(None)).when(done, F.lit(GENERATOR_VERSION))
        .otherwise(F.col("generator_version")).alias("generator_version"),
        status.alias("job_status"),
        F.coalesce(drop | (done & (before != text)), F.lit(False)).alias("changed"),
    )


def apply_requests(descriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """Descriptions after editor requests, one per document.

    ``set`` stores a manual text (one that cleans to nothing clears it), ``clear``
    removes it, ``regenerate`` drops the automatic text unless a job is pending,
    ``reset`` drops everything.  A document without stored description gets a row.
    """
    rows = descriptions.join(requests.select(*KEY, "request", "manual_text"), KEY, "full_outer")
    asked = F.coalesce("request", F.lit(""))
    wanted = F.when(asked == "set", tx.normalise_generated(F.coalesce("manual_text", F.lit(""))))
    manual_before, auto_before = F.coalesce("manual", F.lit("")), F.coalesce("auto", F.lit(""))
    touches_manual = asked.isin("set", "clear", "reset")
    regenerates = (asked == "regenerate") & (F.coalesce("job_status", F.lit("")) != "pending")
    drops_auto = regenerates | (asked == "reset")
    changed = (
        F.when(asked == "set", manual_before != F.coalesce(wanted, F.lit("")))
        .when(asked == "clear", manual_before != "")
        .when(asked == "reset", (manual_before != "") | (auto_before != ""))
        .otherwise(F.lit(False))
    )

    def kept(column: str) -> Column:
        return F.when(~drops_auto, F.col(column))

    return rows.select(
        *KEY,
        kept("auto").alias("auto"),
        F.when(touches_manual, wanted).otherwise(F.col("manual")).alias("manual"),
        kept("generated_for").alias("generated_for"),
        kept("generator_version").alias("generator_version"),
        kept("job_status").alias("job_status"),
        regenerates.alias("requeued"),
        changed.alias("changed"),
    )
