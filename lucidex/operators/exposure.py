"""Which documents agents may see, and the first reason for each refusal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.operators.skew import attach

#: Sample slugs and the taxonomies that can exclude a document.
SAMPLE_SLUGS = ("hello-world", "sample-page")
EXCLUDING_TAXONOMIES = ("category", "post_tag")

#: Metadata keys the gate reads.
EXCLUDE_KEY = "excluded"
YOAST_KEY = "yoast_noindex"


def with_profile(content: DataFrame, profile: DataFrame) -> DataFrame:
    """Content with the settings of its site; documents of unknown sites go.

    Done once per query: later steps read the settings from the row, and unused ones
    are pruned from the plan.
    """
    return attach(content, profile, ["site_id"], ["content_id"], "inner")


def pivot_meta(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document with one column per wanted key.

    The key list is fixed, so the pivot is one aggregate with map-side combine.
    """
    columns = [F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in keys]
    return meta.filter(F.col("key").isin(*keys)).groupBy("site_id", "content_id").agg(*columns)


def noindex_flag(posture: Column, yoast: Column, robots: Column,
                 robots_default: Column, robots_noindex: Column) -> Column:
    """Noindex as the active SEO plug-in records it."""
    flag = (
        F.when(posture == "yoast", yoast == "1")
        .when(posture == "rank_math", F.array_contains(robots, "noindex"))
        .when(posture == "aioseo", ~F.coalesce(robots_default, F.lit(True)) & robots_noindex)
    )
    return F.coalesce(flag, F.lit(False))


def term_excluded(terms: Column, term_ids: Column, term_slugs: Column) -> Column:
    """Any category or tag on the deny lists; empty lists deny nothing."""
    counted = F.filter(terms, lambda t: t["taxonomy"].isin(*EXCLUDING_TAXONOMIES))
    by_id = F.arrays_overlap(F.transform(counted, lambda t: t["term_id"]), term_ids)
    by_slug = F.arrays_overlap(F.transform(counted, lambda t: t["slug"]), term_slugs)
    return F.coalesce(by_id, F.lit(False)) | F.coalesce(by_slug, F.lit(False))


def explicitly_excluded(meta_flag: Column, content_id: Column, slug: Column, terms: Column,
                        ids: Column, slugs: Column, utility_ids: Column,
                        term_ids: Column, term_slugs: Column) -> Column:
    flagged = F.coalesce(meta_flag == "1", F.lit(False))
    listed = F.coalesce(F.array_contains(ids, content_id), F.lit(False))
    named = (slug != "") & F.coalesce(F.array_contains(slugs, slug), F.lit(False))
    utility = (content_id != 0) & F.coalesce(F.array_contains(utility_ids, content_id), F.lit(False))
    return flagged | listed | named | utility | term_excluded(terms, term_ids, term_slugs)


def gate_inputs(rows: DataFrame, meta: DataFrame, robots: DataFrame,
                extra_noindex: Column | None = None) -> DataFrame:
    """Rows of :func:`with_profile` with every flag the gate needs.

    Metadata and robots rows join on the document key, which no site can skew.
    """
    flags = pivot_meta(meta, [EXCLUDE_KEY, YOAST_KEY])
    rows = (rows.join(flags, ["site_id", "content_id"], "left")
            .join(robots, ["site_id", "content_id"], "left"))
    noindex = noindex_flag(F.col("seo_posture"), F.col(YOAST_KEY), F.col("robots"),
                           F.col("robots_default"), F.col("robots_noindex"))
    if extra_noindex is not None:
        noindex = noindex | F.coalesce(extra_noindex, F.lit(False))
    return rows.withColumns({
        "noindex": noindex,
        "excluded_by_rule": explicitly_excluded(
            F.col(EXCLUDE_KEY), F.col("content_id"), F.col("slug"), F.col("terms"),
            F.col("excluded_ids"), F.col("excluded_slugs"), F.col("utility_ids"),
            F.col("excluded_term_ids"), F.col("excluded_term_slugs")),
        "is_sample": F.coalesce(F.col("exclude_samples"), F.lit(False)) & F.col("slug").isin(*SAMPLE_SLUGS),
    })


def exposure_reason() -> Column:
    """The first refusal of a row of :func:`gate_inputs`; null means exposable."""
    return (
        F.when(~F.array_contains("exposed_types", F.col("post_type")), F.lit("cpt"))
        .when(~F.array_contains("exposed_statuses", F.col("status")), F.lit("status"))
        .when(F.col("password") != "", F.lit("password"))
        .when(F.col("noindex"), F.lit("noindex"))
        .when(F.col("excluded_by_rule"), F.lit("excluded"))
        .when(F.col("is_sample"), F.lit("sample"))
    )


def with_exposure(rows: DataFrame, meta: DataFrame, robots: DataFrame,
                  extra_noindex: Column | None = None) -> DataFrame:
    gated = gate_inputs(rows, meta, robots, extra_noindex)
    return gated.withColumn("reason", exposure_reason())


def exposable(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("reason").isNull())


def weakly_exposed() -> Column:
    """Type and status only, as structured data uses it."""
    return (F.array_contains("exposed_types", F.col("post_type"))
            & F.array_contains("exposed_statuses", F.col("status")))


def deny_listed(content: DataFrame, denied_ids: DataFrame) -> DataFrame:
    """Drop documents on a deny list that is too long for an array column."""
    return content.join(denied_ids, ["site_id", "content_id"], "left_anti")


def term_denied(content_terms: DataFrame, denied_terms: DataFrame) -> DataFrame:
    """Documents with a term on a long deny list.

    *content_terms* has one row per document and term.  Terms repeat across many
    documents, so the deny list is spread over the pieces of a hot term.
    """
    hits = attach(content_terms, denied_terms.select("site_id", "slug").distinct().withColumn("denied", F.lit(True)),
                  ["site_id", "slug"], ["content_id"], "inner")
    return hits.select("site_id", "content_id").distinct()


def apply_transforms(rows: DataFrame, transforms: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run plug-in steps that take and return a DataFrame."""
    for step in transforms:
        rows = step(rows)
    return rows
