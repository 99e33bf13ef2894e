"""Classifiers for access logs, crawl responses and job logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lucidex.functions.text import clean_key, trim

#: Cache states, generic headers and error markers.
CLOUDFLARE_CACHED = ("hit", "stale", "updating", "revalidated")
GENERIC_CACHE_HEADERS = ("x-cache", "x-proxy-cache", "x-nginx-cache", "x-cache-status")
RATE_LIMIT_MARKERS = (
    "rate limit", "rate-limit", "rate_limit", "429", "quota", "too many requests", "exceeded",
)
PERMANENT_MARKERS = (
    "400", "401", "403", "404", "415", "422",
    "bad request", "unauthorized", "forbidden", "not found", "unprocessable",
)
NARRATIVE_REASONS = {
    "unconfigured": "unconfigured",
    "rate_limit": "rate_limit",
    "permanent": "permanent_error",
    "network": "network_error",
}
SUMMARY_STATES = {"unconfigured": "unconfigured", "permanent": "permanent"}


def wants_markdown(path: Column, format_arg: Column, accept: Column) -> Column:
    """Whether a request asks for the Markdown twin."""
    return (
        F.when(path.endswith(".md"), F.lit("route"))
        .when(clean_key(F.coalesce(format_arg, F.lit(""))) == "md", F.lit("query"))
        .when(F.contains(F.lower(F.coalesce(accept, F.lit(""))), F.lit("text/markdown")), F.lit("accept"))
    )


def cache_label(headers: Column) -> Column:
    """The cache layer a map of response headers gives away, or null."""
    lowered = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(F.map_keys(headers), F.lower)),
        lambda name: F.struct(name, F.element_at(F.filter(
            F.transform(F.map_entries(headers), lambda e: F.struct(
                F.lower(e["key"]).alias("k"), F.lower(trim(e["value"])).alias("v"))),
            lambda e: e["k"] == name), -1)["v"])))

    def at(name: str) -> Column:
        return F.try_element_at(lowered, F.lit(name))

    label = (
        F.when(at("x-kinsta-cache").isNotNull(), F.lit("Kinsta"))
        .when(at("cf-cache-status").isin(*CLOUDFLARE_CACHED), F.lit("Cloudflare"))
        .when(at("x-litespeed-cache") == "hit", F.lit("LiteSpeed server"))
        .when(at("x-varnish").isNotNull(), F.lit("Varnish"))
        .when(at("x-sucuri-cache") == "hit", F.lit("Sucuri"))
    )
    for name in GENERIC_CACHE_HEADERS:
        label = label.when(F.contains(at(name), F.lit("hit")), F.lit(f"proxy cache ({name})"))
    age = F.regexp_extract(at("age"), r"^\s*([0-9]+)", 1)
    return label.when(F.regexp_replace(age, "^0+", "") != "", F.lit("shared cache (Age header)"))


def error_class(message: Column) -> Column:
    lowered = F.lower(message)

    def has_any(markers: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for marker in markers:
            found = found | F.contains(lowered, F.lit(marker))
        return found

    return (F.when(has_any(RATE_LIMIT_MARKERS), F.lit("rate_limit"))
            .when(has_any(PERMANENT_MARKERS), F.lit("permanent"))
            .otherwise(F.lit("network")))


def lookup(code: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def narrative_reason(code: Column) -> Column:
    """Why a narrative fell back to rules."""
    return lookup(code, NARRATIVE_REASONS, "parse_error")


def summary_state(code: Column) -> Column:
    return lookup(code, SUMMARY_STATES, "needs_retry")
