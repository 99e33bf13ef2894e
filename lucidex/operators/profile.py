"""Site settings: defaults, cleaning, updates, and curated index entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.functions import text as tx

#: The settings a site has when it never stored any.
PROFILE_DEFAULTS = {
    "descriptions_enabled": True,
    "structured_data_enabled": False,
    "markdown_enabled": True,
    "advertise_enabled": True,
    "exclude_samples": True,
    "channels_enabled": True,
    "allow_inference": True,
    "allow_training": False,
    "full_index_enabled": True,
    "content_link_enabled": True,
}
DEFAULT_STATUSES = ("publish",)
ALLOWED_STATUSES = ("publish", "private", "password", "draft", "pending")
MIRROR_MODES = ("auto", "on", "off")
EDITORIAL_SECTIONS = ("Featured", "Resources", "Custom")
URL_SCHEMES = ("http", "https", "mailto")

LIST_COLUMNS = ("exposed_types", "exposed_statuses", "excluded_ids", "excluded_slugs",
                "excluded_term_ids", "excluded_term_slugs")


_NO_WORDS = "cast(array() AS array<string>)"


def _words(column: str) -> str:
    return f"coalesce({column}, {_NO_WORDS})"


def _key(item: str) -> str:
    return f"regexp_replace(lower({item}), r'[^a-z0-9_\\-]', '')"


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + value.replace("'", "\\'") + "'" for value in values)


def clean_types(column: str, public_types: tuple[str, ...]) -> Column:
    """Keys of public types, once each."""
    return F.expr(f"array_distinct(filter(transform({_words(column)}, v -> {_key('v')}), "
                  f"k -> k IN ({_quoted(public_types)})))")


def clean_statuses(column: str) -> Column:
    """Allowed statuses, once each; none left means published only."""
    kept = (f"array_distinct(filter(transform({_words(column)}, v -> {_key('v')}), "
            f"k -> k IN ({_quoted(ALLOWED_STATUSES)})))")
    return F.expr(f"transform(array({kept}), s -> CASE WHEN size(s) = 0 THEN array({_quoted(DEFAULT_STATUSES)}) "
                  f"ELSE s END)[0]")


def clean_ids(column: str) -> Column:
    """Absolute integers above zero, once each."""
    # A number that is too great for an id is no id, and not another one.
    number = "abs(try_cast(regexp_extract(v, r'^\\s*([+-]?[0-9]+)', 1) AS bigint))"
    return F.expr(f"array_distinct(filter(transform({_words(column)}, v -> {number}), n -> n > 0))")


def clean_slugs(column: str) -> Column:
    """Lower-case hyphenated slugs, once each."""
    blanks = "' \\n\\r\\t\\u000B\\u0000'"
    slug = f"trim(BOTH '-' FROM regexp_replace(lower(trim(BOTH {blanks} FROM v)), r'[^a-z0-9]+', '-'))"
    return F.expr(f"array_distinct(filter(transform({_words(column)}, v -> {slug}), s -> s <> ''))")


def normalise_profile(stored: DataFrame, public_types: tuple[str, ...] = ("post", "page", "product")) -> DataFrame:
    """Stored settings over defaults, with every list and mode cleaned.

    *stored* has one row per site; a null setting was never stored.  Statuses that
    were never stored and statuses that clean away both become the default.
    """
    flags = {name: F.coalesce(F.col(name), F.lit(default)) for name, default in PROFILE_DEFAULTS.items()}
    mode = F.col("static_mode")
    return stored.withColumns({
        **flags,
        "exposed_types": clean_types("exposed_types", public_types),
        "exposed_statuses": clean_statuses("exposed_statuses"),
        "excluded_ids": clean_ids("excluded_ids"),
        "excluded_slugs": clean_slugs("excluded_slugs"),
        "excluded_term_ids": clean_ids("excluded_term_ids"),
        "excluded_term_slugs": clean_slugs("excluded_term_slugs"),
        "static_mode": F.when(mode.isin(*MIRROR_MODES), mode).otherwise(F.lit("auto")),
    })


def update_exposure(stored: DataFrame, requests: DataFrame,
                    public_types: tuple[str, ...] = ("post", "page", "product")) -> DataFrame:
    """Replace the type and status lists of the sites in *requests*.

    Returns the whole cleaned table with ``changed``: true where the cleaned settings
    differ from before, which is what downstream rebuilds listen to.  A site that never
    stored settings gets a row of defaults first.
    """
    new_sites = requests.select("site_id").distinct().join(stored.select("site_id"), "site_id", "left_anti")
    stored = stored.unionByName(new_sites, allowMissingColumns=True)
    asked = requests.select("site_id", F.col("exposed_types").alias("new_types"),
                            F.col("exposed_statuses").alias("new_statuses"))
    before = normalise_profile(stored, public_types)
    joined = before.join(asked, "site_id", "left")
    is_asked = F.col("new_types").isNotNull()
    types = F.when(is_asked, clean_types("new_types", public_types)).otherwise(F.col("exposed_types"))
    statuses = F.when(is_asked, clean_statuses("new_statuses")).otherwise(F.col("exposed_statuses"))
    changed = (types != F.col("exposed_types")) | (statuses != F.col("exposed_statuses"))
    return joined.withColumns({
        "changed": changed, "exposed_types": types, "exposed_statuses": statuses,
    }).drop("new_types", "new_statuses")


def module_enabled(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(True))


def clean_editorial(raw: DataFrame) -> DataFrame:
    """Curated entries with a title and an allowed URL, in a known section."""
    url = tx.trim(F.coalesce("url", F.lit("")))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    allowed = (scheme == "") | scheme.isin(*URL_SCHEMES)
    label = tx.clean_field(F.coalesce("section_label", F.lit("")))
    asked = F.coalesce("section", F.lit("Featured"))
    known = F.when(asked.isin(*EDITORIAL_SECTIONS), asked).otherwise(F.lit("Featured"))
    section = F.when((known == "Custom") & (label == ""), F.lit("Featured")).otherwise(known)
    cleaned = raw.select(
        "site_id", "position",
        tx.clean_field(F.coalesce("title", F.lit(""))).alias("title"),
        F.when(allowed, url).otherwise(F.lit("")).alias("url"),
        tx.clean_field(F.coalesce("description", F.lit(""))).alias("description"),
        section.alias("section"),
        F.when(section == "Custom", label).otherwise(F.lit("")).alias("section_label"),
    )
    return (cleaned.filter((F.col("title") != "") & (F.col("url") != ""))
            .withColumn("rendered_label", rendered_label(F.col("section"), F.col("section_label"))))


def rendered_label(section: Column, section_label: Column) -> Column:
    """The heading an entry is shown under."""
    return (F.when(section == "Custom", section_label)
            .when(section.isin(*EDITORIAL_SECTIONS), section)
            .otherwise(F.lit("")))
