"""URL helpers as column expressions.

Parts are taken with patterns instead of ``parse_url``: crawled links hold blanks
and broken escapes that a strict parser answers with null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lucidex.functions.text import let

_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, 2)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, 3)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url_authority(url), r"^(?:[^@]*@)?([^:]*)", 1)


def registered_site(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(url_host(url), r"([^.]+\.[^.]+)$", 1)


def markdown_url(url: Column) -> Column:
    """Address of the Markdown twin of a page."""
    parts = F.struct(url.alias("url"), url_path(url).alias("path"), url_query(url).alias("query"))

    def mapped(p: Column) -> Column:
        bare = F.rtrim(p["url"], F.lit("/"))
        return (
            F.when(F.contains(F.lower(p["query"]), F.lit("format=md")), p["url"])
            .when(p["query"] != "", F.concat(p["url"], F.lit("&format=md")))
            .when(p["path"].endswith(".md"), p["url"])
            .when(F.rtrim(p["path"], F.lit("/")) == "", F.concat(bare, F.lit("/?format=md")))
            .otherwise(F.concat(bare, F.lit(".md")))
        )

    return let(parts, mapped)


def clean_file_name(segment: Column) -> Column:
    """A path segment that is safe as a file name.

    Special characters go, blanks become hyphens, runs of hyphens shrink to one and
    dots, hyphens and underscores do not stay at the ends.
    """
    plain = F.regexp_replace(segment, r"[?\[\]/\\=<>:;,'\"&$#*()|~`!{}%+’«»”“\x00]", "")
    hyphens = F.regexp_replace(plain, r"[\s-]+", "-")
    return F.btrim(hyphens, F.lit(".-_"))


def mirror_path(permalink: Column, home_path: Column, content_id: Column) -> Column:
    """Relative path of the mirrored Markdown file of a document."""
    by_id = F.concat(F.lit("post-"), content_id.cast("string"), F.lit(".md"))
    home = F.concat(F.lit("/"), F.btrim(home_path, F.lit("/")))
    path = url_path(permalink)
    inside = (home != "/") & path.startswith(home)
    rest = F.btrim(F.when(inside, F.substr(path, F.length(home) + 1)).otherwise(path), F.lit("/"))

    def joined(below: Column) -> Column:
        segments = F.filter(F.transform(F.split(below, "/"), clean_file_name), lambda s: s != "")
        return F.when(below == "", F.lit("index.md")).otherwise(let(segments, lambda s: F.when(
            F.size(s) == 0, by_id).otherwise(F.concat(F.array_join(s, "/"), F.lit(".md")))))

    return F.when(~url_query(permalink).isin("", "0"), by_id).otherwise(let(rest, joined))
