"""Facts a model line may use: numbers and names found in the audit itself."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lucidex.functions.text import EDGE_END, EDGE_START
from lucidex.operators.audit import ENGINE_NAME

#: Names that are always allowed, and the token shapes.
COMMON_NAMES = (
    ENGINE_NAME, "Context Profile", "Context Score", "Site Health", "AI Client", "WP AI Client",
    "Markdown Views", "LLMs Index", "JSON-LD", "Tools Context",
)
NAME_PATTERN = EDGE_START + r"[A-Z][a-zA-Z]+(?:[\s/\-][A-Z][a-zA-Z]+)+" + EDGE_END
NUMBER_PATTERN = r"[0-9]+(?:%|/100)?"

_MARK = "\x01"


def _numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def names_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0)), F.lower)


def allowed_numbers() -> Column:
    """Numbers of a sub-score row: value, weight, facts (flags as 0/1), reason texts.

    Each also with ``%`` and ``/100``.
    """
    own = F.array(F.col("value").cast("string"), F.col("weight").cast("string"))
    facts = F.transform("facts", lambda f: F.when(f["value"] == "true", F.array(F.lit("1")))
                        .when(f["value"] == "false", F.array(F.lit("0")))
                        .otherwise(_numbers_in(f["value"])))
    texts = F.transform("reasons", lambda r: _numbers_in(r["text"]))
    bare = F.array_distinct(F.concat(own, F.flatten(facts), F.flatten(texts)))
    return F.array_distinct(F.flatten(F.transform(bare, lambda n: F.array(
        n, F.concat(n, F.lit("%")), F.concat(n, F.lit("/100"))))))


def allowed_entities() -> Column:
    found = F.flatten(F.transform("reasons", lambda r: names_in(r["text"])))
    common = F.array(*[F.lit(name.lower()) for name in COMMON_NAMES])
    return F.array_distinct(F.concat(found, common))


def lower_sentence_starts(line: Column) -> Column:
    """Lower-case the capital at the start of the line and of each sentence."""
    marked = F.regexp_replace(line, r"^(\s*)([A-Z])", "$1" + _MARK + "$2")
    marked = F.regexp_replace(marked, r"([.!?]\s+)([A-Z])", "$1" + _MARK + "$2")
    pieces = F.split(marked, _MARK)
    lowered = F.transform(pieces, lambda piece, i: F.when(
        i > 0, F.concat(F.lower(F.substring(piece, 1, 1)), F.substr(piece, F.lit(2)))).otherwise(piece))
    return F.array_join(lowered, "")


def line_is_safe(line: Column, numbers: Column, entities: Column) -> Column:
    """Every number and every multi-word name of the line is allowed."""
    used_numbers = F.regexp_extract_all(line, F.lit(NUMBER_PATTERN), F.lit(0))
    used_names = names_in(lower_sentence_starts(line))
    return (F.size(F.array_except(used_numbers, numbers)) == 0) & (F.size(F.array_except(used_names, entities)) == 0)
