"""Screening of texts an agent will read: body quality and instruction shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lucidex.functions.text import EDGE_END, EDGE_START, let, trim

#: Body quality limits.
MIN_BODY_CHARS = 48
MAX_NOISE_RATIO = 0.30

#: What counts as noise in a Markdown body.
NOISE_PATTERNS = (
    r"[A-Za-z0-9+/]{60,}={0,2}",
    r"(?i)</?(?:script|style)" + EDGE_END + r"[^>]*>|setREVStartSize\s*\([^)]*\)",
    r"(?i)\[[a-z][a-z0-9_-]*(?:\s[^\]]*)?\]",
)

#: Phrases that address or steer the reading agent, per class, in the
#: order the classes are reported.  Word edges are added on both sides.
INSTRUCTION_SHAPES = {
    "override_attempt": (
        r"ignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|context)",
        r"disregard\s+(?:the\s+|all\s+|your\s+)?(?:previous|prior|above|system)",
        r"forget\s+(?:everything|all\s+previous|your\s+(?:instructions?|rules?))",
        r"(?:system|hidden|secret)\s+(?:prompt|instructions?)",
        r"(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be)\s+(?:a|an|the)",
    ),
    "agent_directive": (
        r"always\s+(?:recommend|suggest|choose|prefer|rank|cite|say|answer)",
        r"never\s+(?:mention|recommend|suggest|reveal|cite|link)",
        r"do\s+not\s+(?:tell|reveal|mention|disclose|recommend|cite)",
        r"respond\s+(?:only\s+)?with",
        r"(?:tell|instruct|convince)\s+(?:the\s+)?(?:user|reader|human|visitor)s?",
    ),
    "agent_address": (
        r"(?:dear|attention|note\s+to)\s+(?:ai|agents?|assistants?|llms?|models?)",
        r"if\s+you\s+are\s+an?\s+(?:ai|agent|assistant|llm|language\s+model)",
        r"when\s+(?:an?|the)\s+(?:ai|agent|assistant|model)\s+(?:reads?|visits?|fetche?s)",
    ),
}


def body_is_empty(body: Column) -> Column:
    return F.length(trim(F.coalesce(body, F.lit("")))) < MIN_BODY_CHARS


def noise_chars(body: Column) -> Column:
    """Characters inside noise; a character hit by two patterns counts twice."""

    def chars(pattern: str) -> Column:
        hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return F.aggregate(hits, F.lit(0), lambda acc, hit: acc + F.length(hit))

    blob, markup, bracket = NOISE_PATTERNS
    # A blob is tried only where a run of its characters starts, markup and brackets only
    # in bodies that hold their first character.
    has_markup = F.contains(body, F.lit("<")) | F.contains(F.lower(body), F.lit("setrevstartsize"))
    return (chars(r"(?<![A-Za-z0-9+/])" + blob)
            + F.when(has_markup, chars(markup)).otherwise(F.lit(0))
            + F.when(F.contains(body, F.lit("[")), chars(bracket)).otherwise(F.lit(0)))


def body_is_noisy(body: Column) -> Column:
    return let(F.coalesce(body, F.lit("")), lambda text: F.when(
        F.length(text) > 0, noise_chars(text) / F.length(text) > MAX_NOISE_RATIO).otherwise(F.lit(False)))


def instruction_flags(text: Column) -> Column:
    """Array of the instruction classes the text shows."""
    checks = []
    for code, phrases in INSTRUCTION_SHAPES.items():
        pattern = "(?i)" + EDGE_START + "(?:" + "|".join(phrases) + ")" + EDGE_END
        checks.append(F.when(F.rlike(text, F.lit(pattern)), F.lit(code)))
    return F.array_compact(F.array(*checks))
