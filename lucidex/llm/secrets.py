"""Secret scans: certain patterns, and weak candidates that only count when their parts meet.

An access identifier, a secret and an endpoint make a credential together.  Identifiers, secrets and
endpoints that look like nothing by themselves are found as candidates, and an interval join reports
those that stand within a scope of a complementary part.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.common import saved, whole_text

#: Characters between the end of one part of a credential and the start of the next.
SCOPE = 240

#: Order of kinds among spans with one start: the base kinds, then the linked ones.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

FLAGS = re.IGNORECASE | re.ASCII
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Weak candidates: labelled names, strings that mix letters and digits, addresses.
IDENTIFIER = re.compile(r"""(?:client_?id|key_?id|access_?key|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{4,}""", FLAGS)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[^\x00-\x20"'<>]{4,}""", FLAGS)

#: A pattern is tried on a text only if one of these (lower-case) is in it; each match needs one.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "identifier": ("clientid", "client_id", "keyid", "key_id", "accesskey", "access_key", "account", "user", "login"),
    "endpoint": ("://", "host", "endpoint", "server", "url"),
}

SPAN = "struct<kind: string, start: int, end: int>"


def _mixed(token: str) -> bool:
    """Letters of both cases and digits, as drawn strings have."""
    return any(map(str.isdigit, token)) and any(map(str.isupper, token)) and any(map(str.islower, token))


def _lettered(token: str) -> bool:
    """Letters of any case and digits, as keys in one case, UUIDs and base32 have."""
    return any(map(str.isdigit, token)) and any(map(str.isalpha, token))


def _overlaps(spans: list[tuple[str, int, int]]):
    """A test if a span overlaps one of these, in the logarithm of their number."""
    ordered = sorted((start, end) for _, start, end in spans)
    starts, reach = [start for start, _ in ordered], list(itertools.accumulate((end for _, end in ordered), max))

    def test(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return test


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the certain patterns, by start, then kind."""
    low = text.lower()
    spans = []
    if any(h in low for h in HINTS["assign"]):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that no base span overlaps.

    A string in one case is no candidate inside an identifier or an address, where paths look like that.
    """
    low = text.lower()
    found = []
    if any(h in low for h in HINTS["identifier"]):
        found += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    if any(h in low for h in HINTS["endpoint"]):
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    inside, certain = _overlaps(found), _overlaps(base)
    found += [("secret", *m.span()) for m in SECRET.finditer(text) if _mixed(m[0]) or (_lettered(m[0]) and not inside(*m.span()))]
    return [s for s in found if not certain(s[1], s[2])]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    told = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
    for batch in batches:
        base, weak = [], []
        for text in batch.column("text"):
            text = text.as_py()
            base.append(base_spans(text))
            weak.append(weak_spans(text, base[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([told(x) for x in base], span), pa.array([told(x) for x in weak], span)],
            ["doc_id", "base", "weak"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: row (its number here), doc_id, base and weak spans; a narrow work table."""
    key = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", whole_text().alias("text")).mapInArrow(_scan, f"doc_id {key}, base array<{SPAN}>, weak array<{SPAN}>")
    return saved(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")


def link_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans (row, kind, start, end) that stand within *scope* of a complementary part.

    A secret needs an identifier or an endpoint; these need a secret.  Certain spans are parts too: an
    access key is an identifier, an assignment or a hexadecimal string is a secret.  The join is on
    row and bin of positions, so it sees a few neighbours however long the text; it is a semi-join and
    emits no pairs.
    """
    parts = scanned.select("row", F.explode(F.concat("base", "weak")).alias("_s")).select(
        "row", "_s.*", (F.col("_s.kind").isin("secret", "assign", "hex")).alias("_secret"))
    weak = parts.filter(F.col("kind").isin("identifier", "secret", "endpoint"))
    near = weak.withColumn("_bin", F.explode(F.expr(f"sequence(greatest(start - {scope}, 0) div {scope}, (end + {scope}) div {scope})")))
    other = parts.select(F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("_secret").alias("_is"),
                         F.explode(F.expr(f"sequence(start div {scope}, end div {scope})")).alias("_at"))
    met = near.join(other, (F.col("row") == F.col("_row")) & (F.col("_bin") == F.col("_at")) & (F.col("_secret") != F.col("_is"))
                    & (F.greatest("start", "_start") - F.least("end", "_end") <= scope), "left_semi")
    return met.select("row", "kind", "start", "end").distinct()


def _told(spans):
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_and_link(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base and linked spans, base_sha256 and spans as text.

    Positions count code points, ends are exclusive.  A null or empty text has no spans.  Repeated rows
    are scanned each.
    """
    scanned = scan(docs)
    linked = link_parts(scanned, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    both = scanned.join(linked, "row", "left").withColumn(
        "linked", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return both.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], "base", "linked",
                       F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"),
                       _told(F.concat("base", "linked")).alias("spans"))
