"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit (a character put in, taken out or replaced) exactly if one is the other
with a character deleted, or both are the same with one deleted at one place.  So every line emits
itself and its deletions as hashed keys, and equal keys meet.

A line of n characters has n deletions.  Most can be left out beforehand without losing a pair: cut at
fixed places, two lines within one edit agree in all pieces but one.  Lines that share no half with
another line emit nothing, and those that do are cut into about the root of n pieces, of which only
the ones that may differ are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.llm.common import release, saved, whole_text

#: Shorter lines must be equal to count as copies: one edit is much of them.
MIN_CHARS = 24

HAS_WORD = r"[^\x20\x09-\x0D]"


def _doc_key() -> list[Column]:
    """A document's name: its doc_id and a hash of its text, so that rows that share an id don't mix."""
    return [F.col("doc_id"), F.xxhash64(whole_text()).alias("text_hash")]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line for every line with a word; lines end at a line feed."""
    return (docs.select(*_doc_key(), F.posexplode(F.split(whole_text(), "\n")).alias("line_no", "line"))
            .filter(F.col("line").rlike(HAS_WORD)))


def _cut(base: Column, pieces: Column, i: Column) -> Column:
    """Where piece i of a line of *base* characters begins."""
    return F.floor(base.cast("long") * i / pieces)


def piece_keys(line: Column, length: Column, pieces) -> Column:
    """The line without one of its pieces, for each piece, as structs of base, piece and key.

    The cuts are those of the shorter line of a pair, ``base`` characters long: a line plays that part
    with its own length, and the longer part with its length less one.
    """
    def keys(base: Column) -> Column:
        count = pieces(base)

        def one(i: Column) -> Column:
            start, end = _cut(base, count, i).cast("int"), _cut(base, count, i + 1).cast("int")
            key = F.xxhash64(base, i, F.substr(line, F.lit(1), start), F.right(line, base - end))
            return F.struct(base.alias("base"), start.alias("start"), end.alias("end"), key.alias("key"))

        return F.transform(F.sequence(F.lit(0), count - 1), one)

    return F.concat(keys(length), keys(length - 1))


def half_keys(line: Column, length: Column) -> Column:
    """The halves of a line, for each of the parts that it may play; as :func:`piece_keys` with two pieces."""
    keys = []
    for base in (length, length - 1):
        middle = F.shiftright(base, 1)
        keys += [F.xxhash64(base, F.lit(0), F.left(line, middle)), F.xxhash64(base, F.lit(1), F.right(line, base - middle))]
    return F.array(*keys)


def _roots(base: Column) -> Column:
    return F.ceil(F.sqrt(base.cast("double"))).cast("int")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows (h, key and more) whose key another line has too."""
    keys = keyed.groupBy("key").agg(F.min("h").alias("_low"), F.max("h").alias("_high")).filter("_low <> _high").select("key")
    return keyed.join(keys, "key", "left_semi")


def deletions(lines: DataFrame) -> DataFrame:
    """Hashed variants of each line (h, first, line, length, base, start, end): (h, first, role, key).

    A line in the shorter part gives itself (role whole) and, against lines of its own length, itself
    less one character together with the place (role at).  A line in the longer part gives itself less
    one character (role less).  Only places in the piece from start to end are tried.
    """
    line, length, base = F.col("line"), F.col("length"), F.col("base")

    def less(p: Column) -> tuple[Column, Column]:
        return F.substr(line, F.lit(1), p - 1), F.right(line, length - p)

    role = lambda name, key: F.struct(F.lit(name).alias("role"), key.alias("key"))
    # Pieces are never empty: there are at most as many as characters.
    at = F.transform(F.sequence(F.col("start") + 1, F.col("end")), lambda p: role("at", F.xxhash64(F.lit("at"), length, p, *less(p))))
    one_less = F.transform(F.sequence(F.col("start") + 1, F.col("end") + 1), lambda p: role("less", F.xxhash64(F.lit("less"), F.concat(*less(p)))))
    whole = F.array(role("whole", F.xxhash64(F.lit("less"), line)))
    emitted = F.when(length == base, F.concat(whole, at)).otherwise(one_less)
    return lines.select("h", "first", F.explode(emitted).alias("_v")).select("h", "first", "_v.*").distinct()


def near_lines(occurrences: DataFrame, firsts: DataFrame, texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The hashes h of lines within one edit of an earlier line.

    occurrences: h, halves.  firsts: h, first (doc_id, text_hash, line_no).  texts: the lines.  Groups
    of equal keys are met by minima: each line is held against the earliest of its group, so a group
    costs its size and not its pairs, and no link to something earlier is lost: lines with one
    character deleted at one place are all within one edit, and so are a line and all that become it.
    """
    halves = occurrences.select("h", F.explode("halves").alias("key")).distinct()
    # Written before texts are joined, so that the shuffles of keys and texts don't stand side by side.
    shared = saved(_shared(halves).select("h").distinct(), "line-shared")
    some = shared.join(firsts.select("h", "first"), "h")
    stands = (F.col("text_hash") == F.col("first.text_hash")) & (F.col("line_no") == F.col("first.line_no"))
    few = (texts.join(some, stands & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
           .select("h", "first", "line", F.length("line").alias("length")).dropDuplicates(["h"]))
    few = saved(few, "line-few")
    cut = saved(_shared(few.select("h", F.explode(piece_keys(F.col("line"), F.col("length"), _roots)).alias("_p")).select("h", "_p.*"))
                .select("h", "base", "start", "end").distinct(), "line-pieces")
    variants = saved(deletions(few.join(cut, "h")), "line-variants")
    told = F.struct("first", "h")
    groups = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, told)).alias(f"_{r}") for r in ("at", "whole", "less")])
    other = F.when(F.col("role") == "at", F.col("_at")).when(F.col("role") == "whole", F.col("_less")).otherwise(F.col("_whole"))
    met = (variants.join(groups, "key").withColumn("_other", other)
           .filter("_other.first < first").select("h", F.col("_other.h").alias("_other")).distinct())
    text = few.select("h", "line")
    checked = met.join(text, "h").join(text.select(F.col("h").alias("_other"), F.col("line").alias("_line")), "_other")
    near = saved(checked.filter(F.levenshtein("line", "_line", 1) >= 0).select("h").distinct(), "line-near")
    release(shared, few, cut, variants)
    return near


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash and the sorted numbers of the lines that go, for documents that lose any."""
    lines = lines_of(docs)
    long = F.length("line") >= min_chars
    seen = saved(lines.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"),
                              F.when(long, half_keys(F.col("line"), F.length("line"))).alias("halves")), "line-seen")
    firsts = saved(seen.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first")), "line-firsts")
    near = near_lines(seen, firsts, lines, min_chars)
    judged = firsts.join(near.withColumn("_near", F.lit(True)), "h", "left")
    gone = (seen.select("doc_id", "text_hash", "line_no", "h", "g").join(judged, ["h", "g"])
            .filter(F.col("_near").isNotNull() | (F.struct("doc_id", "text_hash", "line_no") != F.col("first"))))
    found = saved(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "line-gone")
    release(seen, firsts, near)
    return found


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that repeat an earlier one, and n_lines and n_removed.

    A line counts if it has a word; others stay where they are.  It goes if a line equal to it, or
    within one edit where both have *min_chars* characters, is earlier: in a smaller doc_id (null
    first) or higher up in the text.  Whether the earlier one goes itself plays no part.  Rows that
    repeat a document are one document; a null text stays null.  Columns named n_lines or n_removed
    are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs, min_chars).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    found = docs.withColumn("_text_hash", F.xxhash64(whole_text())).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    cut = (found.withColumn("_lines", F.split(whole_text(), "\n")).withColumn("_gone", F.coalesce("gone", F.array().cast("array<int>")))
           .withColumn("_ends", F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_lines")))))
    runs = F.transform(F.sequence(F.lit(0), F.size("_ends") - 2), lambda k: F.slice(
        "_lines", F.get("_ends", k) + 2, F.get("_ends", k + 1) - F.get("_ends", k) - 1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    counted = F.size(F.filter("_lines", lambda x: x.rlike(HAS_WORD))).cast("long")
    return cut.select(*[kept.alias(c) if c == "text" else c for c in own], counted.alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
