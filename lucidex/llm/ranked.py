"""Ranked lexical search with the Best Position Algorithm.

The texts are read once into segments: what a task read, as postings of the terms that some query asks
for.  A segment keeps a list of each term, highest impact first.  For a query, positions at the front of
its lists are read; each document met is looked up in all the other lists at once (direct access), which
marks positions there as seen too.  A list's best position is the end of its seen positions without a gap,
so the sum of the impacts at the best positions bounds what an unseen document can score.  Reading stops
when that bound is strictly below the score of the kth document, so ties are never lost.

A task keeps the best documents of each query over all its segments, and a segment whose first positions
can't reach the kth score isn't read.  Nothing is shuffled but the best documents of each task.

Queries are taken in blocks of bounded size, whose terms and weights go with the tasks.  Defined results:
a null or empty text has no term and is never found; a query without terms has no rows; rows that share a
doc_id are documents of their own; query rows that share an item_id are one query, repeated rows counted
once; a null doc_id comes after the others in a tie.  Columns other than those named aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.llm.common import ascii_lower, release, saved, whole_text
from lucidex.operators.skew import top_per_group

#: A term is a run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Characters of query texts in a block, which bounds its terms and weights.
BLOCK_CHARS = 16 << 20

#: Postings after which a segment is closed.
SEGMENT_POSTINGS = 1 << 20

#: Positions of each list that the first round reads; each further round reads twice as many.
FIRST_STEP = 16

SEGMENT = ("ids array<long>, lengths array<long>, docs binary, terms binary, times binary, "
           "n_docs long, n_terms long, present array<int>, df array<long>")


def terms_of(text: Column) -> Column:
    """Terms in order, repeats included; only A-Z are lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _close(parts: list[tuple[np.ndarray, ...]], ids: list[pa.Array], size: int) -> pa.RecordBatch:
    """Parts: lengths of all documents, then document, term and times of each posting."""
    lengths, docs, terms, times = (np.concatenate(column) for column in zip(*parts))
    df = np.bincount(terms, minlength=size)
    present = np.flatnonzero(df)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)), one(lengths, pa.int64()),
        pa.array([docs.astype("<i4").tobytes()]), pa.array([terms.astype("<i4").tobytes()]), pa.array([times.astype("<i8").tobytes()]),
        pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
        one(present, pa.int32()), one(df[present], pa.int64())],
        ["ids", "lengths", "docs", "terms", "times", "n_docs", "n_terms", "present", "df"])


def segments(docs: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """The postings of *terms* in all documents (doc_id, text), one row per segment."""
    limit = limit or SEGMENT_POSTINGS
    wanted = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, held, first = [], [], 0, 0
        for batch in batches:
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy()
            number = pc.index_in(lists.values.slice(offsets[0], offsets[-1] - offsets[0]), value_set=wanted)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)[known]
            pair, times = np.unique(doc * len(terms) + number.drop_null().to_numpy(), return_counts=True)
            parts.append((lengths, first + pair // max(len(terms), 1), pair % max(len(terms), 1), times))
            # A copy: a slice would hold the batch's terms too.
            ids.append(batch.column("doc_id").take(pa.array(np.arange(batch.num_rows))))
            held += len(pair)
            first += batch.num_rows
            if held >= limit:
                yield _close(parts, ids, len(terms))
                parts, ids, held, first = [], [], 0, 0
        if parts:
            yield _close(parts, ids, len(terms))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms_of(whole_text()).alias("terms")).mapInArrow(run, SEGMENT)


@dataclass
class Lists:
    """Impact lists of a segment: postings by term and document, and where each stands in its term's list."""

    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    place: np.ndarray
    by_impact: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int) -> Lists:
        by_doc = np.lexsort((docs, terms))
        docs, terms, impacts = docs[by_doc], terms[by_doc], impacts[by_doc]
        starts = np.searchsorted(terms, np.arange(size + 1))
        by_impact = np.lexsort((docs, -impacts, terms))
        place = np.empty(len(docs), np.int64)
        place[by_impact] = np.arange(len(docs))
        return cls(starts, docs, impacts, place, by_impact)


def best_positions(lists: Lists, terms: np.ndarray, repeats: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the segment that can be among the best *k*, with their whole scores.

    *floor* is a score that *k* documents elsewhere reach already (0: none); what is below it may be left out.
    """
    spans = [(int(lists.starts[t]), int(lists.starts[t + 1]), int(r)) for t, r in zip(terms, repeats)]
    spans = [s for s in spans if s[0] < s[1]]
    seen = [np.zeros(b - a, bool) for a, b, _ in spans]
    best = [0] * len(spans)
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step, kth = FIRST_STEP, floor

    def bound() -> int:
        """What a document can score that stands behind all best positions; before any is read, behind none."""
        return sum(r * int(lists.impacts[lists.by_impact[a + max(p - 1, 0)]]) for (a, b, r), p in zip(spans, best) if p < b - a)

    while (most := bound()) > 0 and most >= kth:
        fresh = [lists.docs[lists.by_impact[a + p:min(a + p + step, b)][~done[p:p + step]]]
                 for (a, b, _), p, done in zip(spans, best, seen)]
        new = np.unique(np.concatenate(fresh))
        total = np.zeros(len(new), np.int64)
        for i, (a, b, r) in enumerate(spans):
            own = lists.docs[a:b]
            at = np.searchsorted(own, new)
            hit = at < len(own)
            hit[hit] = own[at[hit]] == new[hit]
            total[hit] += r * lists.impacts[a + at[hit]]
            seen[i][lists.place[a + at[hit]] - a] = True
            gap = np.flatnonzero(~seen[i][best[i]:])
            best[i] = best[i] + int(gap[0]) if len(gap) else b - a
        found, scores = np.concatenate([found, new]), np.concatenate([scores, total])
        if len(scores) >= k:
            kth = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        step *= 2
    return found, scores


def search_segments(parts: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray,
                    n: int, total: int, k: int) -> DataFrame:
    """The best documents of each task for each item (item_id, terms, repeats): item_id, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]  # id, id is null, score
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                lengths = batch.column("lengths")[row].values.to_numpy()
                docs, terms, times = (np.frombuffer(batch.column(c)[row].as_py(), kind)
                                      for c, kind in (("docs", "<i4"), ("terms", "<i4"), ("times", "<i8")))
                m = 25 + (75 * lengths * n) // total if total else lengths
                impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs]))
                lists = Lists.of(docs, terms, impacts, len(weights))
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                for i, (_, wanted, repeats) in enumerate(items):
                    old_ids, old_null, old_scores = kept[i]
                    floor = int(old_scores[-1]) if len(old_scores) == k else 0
                    found, scores = best_positions(lists, wanted, repeats, floor, k)
                    keep = scores >= max(floor, 1)
                    found = found[keep]
                    merged = (np.concatenate([old_ids, ids[found]]), np.concatenate([old_null, null[found]]),
                              np.concatenate([old_scores, scores[keep]]))
                    order = np.lexsort((merged[0], merged[1], -merged[2]))[:k]
                    kept[i] = tuple(column[order] for column in merged)
        sizes = [len(one[2]) for one in kept]
        if sum(sizes):
            ids, null, scores = (np.concatenate(column) for column in zip(*kept))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(items)), sizes), pa.int32()), pa.array(ids, pa.int64(), mask=null),
                pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return parts.select("ids", "lengths", "docs", "terms", "times").mapInArrow(run, "item int, doc_id long, score long")


def _search_block(spark: SparkSession, docs: DataFrame, asked: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """The best *k* documents of each of a block's queries (item_id, terms with repeats)."""
    names = sorted({term for _, terms in asked for term in terms})
    number = {term: i for i, term in enumerate(names)}
    items = []
    for item_id, terms in asked:
        wanted, repeats = np.unique([number[t] for t in terms], return_counts=True)
        items.append((item_id, wanted.astype(np.int64), repeats))
    parts = saved(segments(docs, names), "ranked-segments")
    n, total = parts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # As many rows as the block has terms.
    pairs = parts.select(F.explode(F.arrays_zip("present", "df")).alias("p")).groupBy("p.present").agg(F.sum("p.df").alias("df"))
    weights = np.zeros(len(names), np.int64)
    for term, df in pairs.collect():
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    tops = saved(search_segments(parts, items, weights, n, total, k), "ranked-tops")
    release(parts)
    ranked = top_per_group(tops, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, ["doc_id", "score"])
    ids = spark.createDataFrame([(i, item[0]) for i, item in enumerate(items)], "item int, item_id long")
    return ranked.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_chars: int | None = None) -> DataFrame:
    """The *k* best documents (doc_id, text) of each query (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = (queries.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).distinct()
             .groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("text")), terms_of)).alias("terms"),
                                     F.sum(F.length("text")).alias("chars"))
             .filter(F.size("terms") > 0))
    chars = asked.agg(F.sum("chars")).first()[0] or 0
    blocks = -(-chars // (block_chars or BLOCK_CHARS))
    out = None
    for block in range(blocks):
        # At most about BLOCK_CHARS of text, by construction.
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "terms")
        rows = [(r["item_id"], list(r["terms"])) for r in own.collect()]
        if rows:
            found = _search_block(spark, docs, rows, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
