"""Near-duplicates by shared word shingles, for what SimHash alone doesn't reach.

Texts that share four fifths of their five-word shingles differ in about ten of 64 SimHash bits, far beyond any
radius that masks can cover.  So rows that SimHash has grouped already are compared once more: least hashes
of their shingles under some permutations go in bands, rows that share a band are candidates, and a
candidate is linked if the shingle sets themselves agree.

In a bucket rows meet leaders and not each other.  A leader is the row of a group that shares most buckets with
most others, as the text does that copies were made from.  Groups that are near are merged after each round; a
group that had a leader in a bucket has no other there, and twice as many groups lead in the next round, until
all groups of a bucket have led or are one.  Copies of a text, however many, so take one round.  Pairs are
judged by their least hashes first, and only those that come near by these are compared by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lucidex.llm.chat import meet
from lucidex.llm.common import give_back, release, saved
from lucidex.llm.graph import components
from lucidex.llm.simhash import shingle_hashes
from lucidex.operators.fetch import fetch_rows

SHINGLE_WORDS = 5
LIKENESS = 0.8

#: Bands of least hashes: at a likeness of 0.8 a pair shares none with a chance of (1 - 0.8^5)^16, about 0.002.
BANDS, ROWS = 16, 5

#: By how much the share of equal least hashes may fall short of the threshold: over four standard deviations.
SLACK = 0.2

#: Bytes of an Arrow batch of shingle hashes.
BATCH_BYTES = 4 << 20

_U = np.uint64


def _least(hashes: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
    """The least of each run of hashes under one permutation."""
    x = hashes * _U((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * which | 1) & (1 << 64) - 1)
    x ^= x >> _U(31)
    x *= _U(0xBF58476D1CE4E5B9)
    return np.minimum.reduceat(x, starts)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy()
        hashes = lists.values.to_numpy()[offsets[0]:offsets[-1]].view(_U)
        lengths = np.diff(offsets)
        filled = lengths > 0
        starts = (offsets[:-1] - offsets[0])[filled]
        keys = np.zeros((int(filled.sum()), BANDS), _U)
        marks = np.zeros((len(keys), BANDS * ROWS), np.int32)
        for which in range(BANDS * ROWS if len(starts) else 0):
            least = _least(hashes, starts, which)
            keys[:, which // ROWS] = (keys[:, which // ROWS] ^ least) * _U(0x94D049BB133111EB)
            marks[:, which] = (which << 8) | (least & _U(255)).astype(np.int32)

        def lists_of(values: np.ndarray, width: int) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(filled, width, 0))]), pa.int32()), pa.array(values.ravel()))

        others = [c for c in batch.schema.names if c != "hashes"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], lists_of(keys.view(np.int64), BANDS), lists_of(marks, BANDS * ROWS)],
                                         [*others, "bands", "marks"])
    give_back()


def bands(docs: DataFrame, key: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """key, the band keys and the low bytes of the least hashes (with their place) of each text; without words there are none."""
    kind = docs.schema[key].dataType.simpleString()
    return shingle_hashes(docs, [key], shingle).mapInArrow(_bands, f"`{key}` {kind}, bands array<long>, marks array<int>")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct shingle hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _sets(texts: DataFrame, rows: DataFrame, key: str, shingle: int) -> DataFrame:
    """row and ``own``, the distinct shingles of the texts of *rows* (row), which alone are read and moved."""
    hashes = shingle_hashes(fetch_rows(texts.select(key, "text"), rows.withColumnRenamed("row", key), [key]), [key], shingle)
    own = F.array_distinct(F.transform("hashes", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    return saved(hashes.select(F.col(key).alias("row"), own.alias("own")).dropDuplicates(["row"]), "near-sets")


def _near(pairs: DataFrame, marks: DataFrame, texts: DataFrame, key: str, shingle: int, threshold: float, sets: DataFrame | None = None) -> DataFrame:
    """Those pairs (low, high) whose shingle sets agree; without *sets* they are made for the rows of pairs that may be.

    *pairs* and what comes of them are written tables, so that counting them makes no join.
    """

    def both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        one = lambda side, name: table.select(F.col("row").alias(side), F.col(value).alias(name))
        total = pairs.count()  # as many after the first join
        return meet(meet(pairs, one("low", "_a"), ["low"], total=total), one("high", "_b"), ["high"], total=total)

    share = F.size(F.array_intersect("_a", "_b")) / (BANDS * ROWS)
    likely = saved(both(pairs, marks, "marks").filter(share >= threshold - SLACK).select("low", "high").distinct(), "near-likely")
    rows = saved(likely.select(F.col("low").alias("row")).unionByName(likely.select(F.col("high").alias("row"))).distinct(), "near-rows")
    own = _sets(texts, rows, key, shingle) if sets is None else sets
    near = saved(both(likely, own, "own").filter(likeness(F.col("_a"), F.col("_b")) >= threshold).select("low", "high"), "near-pairs")
    release(likely, rows, *([own] if sets is None else []))
    return near


def rarest(sets: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """row, size, token and heads of the rarest shingles of each set (row, own).

    Of two sets with a likeness of *threshold* or more, one of the first ``size - 2t/(1+t) size + 1`` shingles of the
    smaller (``heads``) is among the first ``size - t size + 1`` of the greater, in whatever common order.
    """
    tokens = sets.select("row", F.size("own").alias("size"), F.explode("own").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    known = tokens.join(counts, "token", "left").withColumn("_df", F.coalesce("_df", F.lit(1)))
    # Shingles of one set only come first and meet nothing: their number tells where the others stand.
    ordered = known.groupBy("row", "size").agg(F.count_if(F.col("_df") == 1).alias("_alone"),
                                               F.array_sort(F.collect_list(F.when(F.col("_df") > 1, F.struct("_df", "token")))).alias("_shared"))
    kept = lambda share: (F.col("size") - F.ceil(F.col("size") * F.lit(share) - F.lit(1e-6)) + 1 - F.col("_alone")).cast("int")
    taken = ordered.withColumn("_head", kept(2 * threshold / (1 + threshold))).withColumn("_shared", F.slice("_shared", 1, F.greatest(kept(threshold), F.lit(0))))
    return taken.select("row", "size", "_head", F.posexplode("_shared").alias("_at", "_s")).select(
        "row", "size", F.col("_s.token").alias("token"), (F.col("_at") < F.col("_head")).alias("heads"))


def regrouped(placed: DataFrame, texts: DataFrame, key: str, shingle: int = SHINGLE_WORDS, threshold: float = LIKENESS) -> DataFrame:
    """key and ``_group`` of every row, groups of *placed* (key, _group) merged where rows of them are near.

    *placed* has each key once, and ``print``, which rows share only if their texts are alike.  *texts* has the key, not null, and text; rows that share a key are equal.  Empty tables and texts without words merge nothing.
    """
    sketches = saved(bands(texts, key, shingle).join(placed.select(key, "_group", "print"), key).withColumnRenamed(key, "row"), "near-sketches", BATCH_BYTES)
    marks = sketches.select("row", "marks")
    # Of equal fingerprints one row is sent to a bucket.  Others of its group are sent too: the text that copies were made from is one of them.
    sent = saved(sketches.select("row", "_group", "print", F.posexplode("bands").alias("band", "bits")).groupBy("band", "bits", "_group", "print")
                 .agg(F.min("row").alias("row")).drop("print"), "near-bands")
    bucket = ["band", "bits"]
    groups = (F.min("_group").alias("_low"), F.max("_group").alias("_high"))
    shared = sent.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), *groups).filter("_low <> _high").drop("_low", "_high")
    counted = sent.join(shared, bucket)
    # Of near copies the one that they were made from shares most buckets with most of them.
    degree = counted.groupBy("row").agg(F.sum("_n").alias("degree"))
    open_ = saved(counted.drop("_n").join(degree, "row").withColumns({"led": F.lit(False), "covered": F.lit(False), "heads": F.lit(True), "size": F.lit(1)}), "near-open")
    release(sent)
    links, leaders, sets = [], 1, None
    while not open_.isEmpty():
        order = [F.desc("degree"), F.asc("row")]
        waiting = open_.filter("heads AND NOT covered").withColumn("_own", F.row_number().over(Window.partitionBy(*bucket, "_group").orderBy(*order))).filter("_own = 1")
        first = saved(waiting.withColumn("_at", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).filter(F.col("_at") <= leaders)
                      .select(*bucket, "row", "_group", "size"), "near-leaders")
        told = first.groupBy(*bucket).agg(F.collect_list(F.struct(F.col("row").alias("leader"), F.col("_group").alias("of_leader"), F.col("size").alias("of_size"))).alias("_leaders"))
        fitting = F.least("size", "of_size") >= F.greatest("size", "of_size") * F.lit(threshold - 1e-6)
        met = (meet(open_.select("row", "_group", "size", *bucket), told, bucket).select("row", "_group", "size", F.inline("_leaders"))
               .filter("_group <> of_leader").filter(fitting)
               .select(F.least("row", "leader").alias("low"), F.greatest("row", "leader").alias("high"),
                       F.least("_group", "of_leader").alias("a"), F.greatest("_group", "of_leader").alias("b")).distinct())
        met = saved(met, "near-met")
        near = _near(met.select("low", "high"), marks, texts, key, shingle, threshold, sets)  # a row is in one group, so pairs come once
        # Groups have the names that the rounds before gave them, so the links of this round are all that changes them.
        links.append(saved(met.join(near, ["low", "high"], "left_semi").select("a", "b").distinct(), "near-links"))
        whole = components(links[-1])
        led = open_.join(first.select(*bucket, "row", F.lit(True).alias("_now")), [*bucket, "row"], "left").withColumn("led", F.col("led") | F.coalesce("_now", F.lit(False))).drop("_now")
        named = led.join(whole, led["_group"] == whole["node"], "left").withColumn("_group", F.coalesce("component", "_group")).drop("node", "component")
        done = saved(named.withColumn("covered", F.max("led").over(Window.partitionBy(*bucket, "_group"))), "near-done")
        alive = done.groupBy(*bucket).agg(F.bool_and(~F.col("heads") | F.col("covered")).alias("_all"), *groups).filter("NOT _all AND _low <> _high")
        before, open_ = open_, saved(done.join(alive.select(*bucket), bucket, "left_semi"), "near-open")
        release(before, met, near, first, done)
        leaders *= 2
        if sets is None and not open_.isEmpty():
            left = saved(open_.groupBy("row").agg(F.min("_group").alias("_group"), F.max("degree").alias("degree")), "near-left")
            sets = _sets(texts, left.select("row"), key, shingle)
            parts = saved(left.join(rarest(sets, threshold), "row"), "near-parts")
            bucket, leaders = ["token"], 1
            met_by = parts.groupBy(*bucket).agg(F.bool_or("heads").alias("_heads"), *groups).filter("_heads AND _low <> _high").select(*bucket)
            before, open_ = open_, saved(parts.join(met_by, bucket).withColumns({"led": F.lit(False), "covered": F.lit(False)}), "near-open")
            release(before, left, parts)
    release(sketches, open_, *([sets] if sets is not None else []))
    if not links:
        return placed.select(key, "_group")
    whole = components(reduce(DataFrame.unionByName, links))
    return placed.join(whole, placed["_group"] == whole["node"], "left").select(key, F.coalesce("component", "_group").alias("_group"))
