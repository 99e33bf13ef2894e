"""SimHash near-duplicates through covering locality-sensitive hashing.

Bit positions get vectors of r + 1 bits.  Table v (any such vector but zero) keeps the positions
whose vector has an odd product with v.  The vectors of r differing positions never span all of the
space, so some v is orthogonal to them all: in that table the two fingerprints agree.  No pair within
the radius is missed, whichever bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.common import ascii_lower, saved, whole_text, words_of
from lucidex.llm.graph import components

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4

#: Shingle hashes whose bits are unfolded at a time.
SLICE = 1 << 17
#: Fingerprints of one bucket compared in one task; greater buckets go in pairs of pieces of this size.
BUCKET = 4096
#: Up to this many all pairs of a bucket are tried at once.
SMALL = 12


def shingle_hashes(docs: DataFrame, keys: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """keys and the XXH64 (seed 42) of every word shingle, repeats included, as signed longs.

    Fewer words than a shingle make one shingle; no word makes none.
    """
    split = docs.select(*keys, words_of(ascii_lower(whole_text())).alias("_words"))
    words = F.col("_words")
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - (shingle - 1)), lambda i: F.xxhash64(
        F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(shingle)])))
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    return split.select(*keys, F.when(F.size(words) >= shingle, whole).when(F.size(words) > 0, short)
                        .otherwise(F.array().cast("array<long>")).alias("hashes"))


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per list of hashes the 64-bit number whose bits are set in over half of them."""
    out = np.zeros(len(lengths), np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    sums = np.zeros((len(lengths), BITS), np.int64)
    for begin in range(0, len(hashes), SLICE):
        end = min(begin + SLICE, len(hashes))
        bits = np.unpackbits(hashes[begin:end].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = int(np.searchsorted(starts, begin, "right")) - 1
        last = int(np.searchsorted(starts, end, "left"))
        own = np.arange(first, last)[lengths[first:last] > 0]
        cuts = np.maximum(starts[own] - begin, 0)
        sums[own] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    set_bits = sums * 2 > lengths[:, None]
    out[:] = np.packbits(set_bits, axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64)
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
        prints = majority_bits(flat, np.diff(offsets).astype(np.int64)).view(np.int64)
        keys = batch.drop_columns(["hashes"])
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(prints)], [*keys.schema.names, "print"])


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """keys and ``print``, the 64-bit SimHash as a signed long; no word: zero."""
    types = {f.name: f.dataType.simpleString() for f in docs.select(*keys).schema}
    spec = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["print long"])
    return shingle_hashes(docs, keys, shingle).mapInArrow(_prints, spec)


def cover_masks(radius: int) -> list[int]:
    """One mask per table as a signed long; each keeps about half of the bits."""
    space = 1 << (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, space)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def spanning_links(prints: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever the radius connects: at most one less than fingerprints."""
    left, a, b = prints.copy(), [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            found = np.full(len(left), -1)
            for begin in range(0, len(frontier), 128):
                open_ = np.flatnonzero(found < 0)
                near = _near(frontier[begin:begin + 128, None], left[None, open_], radius)
                hit = near.any(axis=0)
                found[open_[hit]] = begin + near.argmax(axis=0)[hit]
            new = found >= 0
            a.append(frontier[found[new]])
            b.append(left[new])
            frontier, left = left[new], left[~new]
    return a, b


def _link(radius: int):
    spec = "a long, b long, bucket int, bits long, piece int"

    def links(a, b):
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        empty = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), empty, pa.nulls(len(a), pa.int64()), empty],
                                          ["a", "b", "bucket", "bits", "piece"])

    def piece(bucket, bits, number, prints):
        n = len(prints)
        return pa.RecordBatch.from_arrays(
            [pa.array(prints.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, bucket, np.int32)),
             pa.array(np.full(n, bits, np.int64)), pa.array(np.full(n, number, np.int32))], ["a", "b", "bucket", "bits", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket.  A bucket's rows are held up to a bound; a greater bucket's are passed on in pieces."""
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        numbered = 0  # pieces of the bucket that is open
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
                held = [np.concatenate(pair) for pair in zip(held, new)]
            size = len(held[0])
            if not size:
                continue
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [size]])
            whole = len(starts) if batch is None else len(starts) - 1
            a, b = [], []
            lengths = ends[:whole] - starts[:whole]
            if whole and numbered:
                yield piece(held[0][0], held[1][0], numbered, held[2][:ends[0]])
                numbered = 0
                lengths = lengths.copy()
                lengths[0] = 0
            small = (lengths > 1) & (lengths <= SMALL)
            rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[:whole][small], ends[:whole][small])] or [np.zeros(0, np.int64)]).astype(np.int64)
            run_of = np.repeat(np.flatnonzero(small), lengths[small])
            for step in range(1, SMALL):
                if len(rows) <= step:
                    break
                near = (run_of[step:] == run_of[:-step]) & _near(held[2][rows[step:]], held[2][rows[:-step]], radius)
                a.append(held[2][rows[:-step][near]])
                b.append(held[2][rows[step:][near]])
            for at in np.flatnonzero(lengths > SMALL):
                prints = held[2][starts[at]:ends[at]]
                if len(prints) <= BUCKET:
                    one, two = spanning_links(prints, radius)
                    a += one
                    b += two
                else:
                    for number, begin in enumerate(range(0, len(prints), BUCKET)):
                        yield piece(held[0][starts[at]], held[1][starts[at]], number, prints[begin:begin + BUCKET])
            if a:
                yield links(a, b)
            rest = starts[whole] if whole < len(starts) else size
            held = [x[rest:] for x in held]
            while len(held[0]) > 2 * BUCKET:
                yield piece(held[0][0], held[1][0], numbered, held[2][:BUCKET])
                numbered += 1
                held = [x[BUCKET:] for x in held]

    return run, spec


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between fingerprints that connect whatever pairs within the radius connect.

    Each distinct fingerprint goes once to every table.  A bucket yields spanning links, not all of
    its pairs.  A bucket of any size is compared in full: beyond a bound in pairs of pieces, which
    are spread over tasks.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("bucket"), F.col("print").bitwiseAND(F.lit(m)).alias("bits"))
                       for i, m in enumerate(cover_masks(radius))])
    keyed = (prints.select("print").distinct().select(F.explode(tables).alias("_t"), "print")
             .select("_t.bucket", "_t.bits", "print").repartition("bucket", "bits")
             .sortWithinPartitions("bucket", "bits"))
    run, spec = _link(radius)
    found = saved(keyed.mapInArrow(run, spec), "simhash-links")
    pieces = found.filter("piece IS NOT NULL")
    most = pieces.groupBy("bucket", "bits").agg(F.max("piece").alias("_last"))
    other = F.explode(F.sequence(F.lit(0), F.col("_last")))
    paired = (pieces.join(most, ["bucket", "bits"]).select("bucket", "bits", "piece", F.col("a").alias("print"), other.alias("_other"))
              .filter("piece <> _other")
              .withColumns({"_low": F.least("piece", "_other"), "_high": F.greatest("piece", "_other")}))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(group["print"].to_numpy().view(np.uint64), radius)
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pd.DataFrame({"a": a, "b": b})

    rest = paired.groupBy("bucket", "bits", "_low", "_high").applyInPandas(compare, "a long, b long")
    return found.filter("piece IS NULL").select("a", "b").unionByName(rest)


def grouped(docs: DataFrame, keys: list[str], radius: int = RADIUS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """keys, print and _group (a fingerprint of the group) of every row; a written table.

    A null text has no words, so it is linked to all others without words.  Only narrow rows move;
    links stay distributed.
    """
    prints = saved(fingerprints(docs, keys, shingle), "simhash-prints")
    groups = components(links(prints, radius))
    return saved(prints.join(groups, prints["print"] == groups["node"], "left")
                 .select(*keys, "print", F.coalesce("component", "print").alias("_group")), "simhash-groups")


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id that links reach, itself included.

    Rows that repeat a doc_id are each kept.
    """
    placed = grouped(docs, ["doc_id"], radius, shingle)
    least = placed.groupBy("_group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "_group").select("doc_id", "print", "component_id")
