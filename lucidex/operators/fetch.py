"""Fetching a few wide rows by key without moving the others.

The keys are a written, narrow table, so their number is known.  Few of them are broadcast and the wide rows
never move.  More of them become a Bloom filter: an aggregate of fixed size that is tested right above the
scan, so that only rows that are asked for (and about one in a hundred others) take part in the join, which
is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that are broadcast: at some 100 bytes each, 20 MB.
BROADCAST_KEYS = 200_000

#: Bits of a filter for each key, and at most (4 MB); beyond that more rows pass, none is lost.
BITS_PER_KEY, MOST_BITS = 10, 1 << 25

#: Hash functions of the filter.
PROBES = 7


def bloom_size(keys: int) -> int:
    """Bits for so many keys: a power of two, 1,024 at least."""
    return min(MOST_BITS, max(1024, 1 << max(BITS_PER_KEY * keys - 1, 1).bit_length()))


def _position(on: Sequence[str], probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), *on), F.lit(bits))


def bloom_filter(keys: DataFrame, on: Sequence[str], bits: int) -> DataFrame:
    """One row ``words``: the filter of the keys as 64-bit words.

    Bits are combined on the map side, so what meets is one row per word and task.
    """
    spots = keys.select(F.explode(F.array(*[_position(on, p, bits) for p in range(PROBES)])).alias("spot"))
    told = spots.selectExpr("cast(shiftright(spot, 6) AS int) AS word", "shiftleft(1L, cast(spot & 63 AS int)) AS bit")
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    merged = told.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("words"))


def may_contain(words: Column, on: Sequence[str], bits: int) -> Column:
    """False for rows whose key is surely not in the filter."""
    tests = []
    for probe in range(PROBES):
        spot = _position(on, probe, bits)
        tests.append(F.getbit(F.get(words, F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(63).cast("int")) == 1)
    test = tests[0]
    for other in tests[1:]:
        test = test & other
    return test


def fetch_rows(rows: DataFrame, keys: DataFrame, on: Sequence[str], broadcast_keys: int | None = None) -> DataFrame:
    """The rows with a key of *keys*, with its other columns; *keys* is a written table with unique keys.

    Null keys match nothing.  No row of another key is in an exchange but those that pass the filter by chance.
    """
    on = list(on)
    known = keys.count()
    if known <= (BROADCAST_KEYS if broadcast_keys is None else broadcast_keys):
        return rows.join(F.broadcast(keys), on)
    bits = bloom_size(known)
    passing = rows.filter(may_contain(bloom_filter(keys, on, bits).scalar(), on, bits))
    return passing.join(keys, on)
