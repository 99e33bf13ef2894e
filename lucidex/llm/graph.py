"""Connected components of links that do not fit in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lucidex.llm.common import release, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least"))
    # Each edge gives one row, so the rows don't grow; equal ones go after the small star.
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether a node with a smaller neighbour has no other; distinct edges have a > b."""
    ends = (edges.select(F.col("a").alias("node"), F.lit(1).alias("below"))
            .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"))))
    known = ends.groupBy("node").agg(F.sum("below").alias("_n"), F.min("below").alias("_least"))
    longer = (F.col("_n") > 1) | (F.col("_n") == 1) & (F.col("_least") == 0)
    return not known.agg(F.bool_or(longer)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (a, b); the component is its smallest node.

    Alternating stars: each round is joins and minima by node, written before the next, and no node's
    neighbours are ever collected.  The number of rounds grows with the logarithm of a component's
    length, and edges that are stars already take none.  Loops are ignored.
    """
    current = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(current):
        before, current = current, saved(_small_star(_large_star(current)), "links")
        release(before)
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
