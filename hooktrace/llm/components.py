"""Connected components by alternating large and small stars, written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hooktrace.sinks.shared import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph with columns a and b.

    The root is the smallest node reachable, itself included. Self loops and repeated edges do no
    harm; rows with a null end are ignored; a graph without edges has no rows. The number of
    rounds grows with the logarithm of the longest path. Only edges are moved, never gathered in
    one place; every round is read back from the shared folder, so a lost executor costs one round.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b")
    # Stored as (larger, smaller).
    stars = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = _state(stars)
    while state[0]:
        # Large star: larger neighbours of a node go to the smallest among it and its neighbours.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = staged(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, state = state, _state(stars)
        if before == state:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
