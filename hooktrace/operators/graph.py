"""Connected components of large graphs by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hooktrace.operators.skew import ROWS_PER_SLICE, balanced_left_join
from hooktrace.sinks.shared import staged


def connected_components(edges: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(node, root) of every node that an edge names; edges are undirected, in columns a and b.

    The root is the smallest node that can be reached, itself included. Loops and repeated edges
    change nothing; an edge with a null end joins nothing, but its other end is a node.

    Every round ties the larger neighbours of each node to the smallest of its neighbourhood, and
    then its smaller ones. Edges never grow in number, and the rounds grow with the logarithm of
    the longest path. The minimum is formed before the shuffle, and the edges of a hub are cut
    into slices of about ``rows_per_slice`` where they learn it, so no task holds all of them.
    Every round is read back from the shared folder: a lost executor costs one round at most.
    """
    ends = F.explode(F.array("a", "b")).alias("node")
    nodes = staged(edges.select(ends).where("node is not null").distinct(), "nodes")
    tied = edges.where("a is not null and b is not null and a <> b")
    tied = staged(tied.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(tied)
    while state[0]:
        both = tied.unionByName(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        larger = balanced_left_join(both.where("b > a"), least, "a", F.col("b"), rows_per_slice=rows_per_slice)
        # Larger first: a tied node is larger than what it is tied to.
        large = larger.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        rest = balanced_left_join(large, least, "a", F.col("b"), rows_per_slice=rows_per_slice)
        moved = rest.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        tied = staged(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "edges")
        before, state = state, _state(tied)
        if before == state:
            break
    roots = tied.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed % 1_000_003), F.bit_xor(mixed)).first())
