"""Exact top-k inner products, pruned by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hooktrace.sinks.shared import staged

LEVELS = (1, 4, 16)
GROUP_ROWS = 16_384
QUERY_ROWS = 256


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component as bigint; null where the vector cannot take part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * F.lit(factor))))


class SegmentStats:
    """Segment means and deviations of a block of vectors, coarse to fine.

    For one segment of n components, the squared distance of two vectors is at least
    n * ((mean - mean')^2 + (deviation - deviation')^2). As the squared lengths are known
    exactly, a lower bound on the distance is an upper bound on the inner product:
    q.c = (|q|^2 + |c|^2 - distance^2) / 2.
    """

    def __init__(self, vectors: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.exact = vectors
        values = vectors.astype(np.float64)
        self.square = (values * values).sum(axis=1)
        self.levels = []
        dims = vectors.shape[1]
        for segments in sorted({min(s, dims) for s in levels if dims}):
            cuts = np.linspace(0, dims, segments + 1).astype(int)
            size = np.diff(cuts).astype(np.float64)
            mean = np.add.reduceat(values, cuts[:-1], axis=1) / size
            power = np.add.reduceat(values * values, cuts[:-1], axis=1) / size
            deviation = np.sqrt(np.maximum(power - mean * mean, 0.0))
            # Weighted by the root of the segment size, so that distances are plain ones.
            self.levels.append(np.hstack([mean * np.sqrt(size), deviation * np.sqrt(size)]))

    def distance_bound(self, level: int, query: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Lower bounds on squared distances to one query, from one level."""
        gap = self.levels[level][rows] - query
        return np.einsum("ij,ij->i", gap, gap)


def _best(block: SegmentStats, ids: np.ndarray, queries: SegmentStats, query_ids: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best of a block for every query, as (query_id, vec_id, score)."""
    everything = np.arange(len(ids))
    # Rounding may move a bound by a little; the slack keeps every true candidate.
    slack = 1e-9 * (1.0 + block.square.max(initial=0.0) + queries.square.max(initial=0.0))
    for q, query_id in enumerate(query_ids):
        target = queries.exact[q]
        alive = everything[ids != query_id]
        floor = -np.inf
        for level in range(len(block.levels)):
            if len(alive) <= k:
                break
            bound = block.distance_bound(level, queries.levels[level][q], alive)
            upper = (queries.square[q] + block.square[alive] - bound) / 2 + slack
            # The exact scores of the k most promising rows are a floor for the k-th best.
            first = alive[np.argpartition(-upper, k - 1)[:k]]
            floor = max(floor, float(np.min(block.exact[first] @ target)))
            alive = alive[upper >= floor]
        scores = block.exact[alive] @ target
        order = np.lexsort((ids[alive], -scores))[:k]
        for i in order:
            yield int(query_id), int(ids[alive[i]]), int(scores[i])


def _search_group(k: int, levels: tuple[int, ...]):
    """Search one partition: per group, first its vectors, then the queries as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ids, vectors, block = None, [], [], None
        for frame in batches:
            out = []
            for (key, is_query), part in frame.groupby(["group", "is_query"], sort=True):
                if key != group:
                    group, ids, vectors, block = key, [], [], None
                matrix = np.stack(part["vector"].to_numpy()).astype(np.int64)
                if not is_query:
                    ids.append(part["id"].to_numpy())
                    vectors.append(matrix)
                    continue
                if not ids:
                    continue
                if block is None:
                    block = SegmentStats(np.concatenate(vectors), levels)
                    known = np.concatenate(ids)
                for at in range(0, len(part), QUERY_ROWS):
                    piece = SegmentStats(matrix[at : at + QUERY_ROWS], levels)
                    out.extend(_best(block, known, piece, part["id"].to_numpy()[at : at + QUERY_ROWS], k))
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    levels: tuple[int, ...] = LEVELS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The k highest integer inner products of every query with all vectors but those of its id.

    ``vectors`` and ``queries`` hold an id and an array<bigint>. Vectors are dealt into groups of
    about ``group_rows`` by a hash; every group meets the queries as a stream of batches, keeps the
    statistics of its own vectors only, drops vectors whose bound is below the k-th best score,
    level by level, and scores the rest exactly. The k best of each group are merged per query.
    So a task holds one group whatever the input's size, and the rows made are queries x groups x k.

    Rows with a null id or vector take no part. Only vectors of the same number of components
    meet. Repeated rows count once each; a query meets no row of its own id. Equal scores go
    to the smaller id. A query without any candidate has no row. Other columns are ignored.
    Components must be small enough for scores to fit in 64 bits.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"))
    known = known.where("id is not null and vector is not null")
    asked = queries.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"))
    asked = asked.where("id is not null and vector is not null").distinct()
    # Group counts per dimension: a small table, one row for each length of vector.
    sizes = known.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("dims", F.ceil(F.col("rows") / group_rows).cast("int").alias("groups"))
    sizes = staged(sizes, "topk-sizes")
    known = known.withColumn("dims", F.size("vector")).join(sizes, "dims")
    known = known.select("dims", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"), F.lit(0).alias("is_query"), "id", "vector")
    asked = asked.withColumn("dims", F.size("vector")).join(sizes, "dims")
    asked = asked.select("dims", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(1).alias("is_query"), "id", "vector")
    both = known.unionByName(asked).select(F.concat_ws("/", "dims", "part").alias("group"), "is_query", "id", "vector")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(width, "group").sortWithinPartitions("group", "is_query")
    found = dealt.mapInPandas(_search_group(k, levels), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
