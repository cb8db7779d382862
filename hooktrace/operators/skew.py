"""Left equi-join that stays balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# At most this many heavy keys are looked up by broadcast: a fixed bound on what is sent.
# Any key beyond them holds less than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 10_000
ROWS_PER_SLICE = 4_000_000
MAX_SLICES = 4_096

_SLICES = "__slices"
_SLICE = "__slice"


def heavy_keys(
    facts: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE, limit: int = HEAVY_KEYS
) -> DataFrame:
    """Keys with more rows than one task should take, and into how many slices to cut them.

    The counts are formed before the shuffle, so finding a hot key is not itself skewed.
    """
    counted = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    slices = F.least(F.lit(MAX_SLICES), F.ceil(F.col("rows") / F.lit(rows_per_slice)))
    return (
        counted.where(F.col("rows") > rows_per_slice)
        .orderBy(F.desc("rows"), F.asc(key))
        .limit(limit)
        .select(key, slices.cast("int").alias(_SLICES))
    )


def fits_broadcast(dim: DataFrame) -> bool:
    """True when Spark's own size estimate puts a table under its broadcast limit."""
    limit = dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def balanced_left_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: Column,
    *,
    counted_facts: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    limit: int = HEAVY_KEYS,
) -> DataFrame:
    """Left join of facts with a table that has one row per key.

    Rows of a heavy key are cut into slices by a hash of ``spread`` and the one
    matching row is repeated per slice. Rows without a key would all land in
    one task, so they are spread as well. The result is the plain left join.

    ``counted_facts`` may name a cheaper frame with the same key counts, such
    as a stored table, when ``facts`` is costly to compute twice.

    A table under Spark's broadcast limit is joined without any of this: the
    facts then stay where they are, so no task gets more rows than it had.
    """
    if fits_broadcast(dim):
        return facts.join(dim, key, "left")
    heavy = heavy_keys(facts if counted_facts is None else counted_facts, key, rows_per_slice, limit)
    mixed = F.xxhash64(spread)
    slice_of = F.when(F.col(key).isNull(), F.pmod(mixed, F.lit(MAX_SLICES))).otherwise(
        F.coalesce(F.pmod(mixed, F.col(_SLICES)), F.lit(0))
    )
    sliced_facts = (
        facts.join(F.broadcast(heavy), key, "left")
        .withColumn(_SLICE, slice_of.cast("int"))
        .drop(_SLICES)
    )
    repeats = F.sequence(F.lit(0), F.coalesce(F.col(_SLICES), F.lit(1)) - F.lit(1))
    sliced_dim = (
        dim.join(F.broadcast(heavy), key, "left")
        .withColumn(_SLICE, F.explode(repeats))
        .drop(_SLICES)
    )
    return sliced_facts.join(sliced_dim, [key, _SLICE], "left").drop(_SLICE)
