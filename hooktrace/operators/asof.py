"""Ordered lookups: the last fact at or before a row, by one sorted pass over ranges of the order.

Facts and rows are dealt to partitions by ranges of (group, position) and sorted there. The last
fact of every partition is handed on to the partitions after it, so a group, however large, is cut
wherever a range ends, and no row is ever compared with more than one fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hooktrace.operators.upsert import one_per_key
from hooktrace.sinks.shared import staged

_PART, _KIND, _MIX, _FACT, _ROW = "__part", "__kind", "__mix", "__fact", "__row"
_HANDED, _IS_FACT, _IS_ROW = -1, 0, 1


def last_known(rows: DataFrame, facts: DataFrame, group: str, position: str, spread: Column) -> DataFrame:
    """Rows with the other columns of the last fact of their group at or before their position.

    ``facts`` has one row per group and position; a null position comes before all others. Rows
    need a group. Rows before the first fact of their group get NULL. ``spread`` tells rows of
    equal group and position apart, so that many of them can be cut as well. Columns of ``facts``
    must not be columns of ``rows``, ``group`` and ``position`` excepted.
    """
    payload = [c for c in facts.columns if c not in (group, position)]
    both = [group, position]
    known = facts.select(
        *both, F.lit(_IS_FACT).alias(_KIND), F.lit(0).cast("bigint").alias(_MIX),
        F.struct(F.col(group).alias("of"), *payload).alias(_FACT),
    )
    asked = rows.select(
        *both, F.lit(_IS_ROW).alias(_KIND), F.xxhash64(spread).alias(_MIX), F.struct(*rows.columns).alias(_ROW)
    )
    events = known.unionByName(asked, allowMissingColumns=True)
    # Written once: both the hand-over and the pass itself must see the same ranges.
    dealt = staged(
        events.repartitionByRange(*both, _KIND, _MIX).withColumn(_PART, F.spark_partition_id()), "ordered"
    )
    ends = dealt.where(F.col(_KIND) == _IS_FACT).groupBy(_PART)
    ends = ends.agg(F.max_by(_FACT, F.struct(*both)).alias(_FACT))
    # One row per partition of the shuffle, so this single ordered pass is short.
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    handed = dealt.select(_PART).distinct().join(ends, _PART, "left").select(
        _PART, F.lit(_HANDED).alias(_KIND), F.last(_FACT, ignorenulls=True).over(earlier).alias(_FACT)
    )
    order = Window.partitionBy(_PART).orderBy(F.col(_KIND) != _HANDED, *both, _KIND)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = dealt.drop(_MIX).unionByName(handed, allowMissingColumns=True)
    passed = passed.withColumn(_FACT, F.last(_FACT, ignorenulls=True).over(so_far))
    same = F.col(f"{_FACT}.of") == F.col(group)
    return passed.where(F.col(_KIND) == _IS_ROW).select(
        f"{_ROW}.*", *[F.when(same, F.col(_FACT)[c]).alias(c) for c in payload]
    )


def join_as_of(
    rows: DataFrame,
    captures: DataFrame,
    key: str,
    at: str,
    captured: str,
    spread: Column,
    ties: Sequence[Column] = (),
) -> DataFrame:
    """Rows with the newest capture of their key that is not after their own time ``at``.

    Rows without a key or a time match nothing. A capture without a time counts as the oldest.
    Captures of one key and time are ordered by ``ties``, or else by all their columns; the first counts.
    """
    payload = [c for c in captures.columns if c not in (key, captured)]
    clock = rows.schema[at].dataType
    facts = captures.where(F.col(key).isNotNull()).withColumn(captured, F.col(captured).cast(clock))
    facts = one_per_key(facts, [key, captured], list(ties) or [F.asc_nulls_last(c) for c in payload])
    facts = facts.withColumnRenamed(captured, at)
    timed = F.col(key).isNotNull() & F.col(at).isNotNull()
    found = last_known(rows.where(timed), facts, key, at, spread)
    return found.unionByName(rows.where(~timed), allowMissingColumns=True)
