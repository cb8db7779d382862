"""First-wins, last-wins and update-in-place by key, as DataFrame rewrites.

Picking one row per key uses ``row_number() = 1``. Spark then keeps one row per
key in every task before the shuffle (WindowGroupLimit), so a hot key sends at
most one row per task.

A stored table is usually far larger than a load. Rows that stay are found by an
anti-join against the load's keys and are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hooktrace.operators.skew import balanced_left_join

_PLACE = "__place"


def one_per_key(rows: DataFrame, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that sorts first among those of equal key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn(_PLACE, F.row_number().over(window)).where(F.col(_PLACE) == 1).drop(_PLACE)
    )


def upsert_ignore(
    existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]
) -> DataFrame:
    """Add rows with a new key, the first one winning; stored rows stay, NULL keys are skipped."""
    return existing.unionByName(new_rows(existing, incoming, key, order), allowMissingColumns=True)


def new_rows(
    existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]
) -> DataFrame:
    """Just the rows ``upsert_ignore`` adds."""
    first = one_per_key(incoming.where(F.col(key).isNotNull()), key, order)
    return first.join(existing.select(key), key, "left_anti")


def upsert_replace(
    existing: DataFrame,
    incoming: DataFrame,
    key: str,
    latest: Sequence[Column],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Put in rows by key, the one that sorts first in ``latest`` winning over all others.

    ``keep`` names columns whose stored value outlives the replacement, such as
    the time of first sighting.
    """
    winners = one_per_key(incoming.where(F.col(key).isNotNull()), key, latest)
    keys = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    untouched = existing.join(keys, key, "left_anti")
    if keep:
        stored = existing.join(keys, key, "left_semi").select(
            key, *[F.col(c).alias(f"__stored_{c}") for c in keep]
        )
        kept = {c: F.coalesce(F.col(f"__stored_{c}"), F.col(c)) for c in keep}
        winners = (
            winners.join(stored, key, "left")
            .withColumns(kept)
            .drop(*[f"__stored_{c}" for c in keep])
        )
    return untouched.unionByName(winners, allowMissingColumns=True)


def upsert_update(
    existing: DataFrame, incoming: DataFrame, key: str, latest: Sequence[Column], stamp: str
) -> DataFrame:
    """Update all columns of a known key but its load time; add rows of new keys."""
    return upsert_replace(existing, incoming, key, latest, keep=[stamp])


def dedup_feeds(
    work: DataFrame, order: Sequence[Column] = (), first_wins: bool = False
) -> DataFrame:
    """One row per URL over all feeds.

    The later feed wins (the earlier one with ``first_wins``). Between rows of one
    feed ``order`` decides; by default the highest source id wins.
    """
    rank = F.asc("feed_rank") if first_wins else F.desc("feed_rank")
    ties = list(order) or [F.desc_nulls_last(F.col("source_id").try_cast("bigint"))]
    # What is still equal is told apart by content, so the order of rows never decides.
    rest = [F.asc_nulls_first(c) for c in work.columns if c != "url"]
    return one_per_key(work.where(F.col("url").isNotNull()), "url", [rank, *ties, *rest])


def skip_existing(
    work: DataFrame, enriched: DataFrame, key: str = "url", spread: Column | None = None
) -> DataFrame:
    """Rows whose key is not stored yet.

    For rows that are not unique by key give ``spread`` (a column that differs
    between them): heavy keys are then cut up by it.
    """
    if spread is None:
        return work.join(enriched.select(key), key, "left_anti")
    marked = with_exists_flag(work, enriched, key, "__known", spread)
    return marked.where(~F.col("__known")).drop("__known")


def with_exists_flag(
    work: DataFrame,
    enriched: DataFrame,
    key: str = "url",
    flag: str = "is_enriched",
    spread: Column | None = None,
) -> DataFrame:
    """All rows, marked by whether their key is stored; ``spread`` as in ``skip_existing``."""
    known = enriched.select(key).distinct().withColumn(flag, F.lit(True))
    if spread is None:
        joined = work.join(known, key, "left")
    else:
        joined = balanced_left_join(work, known, key, spread)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def load_stats(work: DataFrame, enriched: DataFrame) -> DataFrame:
    """Rows to process, rows skipped as already stored, and rows without a host, per feed.

    URL counts are formed first, so the join with the stored keys sees each URL
    of a feed once, however often it was listed.
    """
    from hooktrace.functions.urls import url_host

    per_url = work.groupBy("source_feed", "url").agg(F.count(F.lit(1)).alias("rows"))
    marked = with_exists_flag(per_url, enriched)
    rows = F.col("rows")
    known = F.col("is_enriched")
    total = lambda condition: F.sum(F.when(condition, rows).otherwise(0))
    return marked.groupBy("source_feed").agg(
        total(~known).alias("processed"),
        total(known).alias("skipped"),
        total(~known & url_host(F.col("url")).isNull()).alias("without_host"),
        F.count_if(~known).alias("rows_added"),
    )


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many keys a load adds and how many it updates, and how many rows lack a key."""
    per_key = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    marked = with_exists_flag(per_key, existing, key)
    has_key = F.col(key).isNotNull()
    return marked.agg(
        F.count_if(has_key & ~F.col("is_enriched")).alias("inserted"),
        F.count_if(has_key & F.col("is_enriched")).alias("updated"),
        F.coalesce(F.sum(F.when(~has_key, F.col("rows"))), F.lit(0)).alias("dropped_without_key"),
    )
