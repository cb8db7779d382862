"""Sorted pages of rows, map points and the work-list cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.operators.numbering import By, first_in_order
from hooktrace.sources.tables import EXPLORER_COLUMNS

PAGE_ROWS = 50
MAP_POINTS = 2000

# Up to this many rows a plain sort with a limit is fine: each task hands that many rows on.
PLAIN_LIMIT = 1000


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("first_seen"), F.asc("id")]


def page(
    threats: DataFrame,
    number: int = 0,
    rows: int = PAGE_ROWS,
    order_by: Sequence[Column] | None = None,
    columns: Sequence[str] = EXPLORER_COLUMNS,
) -> DataFrame:
    """One page by its number, counted from 0.

    Every task keeps its best ``offset + rows`` rows, so use this for the first
    pages and ``page_after`` for deep ones.
    """
    present = [c for c in columns if c in threats.columns]
    ordered = threats.select(*present).orderBy(*(order_by or newest_first()))
    return ordered.offset(number * rows).limit(rows)


def page_after(
    threats: DataFrame,
    last_first_seen,
    last_id: int,
    rows: int = PAGE_ROWS,
    columns: Sequence[str] = EXPLORER_COLUMNS,
) -> DataFrame:
    """The page that follows a given last row: the cost does not grow with the page depth."""
    seen = F.col("first_seen")
    last = F.lit(last_first_seen).cast("timestamp_ntz")
    same_moment = (seen == last) & (F.col("id") > last_id)
    if last_first_seen is None:
        later = seen.isNull() & (F.col("id") > last_id)
    else:
        later = (seen < last) | same_moment | seen.isNull()
    return page(threats.where(later), 0, rows, columns=columns)


def first_rows(rows: DataFrame, count: int, key: str = "id") -> DataFrame:
    """``rows.orderBy(key).limit(count)``, also for large counts on many tasks."""
    return _first(rows, [By(key)], count)


def _first(rows: DataFrame, order: Sequence[By], count: int) -> DataFrame:
    """The first rows of an order. A sort with a limit has every task send ``count`` rows to one, so that is for few rows."""
    if count <= PLAIN_LIMIT:
        return rows.orderBy(*[b.column() for b in order]).limit(count)
    return first_in_order(rows, order, count)


def map_points(threats: DataFrame, rows: int = MAP_POINTS) -> DataFrame:
    """Threats with coordinates, first by id."""
    located = threats.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "id",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "country",
        "domain",
        "threat_type",
    )
    return first_rows(located, rows).drop("id")


def limit_work(work: DataFrame, rows: int, enriched: DataFrame | None = None, skip_first: bool = True) -> DataFrame:
    """First rows of the work list in feed order.

    With ``skip_first`` URLs already enriched are taken out before the cap, so
    repeated capped runs move on; without it the cap comes first.
    """
    from hooktrace.operators.upsert import skip_existing

    order = [By("feed_rank"), By("url"), By("source_id")]
    every_column = F.struct(*work.columns)
    if enriched is not None and skip_first:
        return _first(skip_existing(work, enriched, spread=every_column), order, rows)
    capped = _first(work, order, rows)
    return capped if enriched is None else skip_existing(capped, enriched)
