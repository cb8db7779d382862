"""Row numbers and first rows of any order, without a task that sees more than its range of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hooktrace.sinks.shared import staged

_PART, _AT, _START, _MIX, _KEY = "__part", "__at", "__start", "__mix", "__key"
# monotonically_increasing_id: the partition is above these bits, the row in it below.
_ROW_BITS = 33


@dataclass(frozen=True)
class By:
    """One column of an order. Nulls come first, or last where it is descending, unless ``nulls_first`` says otherwise."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def _nulls_first(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self._nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self._nulls_first else c.asc_nulls_last()

    def before(self, value: Column) -> Column:
        """The row is strictly before a value."""
        c = F.col(self.name)
        plain = F.coalesce(c > value if self.descending else c < value, F.lit(False))
        null = c.isNull() & value.isNotNull() if self._nulls_first else c.isNotNull() & value.isNull()
        return plain | null


def numbered(rows: DataFrame, order: Sequence[By], out: str = "row_no") -> DataFrame:
    """All rows with their number in an order, from 0.

    Rows are dealt by ranges of the order and of a hash of the whole row, which decides ties (and
    lets a value of very many rows be cut), sorted there and written once; a range then starts where
    the counts of those before it end. Rows that are equal in every column share a range. Columns of
    a type without a hash (maps) are not supported.
    """
    by = [*order, By(_MIX)]
    dealt = _dealt(rows, by).withColumn(_AT, F.monotonically_increasing_id())
    written = staged(dealt, "numbered").withColumn(_PART, F.shiftright(_AT, _ROW_BITS))
    # One row per range, so the window over all of them is small.
    counts = written.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_START))
    at = F.col(_AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return written.join(F.broadcast(starts), _PART).select(*rows.columns, (F.col(_START) + at).alias(out))


def first_in_order(rows: DataFrame, order: Sequence[By], count: int) -> DataFrame:
    """The first ``count`` rows of an order, for any count: the rows of ``numbered`` below it.

    A first pass deals only the columns of the order by ranges and counts them. The last row of the
    range in which the count is reached bounds the rows that the second pass has to move.
    """
    by = [*order, By(_MIX)]
    names = [b.name for b in by]
    keys = _dealt(rows, by, names).select(
        F.struct(*names).alias(_KEY), F.monotonically_increasing_id().alias(_AT)
    )
    ends = keys.groupBy(F.shiftright(_AT, _ROW_BITS).alias(_PART)).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(_KEY, _AT).alias(_KEY)
    )
    so_far = F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = ends.withColumn("so_far", so_far).where(F.col("so_far") >= count)
    cut = reached.agg(F.min_by(_KEY, _PART)).scalar()
    inside = F.lit(True)
    for b in reversed(by):
        value = cut.getField(b.name)
        inside = b.before(value) | (F.col(b.name).eqNullSafe(value) & inside)
    mixed = rows.withColumn(_MIX, F.xxhash64(*rows.columns))
    kept = mixed.where(cut.isNull() | inside).drop(_MIX)
    return numbered(kept, order, _AT).where(F.col(_AT) < count).drop(_AT)


def _dealt(rows: DataFrame, by: Sequence[By], names: Sequence[str] | None = None) -> DataFrame:
    mixed = rows.withColumn(_MIX, F.xxhash64(*rows.columns))
    if names is not None:
        mixed = mixed.select(*names)
    order = [b.column() for b in by]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
