"""Address ranges of both families as a sorted list of segments, and lookups in it.

A position is text that sorts like the address: a family mark and 8 or 32 hexadecimal digits.
Ranges may nest, overlap and repeat. Between two neighbouring range borders the narrowest range
is always the same one, so a table of ranges is a list of segments: where one begins, and what is
known there. Only the borders are looked up to make it, never the addresses; these then pass the
segments once, in order, and each meets one of them.

Borders meet ranges by equi-join: a range is the union of a few blocks of equal leading digits
(at most 15 a digit and side), and a border lies in one block per number of leading digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions.ipaddr import IPV6_MARK, ip_key
from hooktrace.operators.asof import last_known
from hooktrace.operators.skew import balanced_left_join
from hooktrace.operators.upsert import one_per_key
from hooktrace.sinks.shared import staged

IPV4_MARK = "n"
_DIGITS = "0123456789abcdef"
_FIRST, _LAST = 0, 2**32 - 1


def number_position(number: Column) -> Column:
    """Position of an IPv4 number; NULL outside the address space."""
    digits = F.lpad(F.lower(F.hex(number)), 8, "0")
    return F.when(number.between(_FIRST, _LAST), F.concat(F.lit(IPV4_MARK), digits))


def key_position(key: Column) -> Column:
    """Position of an address key (see ``ip_key``); NULL for anything else."""
    six = key.startswith(IPV6_MARK)
    return F.when(six, key).otherwise(number_position(F.when(~six, key).try_cast("bigint")))


def range_positions(table: DataFrame) -> DataFrame:
    """Table whose ``lo`` and ``hi``, address text of either family, are made positions.

    Null or unreadable ends, ends of two families and ends in wrong order make no range.
    """
    rows = table.withColumns({end: key_position(ip_key(F.trim(end))) for end in ("lo", "hi")})
    same_family = F.left(F.col("lo"), F.lit(1)) == F.left(F.col("hi"), F.lit(1))
    return rows.where(same_family & (F.col("lo") <= F.col("hi")))


def block_marks(low: Column, high: Column) -> dict[str, Column]:
    """How many characters two positions share at the front, and how many each end needs.

    What follows the needed ones is all zeros in ``lo``, or all f in ``hi``: one block instead of sixteen.
    """
    shared = F.length(F.regexp_extract(F.concat_ws("|", low, high), r"^(.*)[^|]*\|\1", 1))
    return {
        "shared": shared,
        "keep_lo": F.length(F.rtrim(low, F.lit("0"))),
        "keep_hi": F.length(F.rtrim(high, F.lit("f"))),
    }


def range_blocks(low: Column, high: Column, shared: Column, keep_low: Column, keep_high: Column) -> Column:
    """Array of leading characters (family mark included) whose blocks together are exactly the range.

    The last three are the columns of ``block_marks``; make them columns of a table first.
    """
    digit = lambda end, n: F.substr(end, n, F.lit(1))
    digits = F.array(*[F.lit(d) for d in _DIGITS])

    def beside(end: Column, keep: Column, inside) -> Column:
        """Blocks within the part of the range that starts like ``end`` one digit further than the other end."""
        first = shared + 2
        places = F.when(first <= keep, F.sequence(first, keep)).otherwise(F.array().cast("array<int>"))
        blocks = lambda n: F.transform(
            F.filter(digits, lambda d: inside(d, digit(end, n))), lambda d: F.concat(F.left(end, n - 1), d)
        )
        return F.concat(F.array(F.left(end, F.greatest(keep, shared + 1))), F.flatten(F.transform(places, blocks)))

    whole = (keep_low <= shared) & (keep_high <= shared)
    n = shared + 1
    between = F.filter(digits, lambda d: (d > digit(low, n)) & (d < digit(high, n)))
    middle = F.transform(between, lambda d: F.concat(F.left(low, shared), d))
    left = beside(low, keep_low, lambda d, own: d > own)
    right = beside(high, keep_high, lambda d, own: d < own)
    return F.when(whole, F.array(F.left(low, shared))).otherwise(F.concat(left, middle, right))


def next_position(position: Column) -> Column:
    """The position after a position; NULL after the last one of the family."""
    kept = F.length(F.regexp_replace(position, "f+$", ""))
    raised = F.translate(F.substr(position, kept, F.lit(1)), _DIGITS[:-1], _DIGITS[1:])
    after = F.rpad(F.concat(F.left(position, kept - 1), raised), F.length(position), F.lit("0"))
    return F.when(kept > 1, after)


def _size(low: Column, high: Column) -> list[Column]:
    """Addresses of a range less one, as two columns that sort like it: upper and lower 64 bits."""
    half = lambda end, start: F.conv(
        F.substr(F.lpad(F.substr(end, F.lit(2)), 32, "0"), F.lit(start), F.lit(16)), 16, 10
    ).cast("decimal(20,0)")
    upper, lower = half(high, 1) - half(low, 1), half(high, 17) - half(low, 17)
    borrow = F.when(lower < 0, 1).otherwise(0)
    return [upper - borrow, lower + borrow * F.lit(2**32).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)")]


def range_segments(table: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Segments (family, position, found) of a table of ranges; ``found`` is NULL where no range is.

    Of several ranges the narrowest counts, then the one with the lower start, then by ``payload``.
    """
    named = [F.col(c).alias(f"p_{c}") for c in payload]
    low, high = F.col("lo"), F.col("hi")
    upper, lower = _size(low, high)
    # Written once, with all that is worked out from the text of the ends; read three times below.
    ranges = staged(
        range_positions(table)
        .select("lo", "hi", *named)
        .withColumns({**block_marks(low, high), "upper": upper, "lower": lower, "after": next_position(high)}),
        "ranges",
    )
    order = [F.asc("upper"), F.asc("lower"), F.asc("lo"), *[F.asc_nulls_last(f"p_{c}") for c in payload]]
    cut = range_blocks(low, high, F.col("shared"), F.col("keep_lo"), F.col("keep_hi"))
    blocks = ranges.withColumn("block", F.explode(cut))
    # A family has at most 33 lengths.
    lengths = blocks.select(F.length("block").alias("n")).agg(F.collect_set("n")).scalar()
    blocks = one_per_key(blocks, "block", order)
    borders = ranges.select(F.explode(F.array("lo", "after")).alias("position"))
    borders = borders.where(F.col("position").isNotNull()).distinct()
    probes = borders.withColumn("n", F.explode(F.coalesce(lengths, F.array().cast("array<int>"))))
    probes = probes.where(F.col("n") <= F.length("position"))
    probes = probes.select("position", F.left(F.col("position"), F.col("n")).alias("block"))
    met = balanced_left_join(probes, blocks, "block", F.col("position"))
    best = one_per_key(met, "position", [F.col("lo").isNull(), *order])
    found = F.struct(*[F.col(f"p_{c}").alias(c) for c in payload])
    return best.select(
        F.left("position", F.lit(1)).alias("family"), "position", F.when(F.col("lo").isNotNull(), found).alias("found")
    )


def segment_lookup(addresses: DataFrame, segments: DataFrame, key: str = "ip") -> DataFrame:
    """Address keys that lie in a range, with what is known there; one row per row of ``addresses``."""
    position = key_position(F.col(key))
    asked = addresses.select(key, F.left(position, F.lit(1)).alias("family"), position.alias("position"))
    asked = asked.where(F.col("position").isNotNull())
    met = last_known(asked, segments, "family", "position", F.col(key))
    return met.where(F.col("found").isNotNull()).select(key, "found.*")
