"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 64
_LARGEST_RATE = 16.0
_UNIT = float(16**13)


def uniform(*parts: Column) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) that follows from the text of its parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def poisson(rate: Column, draw: Column) -> Column:
    """The inverse Poisson distribution function: how many k have a cumulative probability below ``draw``.

    For rates up to 16; the sum runs far enough that what is left is under 1e-15.
    """
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))
    last = F.ceil(rate + F.sqrt(rate) * 10 + 20).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda s, k: F.when(
            s["c"] < draw,
            F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), k.alias("n")),
        ).otherwise(s),
        lambda s: s["n"],
    )


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often to take a row. A rate over 16 is dealt into equal parts with draws of their own."""
    parts = F.greatest(F.ceil(rate / F.lit(_LARGEST_RATE)).cast("int"), F.lit(1))
    each = rate / parts
    return F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda total, i: total + poisson(each, uniform(key, F.lit(seed), i)),
    )


def rates(docs: DataFrame, source: str, exponent: float, weights: DataFrame | None, total: int | None) -> DataFrame:
    """(source, rate): the mean number of copies of a source's rows.

    The target weight of a source is given in ``weights`` (source, weight; a source that is not
    listed has 0), or else its number of rows to the power of ``exponent``: 1 leaves shares as
    they are, 0 gives every source the same. Rates are such that ``total`` rows are expected
    (the number of rows there are, if None).
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = weights.select(F.col("source").alias("s"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
        weighed = counts.join(given.groupBy("s").agg(F.max("w").alias("w")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        weighed = weighed.withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = weighed.agg(F.sum("w"), F.sum("n")).first()
    scale = (total if total is not None else sums[1] or 0) / sums[0] if sums[0] else 0.0
    return weighed.select("source", (F.lit(float(scale)) * F.col("w") / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame,
    *,
    source: str = "source",
    key: str = "doc_id",
    exponent: float = 0.5,
    weights: DataFrame | None = None,
    total: int | None = None,
    seed: int = 0,
    copy_column: str | None = None,
) -> DataFrame:
    """Take every row a Poisson number of times, so that sources reach their target weights, and shuffle.

    The number is the inverse distribution function at a hash of the row's key and ``seed``, so it
    is the same when a task runs again, and independent of partitions. A row whose key is null is
    hashed by its whole content; rows that repeat a key get the same number. A null source is a
    source like others. Copies are dealt to partitions and put in order by a hash, which is the
    global shuffle. Columns are those of ``docs``, and ``copy_column`` (from 0) if a name is given.

    Source rates are joined by source and one of 64 slices, so that a source with a third of all
    rows is spread over as many tasks.
    """
    row = F.struct("*")
    ident = F.coalesce(F.col(key).cast("string"), F.md5(F.to_json(row)))
    rows = docs.select(row.alias("row"), F.col(source).alias("source"), ident.alias("ident"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
    rate = rates(docs, source, exponent, weights, total).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = rows["source"].eqNullSafe(rate["source"]) & (rows["slice"] == rate["slice"])
    rated = rows.join(rate, same).select("row", "ident", "rate")
    counted = rated.withColumn("n", copies(F.col("rate"), F.col("ident"), seed)).where("n > 0")
    taken = counted.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = F.xxhash64("ident", "copy", F.lit(seed))
    dealt = taken.withColumn("place", place).repartition(F.col("place")).sortWithinPartitions("place")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return dealt.select(*columns, *([F.col("copy").alias(copy_column)] if copy_column else []))
