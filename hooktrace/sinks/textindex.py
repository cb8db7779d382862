"""Substring search of the stored threat table without a scan: postings of three-letter runs.

    <root>/grams/writer=<w>/batch_id=<n>/stamp=<t>/gram_bucket=<g>/   gram, bucket, key; a run's lie together
    <root>/gram_counts/writer=<w>/batch_id=<n>/stamp=<t>/             gram, n; written last, makes the load count

Every load of the table is indexed for itself, by what its rows hold, and ``key`` is the hash of the
URL, so a row that a later load replaces keeps its postings: what the index finds is always a
superset of the rows that match, and the rows found are checked with the very condition that a scan
uses. A load that is not indexed yet gives all its URLs. The stamp is the time at which the load was
finished; a load that is written again has to be indexed again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hooktrace.operators.filters import SEARCH_FIELDS, SEARCH_ROWS, TEXT_COLUMNS, text_matches
from hooktrace.sinks import store
from hooktrace.sinks.shared import staged
from hooktrace.sources.tables import folder_names, modified, path_exists

GRAM_BUCKETS = 64
# The rarest runs of a pattern are looked up; the check of the rows found stands for the others.
LOOKED_UP = 4

_POSTINGS = "gram string, bucket int, key long, gram_bucket int"


def grams(text: Column) -> Column:
    """Distinct runs of three code points of the lower-cased text; NULL for NULL, none for shorter texts."""
    return F.array_distinct(_runs(F.lower(text)))


def _runs(lowered: Column) -> Column:
    """Runs of three code points, one from each place on, by one pass of a pattern.

    A pattern goes on by half a code point where one takes two UTF-16 units, so texts with such ones are cut otherwise.
    """
    chars = F.split(lowered, "")
    after = lambda n: F.slice(chars, n + 1, F.size(chars))
    pairs = F.zip_with(chars, after(1), lambda a, b: F.concat(a, b))
    points = F.array_compact(F.zip_with(pairs, after(2), lambda a, b: F.concat(a, b)))
    plain = F.regexp_extract_all(lowered, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.when(lowered.rlike(r"[^\x{0}-\x{FFFF}]"), points).otherwise(plain)


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def index_loads(spark: SparkSession, root: str) -> int:
    """Index the finished loads that are not indexed; returns how many there were.

    A load is written in one pass, without a shuffle but for dealing postings to their buckets. An index that
    was cut short does not count and is written again.
    """
    missing = sorted(set(store.finished_loads(spark, root)) - set(_indexed(spark, root)))
    for writer, number in missing:
        stamp = _stamp(spark, root, (writer, number))
        rows = store.load_rows(spark, root, [(writer, number)])
        found = F.concat(*[F.coalesce(_runs(F.lower(c)), F.array().cast("array<string>")) for c in TEXT_COLUMNS])
        postings = rows.select(F.xxhash64("url").alias("key"), F.explode(F.array_distinct(found)).alias("gram")).select(
            "gram", store.bucket_of(F.col("key")).alias("bucket"), "key", _gram_bucket(F.col("gram")).alias("gram_bucket")
        )
        # Runs only need to lie together: sorting by one number is several times cheaper than by the text of each posting.
        dealt = postings.hint("rebalance", "gram_bucket").withColumn("gram_hash", F.xxhash64("gram"))
        dealt = dealt.sortWithinPartitions("gram_hash").drop("gram_hash")
        folder = _folder(root, "grams", (writer, number), stamp)
        dealt.write.mode("overwrite").partitionBy("gram_bucket").parquet(folder)
        counts = spark.read.schema(_POSTINGS).parquet(folder).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # At most one row for each run of three letters there is.
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(
            _folder(root, "gram_counts", (writer, number), stamp)
        )
    return len(missing)


def matching(spark: SparkSession, root: str, text: str, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Current rows with the text, case-insensitively, in any of the columns: those of a scan with ``text_matches``.

    "%" and "_" are wildcards as there. A text without three fixed letters in a row, and a table
    with a load that was removed before it was indexed, are scanned.
    """
    if not set(columns) <= set(TEXT_COLUMNS):
        raise ValueError(f"only {', '.join(TEXT_COLUMNS)} are indexed")
    keys = candidates(spark, root, text)
    if keys is None:
        return store.current(spark, root).where(text_matches(text, columns))
    keys = staged(keys, "search-keys")
    buckets = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most the buckets of the table
    # Only rows of these URLs are merged.
    return store.current(spark, root, buckets=buckets, keys=keys.select("key")).where(text_matches(text, columns))


def search(spark: SparkSession, root: str, kind: str, term: str) -> DataFrame:
    """``operators.filters.search`` on the stored table, by the index."""
    if kind == "id":
        return store.current(spark, root).where(F.col("id") == int(term))
    return matching(spark, root, term, [SEARCH_FIELDS[kind]]).orderBy("id").limit(SEARCH_ROWS)


def candidates(spark: SparkSession, root: str, text: str) -> DataFrame | None:
    """Bucket and hash of the URLs that may hold the text; None where the index cannot tell."""
    wanted = pattern_grams(spark, text)
    indexed = _indexed(spark, root)
    loads = set(store.finished_loads(spark, root))
    if not wanted or not store.merged_loads(spark, root) <= loads | set(indexed):
        return None
    fresh = store.load_rows(spark, root, sorted(loads - set(indexed)))
    fresh = fresh.select("bucket", F.xxhash64("url").alias("key")).distinct()
    rarest = _rarest(spark, root, indexed, list(wanted))
    if not rarest:
        return fresh
    paths = [
        f"{folder}/gram_bucket={b}"
        for folder in (_folder(root, "grams", load, stamp) for load, stamp in sorted(indexed.items()))
        for b in sorted({wanted[g] for g in rarest} & {int(x) for x in folder_names(spark, folder, "gram_bucket=")})
    ]
    if not paths:
        return fresh
    postings = spark.read.schema(_POSTINGS).option("basePath", f"{root}/grams").parquet(*paths)
    bit = F.coalesce(*[F.when(F.col("gram") == g, 1 << i) for i, g in enumerate(rarest)])
    found = postings.where(F.col("gram").isin(rarest)).groupBy("bucket", "key").agg(F.bit_or(bit).alias("seen"))
    return found.where(F.col("seen") == (1 << len(rarest)) - 1).select("bucket", "key").union(fresh)


def pattern_grams(spark: SparkSession, text: str) -> dict[str, int]:
    """The runs of three letters that every match of a pattern holds, with their buckets."""
    row = spark.sql("SELECT 1")
    # Lower-cased as a whole and by Spark, since that is what the comparison does.
    lowered = row.select(F.lower(F.lit(text))).first()[0]
    found = sorted({p[i : i + 3] for p in re.split("[%_]", lowered) for i in range(len(p) - 2)})
    buckets = row.select(F.array(*[_gram_bucket(F.lit(g)) for g in found])).first()[0] if found else []
    return dict(zip(found, buckets, strict=True))


def _rarest(spark: SparkSession, root: str, indexed: dict, wanted: list[str]) -> list[str]:
    """The runs with fewest postings; none where one of them occurs nowhere, so that no indexed row can match."""
    if not indexed:
        return []
    paths = [_folder(root, "gram_counts", load, stamp) for load, stamp in sorted(indexed.items())]
    counts = spark.read.schema("gram string, n long").parquet(*paths).where(F.col("gram").isin(wanted))
    known = {r[0]: r[1] for r in counts.groupBy("gram").agg(F.sum("n")).collect()}  # at most one row per run of the pattern
    if len(known) < len(wanted):
        return []
    return sorted(wanted, key=lambda g: (known[g], g))[:LOOKED_UP]


def _folder(root: str, kind: str, load: tuple[str, int], stamp: int) -> str:
    return f"{root}/{kind}/writer={load[0]}/batch_id={load[1]}/stamp={stamp}"


def _stamp(spark: SparkSession, root: str, load: tuple[str, int]) -> int:
    return modified(spark, f"{store.load_folder(root, *load)}/_SUCCESS")


def _indexed(spark: SparkSession, root: str) -> dict[tuple[str, int], int]:
    """Loads with a finished index, and its stamp. Of a load whose rows were removed the newest index counts."""
    there = set(store.finished_loads(spark, root))
    found: dict[tuple[str, int], int] = {}
    counts = f"{root}/gram_counts"
    for writer in folder_names(spark, counts, "writer="):
        for number in folder_names(spark, f"{counts}/writer={writer}", "batch_id="):
            load = (writer, int(number))
            stamps = [int(s) for s in folder_names(spark, f"{counts}/writer={writer}/batch_id={number}", "stamp=")]
            done = [s for s in stamps if path_exists(spark, f"{_folder(root, 'gram_counts', load, s)}/_SUCCESS")]
            if load in there:
                now = _stamp(spark, root, load)
                done = [s for s in done if s == now]
            if done:
                found[load] = max(done)
    return found
