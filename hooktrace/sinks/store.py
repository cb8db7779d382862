"""The threat table on plain Parquet: an append log, its current view, and compaction.

    <root>/order/seq=<s>/writer=<w>/batch_id=<n>/    the place of a load among all loads
    <root>/log/writer=<w>/batch_id=<n>/bucket=<b>/   one folder per load
    <root>/base/version=<v>/bucket=<b>/              merged rows of the buckets that changed with v
    <root>/held/version=<v>/writer=<w>/batch_id=<n>/ the loads that a base holds

A load is named by its writer and number and writes only its own rows. Readers see the base, which
has each bucket in its newest finished version, plus every finished load that it does not hold,
whenever the load came. Per URL the last write wins: loads of all writers are numbered as they
begin, so a stream that starts anew with load 0 replaces older rows. A load that comes late, after
one of its writer with a higher number, takes the place of that one and yields to it: it adds what
it has and no more. Rows lie in buckets by a hash of the URL; a lookup by URL or id reads one
bucket, and merging touches only buckets with open loads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from hooktrace.schemas import ENRICHED
from hooktrace.sources.tables import conform, folder_names, make_folder, path_exists, with_default_score

KEEP_ON_REPLACE = ("first_seen", "created_at")
BUCKETS = 32

# Rows of a file are sorted by what filters ask for most, so that the row-group
# statistics let a scan skip. The sort is local: it moves no rows between tasks.
_FILE_ORDER = ("source_feed", "first_seen")
_BUCKET = StructField("bucket", IntegerType())
_LOAD = [StructField("writer", StringType()), StructField("batch_id", LongType())]
# A base row names the load it is from, so that a late load cannot replace a newer row.
_SEQ = StructField("__seq", LongType())
_BASE = StructType([*ENRICHED, _SEQ, StructField("__writer", StringType()), StructField("__batch", LongType()), _BUCKET])
_LOG = StructType([*ENRICHED, _SEQ, *_LOAD, _BUCKET])


def bucket_of(url_hash: Column) -> Column:
    """Bucket of a row by the hash of its URL, which is also its id."""
    return F.pmod(url_hash, F.lit(BUCKETS)).cast("int")


def append_batch(rows: DataFrame, root: str, batch_id: int, writer: str = "main", retry: bool = False) -> None:
    """Write one load.

    A load that is there already is an error, unless it is a ``retry`` of the same writer: that
    replaces the load, or does nothing where a base holds it.
    """
    spark = rows.sparkSession
    load = (writer, batch_id)
    if load in _held(spark, root, _newest(spark, root)):
        if retry:
            return
        raise FileExistsError(f"load {batch_id} of {writer} is part of the base")
    if not retry and load in _loads(spark, root):
        raise FileExistsError(f"load {batch_id} of {writer} is written already")
    placed = conform(rows, ENRICHED).withColumn("__seq", F.lit(_sequence(spark, root, load)).cast("long"))
    _write(placed.withColumn("bucket", bucket_of(F.xxhash64("url"))), load_folder(root, writer, batch_id))


def _sequence(spark: SparkSession, root: str, load: tuple[str, int]) -> int:
    """The place of a load among all loads, kept as the name of an empty folder before any row is written.

    A load that runs again keeps its place. Two loads that begin at once may share one; then their
    numbers decide, and then what their rows were seen last.
    """
    writer, number = load
    places = [int(s) for s in folder_names(spark, f"{root}/order", "seq=")]
    own: dict[int, int] = {}
    for place in places:
        for n in folder_names(spark, f"{root}/order/seq={place}/writer={writer}", "batch_id="):
            own[int(n)] = place
    if number in own:
        return own[number]
    later = [place for n, place in own.items() if n > number]
    place = min(later) if later else max(places, default=0) + 1
    make_folder(spark, f"{root}/order/seq={place}/writer={writer}/batch_id={number}")
    return place


def _write(placed: DataFrame, path: str) -> None:
    # One pass deals rows by bucket; adaptive execution splits large buckets and joins small ones.
    dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *_FILE_ORDER)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_urls(spark: SparkSession, root: str, before: tuple[str, int] | None = None) -> DataFrame:
    """URLs of the table with their bucket, possibly repeated: a scan of one column, for anti-joins.

    ``before`` leaves out that load and later ones of the same writer, so that a load that runs
    again sees the table it saw the first time.
    """
    version = _newest(spark, root)
    wanted = [x for x in _open_loads(spark, root, version) if before is None or x[0] != before[0] or x[1] < before[1]]
    base = _base(spark, root, _placed(spark, root, version)).select("url", "bucket")
    log = _log(spark, root, wanted)
    return base if log is None else base.union(log.select("url", "bucket"))


def current(
    spark: SparkSession,
    root: str,
    reset_first_seen: bool = False,
    through: int | None = None,
    buckets: Sequence[int] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """The table as of the last load: one row per URL, the one written last.

    Buckets without open loads are read as they are, without a shuffle. The time of first sighting survives later loads, unless ``reset_first_seen``. ``through``
    leaves out loads of a higher number, as long as they are not merged into the base. With ``buckets`` only
    these are read, and with ``keys``, hashes of URLs in a column ``key``, only rows of these URLs are merged.
    """
    merged = _merged(spark, root, _newest(spark, root), reset_first_seen, through, keys)
    if buckets is not None:
        merged = merged.where(F.col("bucket").isin(list(buckets)))
    return merged.select(*ENRICHED.names)


def finished_loads(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Writer and number of the loads whose rows are there, merged or not."""
    return sorted(_loads(spark, root))


def merged_loads(spark: SparkSession, root: str) -> set[tuple[str, int]]:
    """Loads that the newest base holds."""
    return _held(spark, root, _newest(spark, root))


def load_rows(spark: SparkSession, root: str, loads: list[tuple[str, int]]) -> DataFrame:
    """All rows of some loads, as written, with their bucket."""
    rows = _log(spark, root, loads)
    return (spark.createDataFrame([], _LOG) if rows is None else rows).select(*ENRICHED.names, "bucket")


def lookup(spark: SparkSession, root: str, *, url: str | None = None, row_id: int | None = None) -> DataFrame:
    """The current row of a URL, or of an id that is the hash of its URL: one bucket is read."""
    if (url is None) == (row_id is None):
        raise ValueError("give a url or a row_id")
    key = F.xxhash64(F.lit(url)) if row_id is None else F.lit(row_id).cast("bigint")
    rows = _merged(spark, root, _newest(spark, root), False, None)
    match = F.col("url") == url if row_id is None else F.col("id") == row_id
    return rows.where((F.col("bucket") == bucket_of(key)) & match).select(*ENRICHED.names)


def compact(spark: SparkSession, root: str, reset_first_seen: bool = False) -> int:
    """Merge all finished loads into a new version of the base; returns it.

    Only the buckets that these loads have rows in are read and written again; the others stay
    in the version they are in. The list of loads held is written last and makes the version
    count. Loads that it holds may then be removed, and of older versions the buckets that a newer
    one has.
    """
    version = _newest(spark, root)
    fresh = _open_loads(spark, root, version)
    if not fresh:
        if version < 0:
            raise ValueError("no loads to compact")
        return version
    rows, _ = _merge(spark, root, version, fresh, reset_first_seen)
    _write(rows, f"{root}/base/version={version + 1}")
    held = sorted({*_held(spark, root, version), *fresh})
    marks = spark.createDataFrame([(w, n, 1) for w, n in held], "writer string, batch_id long, one int")
    marks.coalesce(1).write.mode("overwrite").partitionBy("writer", "batch_id").parquet(f"{root}/held/version={version + 1}")
    return version + 1


def _merged(
    spark: SparkSession, root: str, version: int, reset_first_seen: bool, through: int | None, keys: DataFrame | None = None
) -> DataFrame:
    """Rows of the base and the loads after it, one per URL."""
    if through is not None and any(n > through for _, n in _held(spark, root, version)):
        raise ValueError("the base holds later loads")
    wanted = [x for x in _open_loads(spark, root, version) if through is None or x[1] <= through]
    merged, calm = _merge(spark, root, version, wanted, reset_first_seen, keys)
    rest = _of_keys(_base(spark, root, calm), keys)
    return rest if merged is None else merged.unionByName(rest) if calm else merged


def _of_keys(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    return rows if keys is None else rows.join(keys, F.xxhash64("url") == F.col("key"), "left_semi")


def _merge(
    spark: SparkSession,
    root: str,
    version: int,
    loads: list[tuple[str, int]],
    reset_first_seen: bool,
    keys: DataFrame | None = None,
) -> tuple[DataFrame | None, dict[int, int]]:
    """The buckets that loads have rows in, merged with the base by one pass over both, and where the others are."""
    placed = _placed(spark, root, version)
    log = _log(spark, root, loads)
    if log is None:
        return None, placed
    touched = {int(b) for w, n in loads for b in folder_names(spark, load_folder(root, w, n), "bucket=")}
    base = _base(spark, root, {b: v for b, v in placed.items() if b in touched})
    # All versions of a URL have its key.
    both = _of_keys(base.unionByName(log).where(F.col("url").isNotNull()), keys)
    # By bucket and URL, so that a filter on the bucket goes down to the scans.
    same = Window.partitionBy("bucket", "url")
    latest = same.orderBy(
        F.desc_nulls_last("__seq"), F.desc("__batch"), F.desc_nulls_last("last_seen"), F.desc_nulls_last("source_id"), F.asc("__writer"),
        F.asc(F.xxhash64(*ENRICHED.names)), *[F.asc_nulls_first(c) for c in ENRICHED.names],
    )
    ranked = both.withColumn("__place", F.row_number().over(latest))
    if not reset_first_seen:
        ranked = ranked.withColumns({c: F.min(c).over(same) for c in KEEP_ON_REPLACE})
    return ranked.where("__place = 1").drop("__place"), {b: v for b, v in placed.items() if b not in touched}


def _placed(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """For each bucket of the base the newest finished version that has it."""
    found: dict[int, int] = {}
    for v in sorted(x for x in _finished(spark, root) if x <= version):
        found.update({int(b): v for b in folder_names(spark, f"{root}/base/version={v}", "bucket=")})
    return found


def _base(spark: SparkSession, root: str, placed: dict[int, int]) -> DataFrame:
    if not placed:
        return spark.createDataFrame([], _BASE)
    # The schema is given, so no footer is read to plan; a column that a file lacks reads as NULL.
    paths = [f"{root}/base/version={v}/bucket={b}" for b, v in sorted(placed.items())]
    rows = spark.read.schema(_BASE).option("basePath", f"{root}/base").parquet(*paths)
    return with_default_score(rows.select(*_BASE.names))


def load_folder(root: str, writer: str, batch_id: int) -> str:
    return f"{root}/log/writer={writer}/batch_id={batch_id}"


def _log(spark: SparkSession, root: str, loads: list[tuple[str, int]]) -> DataFrame | None:
    if not loads:
        return None
    paths = [load_folder(root, w, n) for w, n in loads]
    rows = spark.read.schema(_LOG).option("basePath", f"{root}/log").parquet(*paths)
    return with_default_score(rows).withColumnsRenamed({"writer": "__writer", "batch_id": "__batch"})


def _newest(spark: SparkSession, root: str) -> int:
    """The newest finished version of the base, -1 without any."""
    return max(_finished(spark, root), default=-1)


def _finished(spark: SparkSession, root: str) -> list[int]:
    return [int(v) for v in folder_names(spark, f"{root}/held", "version=") if path_exists(spark, f"{root}/held/version={v}/_SUCCESS")]


def _held(spark: SparkSession, root: str, version: int) -> set[tuple[str, int]]:
    folder = f"{root}/held/version={version}"
    writers = folder_names(spark, folder, "writer=") if version >= 0 else []
    return {(w, int(n)) for w in writers for n in folder_names(spark, f"{folder}/writer={w}", "batch_id=")}


def _loads(spark: SparkSession, root: str) -> set[tuple[str, int]]:
    """Finished loads, by the ``_SUCCESS`` mark Spark leaves."""
    found = {(w, int(n)) for w in folder_names(spark, f"{root}/log", "writer=") for n in folder_names(spark, f"{root}/log/writer={w}", "batch_id=")}
    return {(w, n) for w, n in found if path_exists(spark, f"{root}/log/writer={w}/batch_id={n}/_SUCCESS")}


def _open_loads(spark: SparkSession, root: str, version: int) -> list[tuple[str, int]]:
    return sorted(_loads(spark, root) - _held(spark, root, version))
