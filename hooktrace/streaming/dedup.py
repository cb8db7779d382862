"""Deduplication of a stream over its whole life, against a stored table instead of stream state.

    <root>/rows/writer=<w>/batch_id=<n>/key_bucket=<b>/     first rows of their keys
    <root>/filter/writer=<w>/batch_id=<n>/key_bucket=<b>/   word, bits: the keys of that batch; written last

A batch is cut to one row per key in every task before it is shuffled. A filter for each bucket tells
most new keys from those that may be stored; only the buckets of the latter are read, and only the
key column. What the stream keeps in memory does not grow with the keys seen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hooktrace.operators.presence import key_bits, may_hold, merged_bits, word_of
from hooktrace.operators.upsert import one_per_key
from hooktrace.sinks.shared import staged
from hooktrace.sinks.store import bucket_of
from hooktrace.sources.tables import folder_names, path_exists
from hooktrace.streaming.feeds import run_batches

_BITS = "word int, bits long, key_bucket int"
_BUCKET, _HIT = "key_bucket", "__hit"

Load = tuple[str, int]


def dedup_into(rows: DataFrame, root: str, checkpoint: str, time_column: str, key: str = "url") -> StreamingQuery:
    """Add the rows of new keys to the table below ``root``: of a key's rows in its first batch the earliest.

    Rows without a key are dropped, ties go by the other columns. A batch that runs again sees the table as it was before it and replaces
    its own rows, so every key is stored once. Several streams may fill one table one after the
    other; two that run at once may both store a key.
    """
    writer = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def load(batch: DataFrame, batch_id: int) -> None:
        add_new(batch, root, (writer, batch_id), time_column, key)

    return run_batches(rows, load, checkpoint)


def add_new(batch: DataFrame, root: str, load: Load, time_column: str, key: str = "url") -> None:
    """One batch of ``dedup_into``."""
    spark = batch.sparkSession
    fresh = _unseen(batch, root, load, time_column, key)
    path = _folder(root, "rows", load)
    fresh.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
    written = spark.read.schema(StructType([*batch.schema.fields, fresh.schema[_BUCKET]])).parquet(path)
    bits = key_bits(written, key, _BUCKET)
    bits.write.mode("overwrite").partitionBy(_BUCKET).parquet(_folder(root, "filter", load))


def read_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows of finished batches."""
    paths = [_folder(root, "rows", load) for load in _finished(spark, root)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths).select(*schema.names)


def _unseen(batch: DataFrame, root: str, load: Load, time_column: str, key: str) -> DataFrame:
    spark = batch.sparkSession
    ties = [F.asc_nulls_last(time_column), F.asc(F.xxhash64(*batch.columns)), *[F.asc_nulls_first(c) for c in batch.columns]]
    first = one_per_key(batch.where(F.col(key).isNotNull()), key, ties)
    first = first.withColumn(_BUCKET, bucket_of(F.xxhash64(key)))
    # Its own earlier run and later batches of this writer do not count.
    before = [x for x in _finished(spark, root) if x[0] != load[0] or x[1] < load[1]]
    if not before:
        return first
    parts = spark.read.schema(_BITS).option("basePath", f"{root}/filter").parquet(*[_folder(root, "filter", x) for x in before])
    bits = merged_bits(parts, _BUCKET).withColumnsRenamed({_BUCKET: "__at", "word": "__word", "bits": "__bits"})
    same = (F.col(_BUCKET) == F.col("__at")) & (word_of(F.col(key)) == F.col("__word"))
    flagged = first.join(bits, same, "left").withColumn(_HIT, may_hold(F.col("__bits"), F.col(key)))
    flagged = staged(flagged.drop("__at", "__word", "__bits"), "dedup")
    hits = flagged.where(_HIT)
    buckets = sorted(r[0] for r in hits.select(_BUCKET).distinct().collect())  # at most the buckets of the table
    stored = _stored_keys(spark, root, before, buckets, batch.schema, key)
    old_hits = hits if stored is None else hits.join(stored, F.col(key) == F.col("__stored"), "left_anti")
    return flagged.where(~F.col(_HIT)).unionByName(old_hits).drop(_HIT)


def _stored_keys(spark: SparkSession, root: str, loads: list[Load], buckets: list[int], schema: StructType, key: str):
    """Keys stored in some buckets; None where there are none."""
    paths = []
    for load in loads:
        folder = _folder(root, "rows", load)
        there = {int(b) for b in folder_names(spark, folder, f"{_BUCKET}=")}
        paths += [f"{folder}/key_bucket={b}" for b in buckets if b in there]
    if not paths:
        return None
    rows = spark.read.schema(StructType([schema[key]])).option("basePath", f"{root}/rows")
    return rows.parquet(*paths).select(F.col(key).alias("__stored"))


def _folder(root: str, kind: str, load: Load) -> str:
    return f"{root}/{kind}/writer={load[0]}/batch_id={load[1]}"


def _finished(spark: SparkSession, root: str) -> list[Load]:
    """Batches whose filter is finished, which is written after the rows."""
    loads = [
        (w, int(n))
        for w in folder_names(spark, f"{root}/filter", "writer=")
        for n in folder_names(spark, f"{root}/filter/writer={w}", "batch_id=")
    ]
    return sorted(x for x in loads if path_exists(spark, f"{_folder(root, 'filter', x)}/_SUCCESS"))
