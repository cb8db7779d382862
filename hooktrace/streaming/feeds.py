"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hooktrace.functions.dates import utc_instant, utc_wall_time
from hooktrace.operators.upsert import dedup_feeds, skip_existing
from hooktrace.plans.enrichment import Snapshots, enrich
from hooktrace.sinks import store
from hooktrace.sources.tables import folder_names, path_exists


def read_drop_folder(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of the files landing in a folder."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def dedup_stream(rows: DataFrame, time_column: str, delay: str, key: str = "url") -> DataFrame:
    """First row per key over micro-batches.

    State for a key is dropped once the watermark has passed it by ``delay``,
    so choose a delay at least as long as keys keep repeating.
    """
    timed = rows.withColumn(time_column, utc_instant(F.col(time_column)))
    return timed.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(
    rows: DataFrame, time_column: str, delay: str | None = None, source: str = "source_feed"
) -> DataFrame:
    """Threats per UTC day and feed; the time column is a ``TIMESTAMP_NTZ`` in UTC.

    With ``delay`` a watermark bounds the state and append mode is possible;
    without one use complete mode.
    """
    timed = rows.withColumn(time_column, utc_instant(F.col(time_column)))
    if delay:
        timed = timed.withWatermark(time_column, delay)
    counted = timed.groupBy(F.window(time_column, "1 day").alias("day"), F.col(source)).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select(
        utc_wall_time(F.col("day.start")).cast("date").cast("string").alias("date"), source, "count"
    )


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now into a Parquet folder (append mode), then stop."""
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def run_available_complete(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now; each batch writes the whole result to ``<path>/version=<batch>``.

    Folders that readers have open are never replaced; ``read_newest`` reads the last finished one.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return run_batches(rows, replace, checkpoint, "complete")


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished result of ``run_available_complete``."""
    done = [int(v) for v in folder_names(spark, path, "version=") if path_exists(spark, f"{path}/version={v}/_SUCCESS")]
    return spark.read.parquet(f"{path}/version={max(done)}")


def run_batches(
    rows: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
) -> StreamingQuery:
    query = (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def enrich_stream(
    work: DataFrame,
    snapshots: Snapshots,
    root: str,
    checkpoint: str,
    as_of,
    skip_stored: bool = True,
    **options,
) -> StreamingQuery:
    """Enrich each micro-batch of a work list and append it to the stored threat table.

    A load is named by the checkpoint and the batch number: a batch that runs again after a
    failure replaces its own rows, and a stream that starts anew with another checkpoint
    writes loads of its own. Stored URLs are scanned in the buckets that the batch has.
    """
    writer = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = dedup_feeds(batch)
        if skip_stored:
            # Loads before this one only: a batch that runs again must see the same table.
            stored = store.stored_urls(spark, root, before=(writer, batch_id))
            marked = fresh.withColumn("__bucket", store.bucket_of(F.xxhash64("url")))
            buckets = [r[0] for r in marked.select("__bucket").distinct().collect()]  # at most BUCKETS
            fresh = skip_existing(fresh, stored.where(F.col("bucket").isin(buckets)).select("url"))
        store.append_batch(enrich(fresh, snapshots, as_of, **options), root, batch_id, writer, retry=True)

    return run_batches(work, load, checkpoint)
