"""Queries whose result is the finished sink table of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import query
from hooktrace.plans.enrichment import Snapshots
from hooktrace.sinks import store
from hooktrace.sinks.shared import shared_folder, staged
from hooktrace.streaming import dedup, feeds

# Longer than any span of test events: each URL is kept for the whole stream.
_DELAY = "400 days"


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    # As a glob the path may be a single file as well as a folder.
    return feeds.read_drop_folder(spark, f"{sf_dir}/events.parque[t]", schema)


@query("stream_dedup", "SELECT DISTINCT url FROM obs")
def stream_dedup(spark, sf_dir):
    rows = fx.obs(spark, sf_dir, _event_stream(spark, sf_dir)).select("url", "first_seen")
    out = shared_folder(spark, "stream-dedup")
    feeds.run_available(feeds.dedup_stream(rows, "first_seen", _DELAY), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("url")


@query("stream_dedup_store", "SELECT DISTINCT url FROM obs")
def stream_dedup_store(spark, sf_dir):
    """Two streams, one after the other, into one table of first rows; the second brings every row again."""
    rows = fx.obs(spark, sf_dir, fx.table(spark, sf_dir, "events")).select("url", "first_seen", "source_feed")
    out = shared_folder(spark, "stream-dedup")
    for name, part in (("early", rows.where("first_seen < '2024-01-12'")), ("all", rows)):
        part.repartition(2).write.parquet(f"{out}/{name}")
        stream = feeds.read_drop_folder(spark, f"{out}/{name}", rows.schema, files_per_batch=1)
        dedup.dedup_into(stream.select(*rows.columns), f"{out}/table", f"{out}/state-{name}", "first_seen")
    return dedup.read_rows(spark, f"{out}/table", rows.schema).select("url")


@query(
    "stream_daily",
    """
SELECT strftime(first_seen, '%Y-%m-%d') AS date, source_feed, count(*) AS count FROM obs GROUP BY 1, 2""",
)
def stream_daily(spark, sf_dir):
    rows = fx.obs(spark, sf_dir, _event_stream(spark, sf_dir)).select("first_seen", "source_feed")
    out = shared_folder(spark, "stream-daily")
    feeds.run_available_complete(feeds.daily_counts(rows, "first_seen"), f"{out}/rows", f"{out}/state")
    return feeds.read_newest(spark, f"{out}/rows").select("date", "source_feed", F.col("count"))


@query(
    "stream_enrich",
    """
SELECT DISTINCT h.url, h.domain, h.tld, g.country_name FROM hosted h JOIN (
 SELECT url, max_by(source_feed, feed_rank) AS feed FROM raw_work GROUP BY url) w ON w.url = h.url
LEFT JOIN (SELECT domain, dns_ip, CAST(split_part(dns_ip, '.', 1) AS BIGINT) * 16777216 AS ip FROM dim_dns) d
 ON d.domain = h.domain LEFT JOIN dim_geo g ON d.ip BETWEEN g.lo AND g.hi""",
)
def stream_enrich(spark, sf_dir):
    """A work list enriched batch by batch into the stored table; what is stored is skipped."""
    rows = staged(fx.hosted_obs(spark, sf_dir).drop("html"), "observations")
    # Without addresses of their own, URLs take that of their domain, whichever feed came first.
    work = fx.raw_work(rows).withColumn("ip_address", F.lit(None).cast("string"))
    out = shared_folder(spark, "stream-enrich")
    work.repartition(3).write.parquet(f"{out}/drop")
    stream = feeds.read_drop_folder(spark, f"{out}/drop", work.schema, files_per_batch=1)
    snapshots = Snapshots(dns=fx.dim_dns(rows), city=fx.dim_geo(spark, sf_dir))
    feeds.enrich_stream(stream, snapshots, f"{out}/threats", f"{out}/state", fx.AS_OF)
    stored = store.current(spark, f"{out}/threats")
    return stored.select("url", "domain", "tld", F.col("country_name"))
