"""Feed loads into the raw tables and the run from raw tables to the threat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hooktrace.operators.upsert import dedup_feeds, skip_existing, upsert_ignore, upsert_update
from hooktrace.plans.enrichment import Snapshots, enrich
from hooktrace.schemas import RAW_LINE_FEED, RAW_MALWARE_FEED, RAW_PHISH_FEED
from hooktrace.sources.feeds import stamped
from hooktrace.sources.tables import conform, work_list


def load_line_feed(raw: DataFrame, feed: DataFrame, as_of) -> DataFrame:
    """Raw line-feed table with the new URLs of a feed added."""
    rows = stamped(feed.withColumn("id", F.xxhash64("url")), "added_at", as_of)
    return upsert_ignore(raw, conform(rows, RAW_LINE_FEED), "url", [F.asc_nulls_last("domain")])


def load_phish_feed(raw: DataFrame, mapped: DataFrame, as_of) -> DataFrame:
    """Raw table with known ids updated and new ids added; the load time of known ids stays."""
    rows = conform(stamped(mapped, "inserted_at", as_of), RAW_PHISH_FEED)
    latest = [F.desc_nulls_last("verification_time"), F.desc_nulls_last("submission_time"), F.desc("url")]
    return upsert_update(raw, rows.where(F.col("url").isNotNull()), "phish_id", latest, "inserted_at")


def load_malware_feed(raw: DataFrame, mapped: DataFrame, as_of) -> DataFrame:
    """Raw table with the new URLs of a feed added, the earliest listed one winning."""
    rows = stamped(mapped.withColumn("urlhaus_id", F.xxhash64("url")), "inserted_at", as_of)
    order = [F.asc_nulls_last("url_dateadded"), F.asc_nulls_last("threat"), F.asc_nulls_last("tags")]
    return upsert_ignore(raw, conform(rows, RAW_MALWARE_FEED), "url", order)


def enrich_feeds(
    raw: dict[str, DataFrame],
    snapshots: Snapshots,
    as_of,
    enriched: DataFrame | None = None,
    source: str | None = None,
    **options,
) -> DataFrame:
    """Enriched rows for the raw tables (line_feed, phish_feed, malware_feed).

    With ``enriched`` URLs already stored are skipped; ``source`` keeps one feed.
    """
    work = work_list(**raw)
    if source is not None:
        work = work.where(F.col("source_feed") == source)
    work = dedup_feeds(work)
    if enriched is not None:
        work = skip_existing(work, enriched)
    return enrich(work, snapshots, as_of, **options)
