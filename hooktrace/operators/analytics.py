"""Counts, KPIs and reports over the threat table.

Each report is one scan and one aggregate whose partial counts are formed
before the shuffle, so a key that holds a third of all rows sends one partial
row per task like any other key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions.dates import days_before
from hooktrace.functions.fields import present_number, present_text

TOP_COUNTRIES = 15
TOP_BRANDS = 10
TOP_ASNS = 10
OPTION_BRANDS = 100
TIMELINE_DAYS = 30
NEW_DAYS = 7

# Age histogram, upper limit in days and label in display order.
AGE_BUCKETS = ((30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days"), (365, "181-365 days"))
OLDEST_BUCKET = "1+ years"


def counts(rows: DataFrame, **keys: str | Column) -> DataFrame:
    """Row count per key, most frequent first; the key itself breaks ties."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(name) for name, k in keys.items()]
    ties = [F.asc_nulls_first(name) for name in keys]
    return rows.groupBy(*named).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *ties)


def top_counts(rows: DataFrame, limit: int, **keys: str | Column) -> DataFrame:
    """The most frequent keys."""
    return counts(rows, **keys).limit(limit)


def by_source(threats: DataFrame) -> DataFrame:
    return counts(threats.where(F.col("source_feed").isNotNull()), source="source_feed")


def by_source_with_missing(threats: DataFrame) -> DataFrame:
    return counts(threats, source_feed="source_feed")


def by_country(threats: DataFrame) -> DataFrame:
    located = threats.where(F.col("country").isNotNull())
    return top_counts(located, TOP_COUNTRIES, code="country", country="country_name")


def by_country_name(threats: DataFrame) -> DataFrame:
    return counts(threats, country_name="country_name")


def by_threat_type(threats: DataFrame) -> DataFrame:
    return counts(threats.where(F.col("threat_type").isNotNull()), type="threat_type")


def _three_way(flag: str, yes: str, no: str) -> Column:
    return F.when(F.col(flag) == "yes", yes).when(F.col(flag) == "no", no).otherwise("Unknown")


def by_online_status(threats: DataFrame) -> DataFrame:
    return counts(threats, status=_three_way("online", "Online", "Offline"))


def by_tls_status(threats: DataFrame) -> DataFrame:
    return counts(threats, status=_three_way("ssl_enabled", "SSL Enabled", "No SSL"))


def timeline(threats: DataFrame, as_of, days: int = TIMELINE_DAYS) -> DataFrame:
    """Threats per day of first sighting; the boundary day counts in full."""
    start = days_before(as_of, days).cast("date").cast("timestamp_ntz")
    return (
        threats.where(F.col("first_seen") >= start)
        .groupBy(F.col("first_seen").cast("date").cast("string").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("date")
    )


def by_brand(threats: DataFrame) -> DataFrame:
    branded = threats.where(F.col("target_brand").isNotNull())
    return top_counts(branded, TOP_BRANDS, brand="target_brand")


def by_asn(threats: DataFrame) -> DataFrame:
    return top_counts(threats.where(F.col("asn_name").isNotNull()), TOP_ASNS, asn="asn_name")


def by_domain_age(threats: DataFrame, as_of) -> DataFrame:
    """Domain age histogram in bucket order."""
    created = F.col("creation_date")
    place = F.lit(len(AGE_BUCKETS))
    for i, (days, _) in reversed(list(enumerate(AGE_BUCKETS))):
        place = F.when(created >= days_before(as_of, days), i).otherwise(place)
    labels = F.array(*[F.lit(label) for _, label in AGE_BUCKETS], F.lit(OLDEST_BUCKET))
    return (
        threats.where(created.isNotNull())
        .groupBy(place.alias("place"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("place")
        .select(F.get(labels, F.col("place")).alias("age"), "count")
    )


def kpis(threats: DataFrame, as_of) -> DataFrame:
    """Total, new in the last week, online now, and the largest feed, in one scan."""
    per_feed = threats.groupBy("source_feed").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("first_seen") >= days_before(as_of, NEW_DAYS)).alias("fresh"),
        F.count_if(F.col("online") == "yes").alias("live"),
    )
    largest = F.min(
        F.when(
            F.col("source_feed").isNotNull(),
            F.struct((-F.col("rows")).alias("minus_rows"), F.col("source_feed").alias("feed")),
        )
    )
    sums = per_feed.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("fresh"), F.lit(0)).alias("new_7d"),
        F.coalesce(F.sum("live"), F.lit(0)).alias("online"),
        largest.alias("largest"),
    )
    share = lambda part: F.round(F.lit(100.0) * F.col(part) / F.greatest("total", F.lit(1)), 2)
    return sums.select(
        "total",
        "new_7d",
        "online",
        F.coalesce("largest.feed", F.lit("N/A")).alias("top_source"),
        F.coalesce(-F.col("largest.minus_rows"), F.lit(0)).alias("top_source_count"),
        share("new_7d").alias("new_7d_pct"),
        share("online").alias("online_pct"),
    )


def filtered_count(threats: DataFrame) -> DataFrame:
    return threats.agg(F.count(F.lit(1)).alias("total"))


def brand_options(threats: DataFrame) -> DataFrame:
    """The most frequent brands, for a choice list."""
    branded = threats.where(F.col("target_brand").isNotNull())
    return top_counts(branded, OPTION_BRANDS, target_brand="target_brand")


def distinct_options(
    threats: DataFrame, columns: Sequence[str] = ("source_feed", "threat_type", "country")
) -> DataFrame:
    """Distinct non-missing values of the choice lists, in one scan."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("option"), F.col(c).alias("value")) for c in columns]
    )
    return (
        threats.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("option", "value")
    )


def data_quality(enriched: DataFrame) -> DataFrame:
    """How many rows carry an IP, ASN, ISP and country, with shares of all rows."""
    has = {
        "ip": present_text(F.col("ip_address")).isNotNull(),
        "asn": present_number(F.col("asn")).isNotNull(),
        "isp": present_text(F.col("isp")).isNotNull(),
        "country": present_text(F.col("country")).isNotNull(),
    }
    measures = [F.count(F.lit(1)).alias("processed")]
    for name, found in has.items():
        measures += [
            F.count_if(found).alias(f"has_{name}"),
            F.count_if(~found).alias(f"missing_{name}"),
        ]
    measures += [
        F.count_if(~has[name] & has["ip"]).alias(f"missing_{name}_with_ip")
        for name in ("asn", "isp")
    ]
    share = lambda name: F.round(
        F.lit(100.0) * F.col(f"has_{name}") / F.greatest("processed", F.lit(1)), 2
    )
    report = enriched.agg(*measures)
    return report.select("*", *[share(name).alias(f"{name}_pct") for name in has])


def completeness(threats: DataFrame) -> DataFrame:
    """How many rows carry the main enrichment results."""
    return threats.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("ip_address").alias("has_ip"),
        F.count("registrar").alias("has_whois"),
        F.count("country").alias("has_geo"),
        F.count_if(F.col("ssl_enabled") == "yes").alias("has_ssl"),
    )


def feed_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per raw table, and their total."""
    labelled = [t.select(F.lit(name).alias("source")) for name, t in tables.items()]
    rows = labelled[0]
    for more in labelled[1:]:
        rows = rows.unionByName(more)
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    spark = rows.sparkSession
    names = spark.createDataFrame([(name,) for name in tables], "source string")
    per_feed = names.join(found, "source", "left").select(
        "source", F.coalesce("count", F.lit(0)).alias("count")
    )
    total = per_feed.agg(F.sum("count").alias("count")).select(F.lit("total").alias("source"), "count")
    return per_feed.unionByName(total)


def risk_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.min("risk_score").alias("min_score"),
        F.max("risk_score").alias("max_score"),
        F.round(F.avg("risk_score"), 2).alias("avg_score"),
        F.count(F.lit(1)).alias("total_threats"),
    )
