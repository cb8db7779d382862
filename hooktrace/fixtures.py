"""Threat observations, raw tables and snapshot tables derived from the test tables.

Everything is a projection or aggregate of ``events``, ``pages`` and ``nation``,
so the work of a query on it grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hooktrace.functions.urls import base_domain, tld, url_host
from hooktrace.operators.lookups import page_columns
from hooktrace.operators.upsert import one_per_key
from hooktrace.plans.enrichment import Snapshots
from hooktrace.sources.tables import work_list

AS_OF = "2024-02-05 00:00:00"
LOAD_DAY = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, values: list, default=None) -> Column:
    """Value by position; later positions give the default."""
    chosen = F.lit(default)
    for i, value in reversed(list(enumerate(values))):
        chosen = F.when(number == i, F.lit(value)).otherwise(chosen)
    return chosen


# One threat observation per event, as SQL that Spark and other engines read alike.
OBS_SQL = """
SELECT e.event_id AS id,
 replace(p.url, 'example.com', CASE e.user_id % 8 WHEN 0 THEN 'example.zip' WHEN 1 THEN 'vercel.app'
   WHEN 2 THEN 'example.co.uk' WHEN 3 THEN 'bank.xyz' WHEN 4 THEN 'pages.dev' ELSE 'example.com' END)
  || '/' || CASE e.event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'wallet'
   WHEN 'error' THEN 'docs' ELSE e.event_type END || '/' || CAST(e.event_id % 3 AS STRING) AS url,
 p.url AS page_url,
 p.html AS html,
 CASE e.event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'yes'
   WHEN 'error' THEN 'no' END AS online,
 CASE e.event_id % 13 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 401 WHEN 4 THEN 403
   WHEN 5 THEN 404 WHEN 6 THEN 410 WHEN 7 THEN 429 WHEN 8 THEN 500 WHEN 9 THEN 503 WHEN 10 THEN 418 END
   AS http_status_code,
 CASE e.user_id % 3 WHEN 0 THEN 'openphish' WHEN 1 THEN 'phishtank' ELSE 'urlhaus' END AS source_feed,
 CASE WHEN e.user_id % 25 <> 7 THEN n.n_name END AS country_name,
 CASE WHEN e.user_id % 11 <> 0 THEN 64512 + e.user_id % 40 END AS asn,
 CASE WHEN e.event_id % 9 <> 0 THEN CAST(e.user_id % 200 + 11 AS STRING) || '.' ||
   CAST(e.event_id % 200 AS STRING) || '.3.' || CAST(e.event_id % 250 AS STRING) END AS ip_address,
 e.ts AS first_seen,
 e.ts + INTERVAL '1' HOUR * (e.event_id % 200) AS last_seen,
 CASE WHEN e.user_id % 7 <> 0 THEN e.ts - INTERVAL '1' DAY * (e.user_id * 3) END AS creation_date
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_key FROM {events}) e
JOIN {pages} p ON p.page_id = e.page_key
LEFT JOIN {nation} n ON n.n_nationkey = e.user_id % 25"""


def obs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One threat observation per event; ``events`` may be a stream of the same table."""
    tables = {name: table(spark, sf_dir, name) for name in ("events", "pages", "nation")}
    if events is not None:
        tables["events"] = events
    return spark.sql(OBS_SQL, **tables)


def hosted_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).withColumn("domain", url_host(F.col("url")))
    return rows.withColumn("tld", tld(F.col("domain")))


# Observations with the columns the analytics need.
ENR_SQL = """
SELECT o.id, o.url, o.domain, o.tld, o.online, o.http_status_code, o.source_feed, o.country_name,
 o.asn, o.ip_address, o.first_seen, o.last_seen, o.creation_date,
 CASE o.source_feed WHEN 'urlhaus' THEN 'malware' ELSE 'phishing' END AS threat_type,
 CASE WHEN o.source_feed = 'phishtank' AND o.id % 4 <> 0
   THEN 'Brand ' || CAST(o.id % 17 AS STRING) END AS target_brand,
 CASE WHEN o.asn IS NOT NULL THEN 'AS-' || CAST(o.asn AS STRING) END AS asn_name,
 CASE WHEN o.url LIKE 'https:%' THEN 'yes' WHEN o.id % 5 <> 0 THEN 'no' END AS ssl_enabled,
 CASE o.id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'CN' WHEN 3 THEN 'ZZ' WHEN 4 THEN 'RU' END
   AS country,
 CASE WHEN o.ip_address IS NOT NULL THEN CAST(o.id % 180 - 90 AS DOUBLE) END AS latitude,
 CASE WHEN o.ip_address IS NOT NULL THEN CAST(o.id % 360 - 180 AS DOUBLE) END AS longitude,
 CASE WHEN o.id % 3 = 0 THEN 'Registrar ' || CAST(o.id % 5 AS STRING) END AS registrar
FROM {hosted} o"""


def enr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENR_SQL, hosted=hosted_obs(spark, sf_dir))


# Raw tables: each feed's observations in the columns of its raw table. Two of the feeds
# keep one row per URL, the third one row per id.


def raw_line_feed(o: DataFrame) -> DataFrame:
    rows = o.where(F.col("source_feed") == "openphish").select("id", "url", "domain")
    return one_per_key(rows, "url", [F.asc("id")])


def raw_phish_feed(o: DataFrame) -> DataFrame:
    return o.where(F.col("source_feed") == "phishtank").select(
        F.col("id").alias("phish_id"),
        "url",
        "online",
        F.concat(F.lit("Brand "), (F.col("id") % 17).cast("string")).alias("target"),
        "ip_address",
        F.lit(None).cast("string").alias("cidr_block"),
        F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("announcing_network"),
        F.lit(None).cast("string").alias("rir"),
    )


def raw_malware_feed(o: DataFrame) -> DataFrame:
    rows = o.where(F.col("source_feed") == "urlhaus")
    rows = one_per_key(rows.select("id", "url", "online", "asn"), "url", [F.asc("id")])
    return rows.select(
        F.col("id").alias("urlhaus_id"),
        "url",
        F.when(F.col("online") == "no", "malware_download").alias("threat"),
        F.concat_ws(",", F.lit("elf"), "online").alias("tags"),
        "asn",
        F.when(F.col("asn") > 64530, "DE").alias("country"),
    )


def raw_work(o: DataFrame) -> DataFrame:
    return work_list(raw_line_feed(o), raw_phish_feed(o), raw_malware_feed(o))


# Snapshot tables.


def dim_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten /8 blocks per nation; a region of three nations has no country entry."""
    key = F.col("n_nationkey").cast("bigint")
    size = 10 * 2**24
    known = F.col("n_name").isin("NATION_3", "NATION_8", "NATION_13")
    return table(spark, sf_dir, "nation").select(
        (key * size).alias("lo"),
        (key * size + (size - 1)).alias("hi"),
        F.when(~known, F.concat(F.lit("N"), key.cast("string"))).alias("country"),
        F.when(~known, F.col("n_name")).alias("country_name"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("region"),
        F.concat(F.lit("City "), key.cast("string")).alias("city"),
        (key - 12).cast("double").alias("latitude"),
        (key * 5 - 60).cast("double").alias("longitude"),
    )


def dim_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    size = 10 * 2**24
    return table(spark, sf_dir, "nation").select(
        (key * size).alias("lo"),
        (key * size + (size - 1)).alias("hi"),
        F.concat(F.lit("C"), key.cast("string")).alias("country"),
        F.lower("n_name").alias("country_name"),
    )


def dim_asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that start and end inside a block."""
    key = F.col("n_nationkey").cast("bigint")
    size = 10 * 2**24
    return table(spark, sf_dir, "nation").select(
        (key * size + 70_001).alias("lo"),
        (key * size + (size - 1) - 3_333_333).alias("hi"),
        (key + 64512).alias("asn"),
        F.concat(F.lit("AS-"), F.col("n_name")).alias("asn_name"),
    )


def dim_rdap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested CIDR blocks: a /8, a /10 inside, a /16 inside, and a /25 inside."""
    key = F.col("n_nationkey")
    first = (key * 8 + 11).cast("string")
    second = (key + 64).cast("string")
    blocks = F.array(
        F.concat(first, F.lit(".0.0.0/8")),
        F.concat(first, F.lit(".64.0.0/10")),
        F.concat(first, F.lit("."), second, F.lit(".0.0/16")),
        F.concat(first, F.lit("."), second, F.lit(".3.0/25")),
    )
    return table(spark, sf_dir, "nation").select(
        F.explode(blocks).alias("cidr_block"), "n_name", "n_nationkey"
    ).select(
        "cidr_block",
        (F.col("n_nationkey") + 65000).cast("bigint").alias("asn"),
        F.concat(F.lit("RDAP "), F.col("n_name")).alias("asn_name"),
        F.concat(F.lit("NET "), F.col("cidr_block")).alias("isp"),
        F.lit("RD").alias("country"),
    )


def obs_ip6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with IPv6 addresses in several spellings."""
    group, last = F.lower(F.hex(F.col("event_id") % 4096)), F.hex(F.col("event_id") % 65536)
    short = F.concat(F.lit("2001:db8:"), group, F.lit("::"), last)
    full = F.concat(F.lit("2001:0DB8:"), group, F.lit(":0:0:0:0:"), last)
    text = F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 7 == 0, "fe80::1%eth0").otherwise(short)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("ip_address"))


def dim_rdap6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested IPv6 blocks; the widest one is repeated for every nation."""
    key = F.col("n_nationkey").cast("bigint")
    narrow = F.when(key < 16, F.array(
        F.struct(F.concat(F.lit("2001:db8:"), F.lower(F.hex(key)), F.lit("00::/40")).alias("b"), (key + 100).alias("a")),
        F.struct(F.concat(F.lit("2001:DB8:"), F.hex(key * 256 + 7), F.lit("::/47")).alias("b"), (key + 200).alias("a")),
    ))
    wide = F.array(F.struct(F.lit("2001:db8::/32, 10.0.0.0/8").alias("b"), F.lit(1).cast("bigint").alias("a")))
    rows = table(spark, sf_dir, "nation").select(F.explode(F.concat(wide, F.coalesce(narrow, F.slice(wide, 1, 0)))).alias("x"))
    empty = F.lit(None).cast("string")
    return rows.select(
        F.col("x.b").alias("cidr_block"), F.col("x.a").alias("asn"), *[empty.alias(n) for n in ("asn_name", "isp", "country")]
    )


def dim_geo6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges by address text: wide aligned ones, and two unaligned ones inside that overlap."""
    key = F.lower(F.hex("n_nationkey"))
    at = lambda end: F.concat(F.lit("2001:db8:"), key, F.lit(end))
    kinds = [("wide", "00::", "ff:ffff:ffff:ffff:ffff:ffff"), ("middle", "10::", "50::7fff"), ("small", "40::100", "60::")]
    ranges = [F.struct(at(lo).alias("lo"), at(hi).alias("hi"), F.concat(F.lit(n), key).alias("city")) for n, lo, hi in kinds]
    four = F.struct(F.lit("10.0.0.0").alias("lo"), F.lit("10.0.0.9").alias("hi"), F.lit("four").alias("city"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 16")
    rows = nations.select("n_nationkey", F.explode(F.array(*ranges, four)).alias("x"))
    return rows.select(
        "x.lo", "x.hi", F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("country_name"),
        F.lit("six").alias("region"), "x.city", F.col("n_nationkey").cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
    )


def dim_dns(o: DataFrame) -> DataFrame:
    return o.groupBy("domain").agg(F.min("ip_address").alias("ip_address"))


def dim_whois(o: DataFrame) -> DataFrame:
    """Registration data of all registrable domains but those under .net."""
    base = o.select(base_domain(F.col("domain")).alias("base_domain")).distinct()
    length = F.length("base_domain")
    registrar = _pick(length % 4, ["Alpha", "Beta", "Gamma"], "Delta")
    created = F.timestamp_add("DAY", -length, F.lit("2024-01-01").cast("timestamp_ntz"))
    # Two captures of each, the older one with other data. Dates are text, some of them unreadable.
    capture = F.explode(F.array(F.lit("2024-01-01"), F.lit("2023-01-01"))).alias("captured_at")
    old = F.col("captured_at") == "2023-01-01"
    dates = F.when(length % 5 == 0, "before Aug-1996").otherwise(F.date_format(created, "yyyy-MM-dd HH:mm:ss"))
    return base.where(~F.col("base_domain").endswith(".net")).select("base_domain", capture).select(
        "base_domain",
        "captured_at",
        F.array(F.when(old, "Aaa").otherwise(registrar), F.lit("Second")).alias("registrar"),
        dates.alias("creation_date"),
        F.array(
            F.concat(F.lit("ns1."), "base_domain"), F.concat(F.lit("ns2."), "base_domain")
        ).alias("name_servers"),
    )


def whois_history(o: DataFrame) -> DataFrame:
    """Four captures of each registrable domain but those under .net, a week apart, some after every observation."""
    base = o.select(base_domain(F.col("domain")).alias("base_domain")).distinct()
    rows = base.where(~F.col("base_domain").endswith(".net")).withColumn("n", F.explode(F.array(*map(F.lit, range(4)))))
    days = F.length("base_domain") % 9 + F.col("n") * 7
    return rows.select(
        "base_domain",
        F.timestamp_add("DAY", days, F.lit("2024-01-01").cast("timestamp_ntz")).alias("captured_at"),
        F.concat(F.lit("Registrar "), F.col("n").cast("string")).alias("registrar"),
    )


def dim_cert(o: DataFrame) -> DataFrame:
    """Certificates of the domains seen with https."""
    length = F.length("domain")
    expiry = F.timestamp_add("DAY", length, F.lit("2024-01-25 10:20:30").cast("timestamp_ntz"))
    day = F.lpad(F.date_format(expiry, "d"), 2, " ")
    return o.where(F.col("url").startswith("https:")).select("domain").distinct().select(
        "domain",
        F.create_map(
            F.when(length > 16, "organizationName").otherwise("commonName"),
            F.concat(F.lit("CA "), length.cast("string")),
        ).alias("issuer"),
        F.create_map(F.lit("commonName"), F.col("domain")).alias("subject"),
        F.concat(
            F.date_format(expiry, "MMM "), day, F.date_format(expiry, " HH:mm:ss yyyy"), F.lit(" GMT")
        ).alias("cert_valid_to"),
    )


def dim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages with a status, or with the reason why there is none."""
    failed = F.when(F.col("page_id") % 11 == 5, "connection").when(F.col("page_id") % 11 == 6, "timeout")
    status = F.when(failed.isNull(), _pick(F.col("page_id") % 4, [200, 301, 404], 503))
    return table(spark, sf_dir, "pages").select("url", "html", status.alias("status"), failed.alias("failure"))


def dim_page_of_urls(spark: SparkSession, sf_dir: str, o: DataFrame) -> DataFrame:
    """The page behind every observed URL, already cut down to its short columns."""
    short = page_columns(dim_page(spark, sf_dir)).withColumnRenamed("url", "page_url")
    order = [F.asc_nulls_last(c) for c in short.columns if c != "page_url"]
    links = o.groupBy("url").agg(F.min("page_url").alias("page_url"))
    return links.join(one_per_key(short, "page_url", order), "page_url").drop("page_url")


def snapshots(spark: SparkSession, sf_dir: str, o: DataFrame) -> Snapshots:
    return Snapshots(
        dns=dim_dns(o),
        city=dim_geo(spark, sf_dir),
        country=dim_country(spark, sf_dir),
        asn=dim_asn(spark, sf_dir),
        rdap=dim_rdap(spark, sf_dir),
        whois=dim_whois(o),
        certs=dim_cert(o),
        pages=dim_page_of_urls(spark, sf_dir, o),
        probes=dim_probe(o),
    )


def dim_probe(o: DataFrame) -> DataFrame:
    """HEAD probes: the highest status seen for a URL, and why there was none."""
    return o.groupBy("url").agg(
        F.max("http_status_code").alias("status"),
        F.when(F.max("online") == "no", "connection").otherwise("timeout").alias("failure"),
    )


def time_text(rows: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text with microseconds, for comparing with other engines."""
    return rows.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns}
    )


