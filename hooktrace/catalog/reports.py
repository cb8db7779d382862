"""Count, KPI and quality report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import AS_OF_SQL, query
from hooktrace.functions.fields import isp_name
from hooktrace.operators import analytics
from hooktrace.operators.screening import campaign_components as linked
from hooktrace.operators.screening import campaigns as grouped
from hooktrace.operators.screening import screen_urls as screened
from hooktrace.plans.enrichment import with_score


@query(
    "by_source",
    "SELECT source_feed AS source, count(*) AS count FROM enr WHERE source_feed IS NOT NULL GROUP BY ALL",
)
def by_source(spark, sf_dir):
    return analytics.by_source(fx.enr(spark, sf_dir))


@query("by_source_all", "SELECT source_feed, count(*) AS count FROM enr GROUP BY ALL")
def by_source_all(spark, sf_dir):
    return analytics.by_source_with_missing(fx.enr(spark, sf_dir))


@query(
    "by_country",
    """
SELECT country AS code, country_name AS country, count(*) AS count FROM enr e WHERE e.country IS NOT NULL
GROUP BY e.country, e.country_name
ORDER BY count DESC, e.country ASC NULLS FIRST, e.country_name ASC NULLS FIRST LIMIT 15""",
)
def by_country(spark, sf_dir):
    return analytics.by_country(fx.enr(spark, sf_dir))


@query("by_country_name", "SELECT country_name, count(*) AS count FROM enr GROUP BY ALL")
def by_country_name(spark, sf_dir):
    return analytics.by_country_name(fx.enr(spark, sf_dir))


@query("by_type", "SELECT threat_type AS type, count(*) AS count FROM enr WHERE threat_type IS NOT NULL GROUP BY ALL")
def by_type(spark, sf_dir):
    return analytics.by_threat_type(fx.enr(spark, sf_dir))


@query(
    "by_status",
    """
SELECT CASE online WHEN 'yes' THEN 'Online' WHEN 'no' THEN 'Offline' ELSE 'Unknown' END AS status,
 count(*) AS count FROM enr GROUP BY 1""",
)
def by_status(spark, sf_dir):
    return analytics.by_online_status(fx.enr(spark, sf_dir))


@query(
    "by_ssl",
    """
SELECT CASE ssl_enabled WHEN 'yes' THEN 'SSL Enabled' WHEN 'no' THEN 'No SSL' ELSE 'Unknown' END AS status,
 count(*) AS count FROM enr GROUP BY 1""",
)
def by_ssl(spark, sf_dir):
    return analytics.by_tls_status(fx.enr(spark, sf_dir))


@query(
    "timeline",
    """
SELECT strftime(first_seen, '%Y-%m-%d') AS date, count(*) AS count FROM enr
WHERE first_seen >= TIMESTAMP '2024-01-06 00:00:00' GROUP BY 1""",
)
def timeline(spark, sf_dir):
    return analytics.timeline(fx.enr(spark, sf_dir), fx.AS_OF)


@query(
    "by_brand",
    """
SELECT target_brand AS brand, count(*) AS count FROM enr WHERE target_brand IS NOT NULL
GROUP BY 1 ORDER BY count DESC, brand LIMIT 10""",
)
def by_brand(spark, sf_dir):
    return analytics.by_brand(fx.enr(spark, sf_dir))


@query(
    "by_asn",
    """
SELECT e.asn_name AS asn, count(*) AS count FROM enr e WHERE e.asn_name IS NOT NULL
GROUP BY e.asn_name ORDER BY count DESC, e.asn_name LIMIT 10""",
)
def by_asn(spark, sf_dir):
    return analytics.by_asn(fx.enr(spark, sf_dir))


@query(
    "by_age",
    """
SELECT CASE WHEN age_days <= 30 THEN '0-30 days' WHEN age_days <= 90 THEN '31-90 days'
 WHEN age_days <= 180 THEN '91-180 days' WHEN age_days <= 365 THEN '181-365 days' ELSE '1+ years' END AS age,
 count(*) AS count FROM scored WHERE creation_date IS NOT NULL GROUP BY 1""",
)
def by_age(spark, sf_dir):
    return analytics.by_domain_age(fx.enr(spark, sf_dir), fx.AS_OF)


@query(
    "kpi",
    f"""
WITH t AS (SELECT count(*) AS total, count(*) FILTER (first_seen >= {AS_OF_SQL} - INTERVAL '7' DAY) AS new_7d,
 count(*) FILTER (online = 'yes') AS online FROM enr),
s AS (SELECT source_feed AS top_source, count(*) AS top_source_count FROM enr WHERE source_feed IS NOT NULL
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT total, new_7d, online, top_source, top_source_count,
 round(100.0 * new_7d / greatest(total, 1), 2) AS new_7d_pct,
 round(100.0 * online / greatest(total, 1), 2) AS online_pct
FROM t CROSS JOIN s""",
)
def kpi(spark, sf_dir):
    return analytics.kpis(fx.enr(spark, sf_dir), fx.AS_OF)


def _quality_sql() -> str:
    tests = {
        "ip": "nullif(ip_address, '') IS NOT NULL", "asn": "nullif(asn, 0) IS NOT NULL",
        "isp": "nullif(isp, '') IS NOT NULL", "country": "nullif(country, '') IS NOT NULL",
    }
    parts = ["count(*) AS processed"]
    for name, test in tests.items():
        parts.append(f"count(*) FILTER ({test}) AS has_{name}")
        parts.append(f"count(*) FILTER (NOT ({test})) AS missing_{name}")
        parts.append(f"round(100.0 * count(*) FILTER ({test}) / greatest(count(*), 1), 2) AS {name}_pct")
    for name in ("asn", "isp"):
        parts.append(f"count(*) FILTER (NOT ({tests[name]}) AND {tests['ip']}) AS missing_{name}_with_ip")
    return (
        f"SELECT {', '.join(parts)} FROM "
        "(SELECT *, CASE WHEN online = 'no' THEN '' ELSE coalesce(registrar, asn_name) END AS isp FROM enr)"
    )


@query("data_quality", _quality_sql())
def data_quality(spark, sf_dir):
    rows = fx.enr(spark, sf_dir)
    isp = F.when(F.col("online") == "no", "").otherwise(isp_name(F.col("registrar"), F.col("asn_name")))
    return analytics.data_quality(rows.withColumn("isp", isp))


@query(
    "completeness",
    """
SELECT count(*) AS total, count(ip_address) AS has_ip, count(registrar) AS has_whois, count(country) AS has_geo,
 count(*) FILTER (ssl_enabled = 'yes') AS has_ssl FROM enr""",
)
def completeness(spark, sf_dir):
    return analytics.completeness(fx.enr(spark, sf_dir))


@query(
    "feed_counts",
    """
SELECT source_feed AS source, count(*) AS count FROM raw_work GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM raw_work""",
)
def feed_counts(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    return analytics.feed_counts(
        {
            "openphish": fx.raw_line_feed(rows),
            "phishtank": fx.raw_phish_feed(rows),
            "urlhaus": fx.raw_malware_feed(rows),
        }
    )


@query(
    "screen_urls",
    """
WITH threats AS (SELECT s.url, s.domain, s.site, coalesce(t.risk_score, 50) AS risk_score FROM sites s LEFT JOIN scored t ON t.id = s.id
 WHERE s.first_seen < TIMESTAMP '2024-01-15 00:00:00'),
u AS (SELECT url, max(risk_score) AS s FROM threats GROUP BY 1),
d AS (SELECT domain, max(risk_score) AS s FROM threats GROUP BY 1),
b AS (SELECT site, max(risk_score) AS s FROM threats GROUP BY 1)
SELECT o.id, CASE WHEN u.s IS NOT NULL THEN 'url' WHEN d.s IS NOT NULL THEN 'domain'
 WHEN b.s IS NOT NULL THEN 'base_domain' END AS match_level, coalesce(u.s, d.s, b.s) AS match_score
FROM (SELECT * FROM sites WHERE first_seen IS NULL OR first_seen >= TIMESTAMP '2024-01-15 00:00:00') o
LEFT JOIN u ON u.url = o.url LEFT JOIN d ON d.domain = o.domain LEFT JOIN b ON b.site = o.site""",
)
def screen_urls(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    early = F.col("first_seen") < F.lit(fx.LOAD_DAY).cast("timestamp_ntz")
    by_address = rows.where("ip_address is not null").select(
        (F.col("id") + 1_000_000_000).alias("id"),
        F.concat(F.lit("http://"), "ip_address", F.lit("/"), (F.col("id") % 2).cast("string")).alias("url"),
        "first_seen",
    )
    threats = with_score(rows.where(early), fx.AS_OF).select("url", "risk_score")
    threats = threats.unionByName(by_address.where(early).select("url", F.lit(50).alias("risk_score")))
    observed = (
        rows.select("id", F.col("page_url").alias("url"))
        .unionByName(rows.where(~early).select("id", "url"))
        .unionByName(by_address.where(~early).select("id", "url"))
    )
    return screened(observed, threats).select("id", "match_level", "match_score")


@query(
    "campaigns",
    """
SELECT s.site AS base_domain, count(*) AS sightings, count(DISTINCT h.url) AS urls, count(DISTINCT h.source_feed) AS feeds,
 count(DISTINCT e.target_brand) AS brands, count(DISTINCT h.ip_address) AS ips,
 strftime(min(h.first_seen), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
 strftime(max(h.last_seen), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, max(h.risk_score) AS max_score
FROM scored h JOIN enr e ON e.id = h.id JOIN (SELECT DISTINCT domain, site FROM sites) s ON s.domain = h.domain GROUP BY s.site""",
)
def campaigns(spark, sf_dir):
    threats = with_score(fx.enr(spark, sf_dir), fx.AS_OF)
    return fx.time_text(grouped(threats), "first_seen", "last_seen")


@query(
    "campaigns_by_ip",
    """
SELECT h.ip_address, count(*) AS sightings, count(DISTINCT h.url) AS urls, count(DISTINCT h.source_feed) AS feeds,
 count(DISTINCT e.target_brand) AS brands, count(DISTINCT h.ip_address) AS ips,
 strftime(min(h.first_seen), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
 strftime(max(h.last_seen), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, max(h.risk_score) AS max_score
FROM scored h JOIN enr e ON e.id = h.id WHERE h.ip_address IS NOT NULL GROUP BY h.ip_address""",
)
def campaigns_by_ip(spark, sf_dir):
    threats = with_score(fx.enr(spark, sf_dir), fx.AS_OF)
    return fx.time_text(grouped(threats, by="ip_address"), "first_seen", "last_seen")


@query(
    "campaigns_by_asn_brand",
    """
SELECT e.asn, e.target_brand, count(*) AS sightings, count(DISTINCT h.url) AS urls,
 count(DISTINCT h.source_feed) AS feeds, count(DISTINCT e.target_brand) AS brands, count(DISTINCT h.ip_address) AS ips,
 strftime(min(h.first_seen), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
 strftime(max(h.last_seen), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, max(h.risk_score) AS max_score
FROM scored h JOIN enr e ON e.id = h.id WHERE e.asn IS NOT NULL AND e.target_brand IS NOT NULL
GROUP BY e.asn, e.target_brand""",
)
def campaigns_by_asn_brand(spark, sf_dir):
    threats = with_score(fx.enr(spark, sf_dir), fx.AS_OF)
    return fx.time_text(grouped(threats, by="asn_brand"), "first_seen", "last_seen")


@query(
    "campaign_components",
    """
WITH RECURSIVE h AS (SELECT h.*, s.site, 'i:' || h.ip_address AS address,
  'b:' || CAST(e.asn AS VARCHAR) || ':' || e.target_brand AS aimed
 FROM scored h JOIN enr e ON e.id = h.id JOIN (SELECT DISTINCT domain, site FROM sites) s ON s.domain = h.domain),
k AS (SELECT site, address AS name FROM h WHERE address IS NOT NULL UNION SELECT site, aimed FROM h WHERE aimed IS NOT NULL
 UNION SELECT site, 's:' || site FROM h),
e AS (SELECT DISTINCT a.site AS x, b.site AS y FROM k a JOIN k b USING (name) WHERE a.site <> b.site),
r(site, reach) AS (SELECT DISTINCT site, site FROM h UNION SELECT r.site, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT site, min(reach) AS head FROM r GROUP BY site),
n AS (SELECT c.head, min(k.name) AS campaign FROM k JOIN c USING (site) GROUP BY c.head)
SELECT n.campaign, count(*) AS sightings, count(DISTINCT h.url) AS urls, count(DISTINCT h.site) AS sites,
 count(DISTINCT h.ip_address) AS ips, strftime(min(h.first_seen), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
 strftime(max(h.last_seen), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, max(h.risk_score) AS max_score
FROM h JOIN c USING (site) JOIN n ON n.head = c.head GROUP BY n.campaign""",
)
def campaign_components(spark, sf_dir):
    """Campaigns by what sites, addresses, networks and brands have in common, over any number of steps."""
    threats = with_score(fx.enr(spark, sf_dir), fx.AS_OF)
    return fx.time_text(linked(threats), "first_seen", "last_seen")
