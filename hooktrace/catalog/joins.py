"""Snapshot lookups and the full enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import AS_OF_SQL, query
from hooktrace.operators import lookups
from hooktrace.operators.upsert import dedup_feeds, skip_existing, with_exists_flag
from hooktrace.plans.enrichment import enrich
from hooktrace.sinks.shared import staged


@query(
    "join_dns",
    "SELECT h.id, coalesce(h.ip_address, d.dns_ip) AS ip_address FROM hosted h LEFT JOIN dim_dns d USING (domain)",
)
def join_dns(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    facts = rows.select("id", "domain", "ip_address")
    return lookups.join_dns(facts, fx.dim_dns(rows), F.col("id")).select("id", "ip_address")


def _by_ip(spark, sf_dir, **tables):
    facts = fx.obs(spark, sf_dir).select("id", "ip_address")
    resolved = lookups.resolve_ips(lookups.distinct_ips(facts.select("ip_address")), **tables)
    return lookups.join_ip(facts, resolved, F.col("id"))


@query(
    "join_geo_range",
    """
SELECT o.id, g.country, g.country_name, g.region, g.city, g.latitude, g.longitude
FROM obs_ip o LEFT JOIN dim_geo g ON o.ip BETWEEN g.lo AND g.hi""",
)
def join_geo_range(spark, sf_dir):
    joined = _by_ip(spark, sf_dir, city=fx.dim_geo(spark, sf_dir))
    names = ("country", "country_name", "region", "city", "latitude", "longitude")
    return joined.select("id", *[F.col(f"geo_{n}").alias(n) for n in names])


@query(
    "join_geo_fallback",
    """
SELECT o.id, CASE WHEN g.country IS NULL AND n.n_name IS NOT NULL
  THEN 'C' || CAST(n.n_nationkey AS VARCHAR) ELSE g.country END AS country,
 CASE WHEN g.country IS NULL THEN lower(n.n_name) ELSE g.country_name END AS country_name, g.city
FROM obs_ip o LEFT JOIN dim_geo g ON o.ip BETWEEN g.lo AND g.hi
LEFT JOIN nation n ON o.ip // 167772160 = n.n_nationkey""",
)
def join_geo_fallback(spark, sf_dir):
    joined = _by_ip(
        spark, sf_dir, city=fx.dim_geo(spark, sf_dir), country=fx.dim_country(spark, sf_dir)
    )
    return joined.select("id", *[F.col(f"geo_{n}").alias(n) for n in ("country", "country_name", "city")])


@query(
    "join_asn_range",
    "SELECT o.id, a.asn, a.asn_name FROM obs_ip o LEFT JOIN dim_asn a ON o.ip BETWEEN a.lo AND a.hi",
)
def join_asn_range(spark, sf_dir):
    joined = _by_ip(spark, sf_dir, asn=fx.dim_asn(spark, sf_dir))
    return joined.select("id", F.col("geo_asn").alias("asn"), F.col("geo_asn_name").alias("asn_name"))


@query(
    "join_rdap_cidr",
    """
SELECT o.id, r.cidr_block, r.asn, r.isp FROM obs_ip o
LEFT JOIN dim_rdap r ON o.ip >= r.lo AND o.ip < r.lo + CAST(pow(2, 32 - r.bits) AS BIGINT)
QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY r.bits DESC) = 1""",
)
def join_rdap_cidr(spark, sf_dir):
    joined = _by_ip(spark, sf_dir, rdap=fx.dim_rdap(spark, sf_dir))
    return joined.select("id", *[F.col(f"rdap_{n}").alias(n) for n in ("cidr_block", "asn", "isp")])


@query(
    "join_ip6_range",
    """
SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN NULL
 WHEN g // 2 = (g // 256 * 256 + 7) // 2 THEN '2001:DB8:' || upper(printf('%x', g // 256 * 256 + 7)) || '::/47'
 ELSE '2001:db8:' || printf('%x', g // 256) || '00::/40' END AS cidr_block,
 CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN NULL
 WHEN g // 2 = (g // 256 * 256 + 7) // 2 THEN g // 256 + 200 ELSE g // 256 + 100 END AS asn
FROM (SELECT event_id, event_id % 4096 AS g FROM events)""",
)
def join_ip6_range(spark, sf_dir):
    """Longest IPv6 prefix by address, blocks nested and repeated."""
    facts = fx.obs_ip6(spark, sf_dir)
    resolved = lookups.resolve_ips(
        lookups.distinct_ips(facts.select("ip_address")), rdap=fx.dim_rdap6(spark, sf_dir)
    )
    joined = lookups.join_ip(facts, resolved, F.col("id"))
    return joined.select("id", F.col("rdap_cidr_block").alias("cidr_block"), F.col("rdap_asn").alias("asn"))


@query(
    "join_ip6_lo_hi",
    """
WITH place AS (SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 7 <> 0
  THEN event_id % 4096 * 65536 + event_id % 65536 END AS ip FROM events),
part AS (SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) * 256 AS g FROM nation WHERE n_nationkey < 16),
net AS (SELECT 'wide' || printf('%x', k) AS city, k, g * 65536 AS lo, (g + 255) * 65536 + 65535 AS hi FROM part
 UNION ALL SELECT 'middle' || printf('%x', k), k, (g + 16) * 65536, (g + 80) * 65536 + 32767 FROM part
 UNION ALL SELECT 'small' || printf('%x', k), k, (g + 64) * 65536 + 256, (g + 96) * 65536 FROM part)
SELECT event_id AS id, city, CAST(k AS DOUBLE) AS latitude FROM place LEFT JOIN net ON ip BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY hi - lo) = 1""",
)
def join_ip6_lo_hi(spark, sf_dir):
    """Narrowest range by address text, ranges nested, overlapping and not aligned."""
    facts = fx.obs_ip6(spark, sf_dir)
    resolved = lookups.resolve_ips(lookups.distinct_ips(facts.select("ip_address")), city=fx.dim_geo6(spark, sf_dir))
    joined = lookups.join_ip(facts, resolved, F.col("id"))
    return joined.select("id", F.col("geo_city").alias("city"), F.col("geo_latitude").alias("latitude"))


@query(
    "join_whois",
    """
SELECT h.id, w.registrar, strftime(w.whois_created, '%Y-%m-%d') AS creation_date, w.name_servers
FROM hosted h LEFT JOIN dim_whois w USING (base_domain)""",
)
def join_whois(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    joined = lookups.join_whois(rows.select("id", "domain"), fx.dim_whois(rows), F.col("id"))
    return joined.select(
        "id", "registrar", F.date_format("creation_date", "yyyy-MM-dd").alias("creation_date"), "name_servers"
    )


@query(
    "join_whois_as_of",
    """
WITH history AS (SELECT base_domain, 'Registrar ' || CAST(n AS VARCHAR) AS registrar,
  TIMESTAMP '2024-01-01' + INTERVAL '1' DAY * (length(base_domain) % 9 + 7 * n) AS captured_at
 FROM (SELECT DISTINCT base_domain FROM hosted WHERE base_domain NOT LIKE '%.net'), (SELECT unnest([0, 1, 2, 3]) AS n))
SELECT h.id, w.registrar FROM hosted h ASOF LEFT JOIN history w
 ON h.base_domain = w.base_domain AND h.first_seen >= w.captured_at""",
)
def join_whois_as_of(spark, sf_dir):
    """What WHOIS said when the URL was first seen, not what it says now."""
    rows = fx.hosted_obs(spark, sf_dir)
    facts = rows.select("id", "domain", "first_seen")
    joined = lookups.join_whois(facts, fx.whois_history(rows), F.col("id"), at="first_seen")
    return joined.select("id", "registrar")


@query(
    "join_cert",
    """
SELECT h.id, CASE WHEN c.domain IS NULL THEN 'no' ELSE 'yes' END AS ssl_enabled, c.cert_issuer, c.cert_subject,
 c.cert_valid_to FROM hosted h LEFT JOIN dim_cert c USING (domain)""",
)
def join_cert(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir)
    joined = lookups.join_cert(rows.select("id", "domain"), fx.dim_cert(rows), F.col("id"))
    return joined.select("id", "ssl_enabled", "cert_issuer", "cert_subject", "cert_valid_to")


@query(
    "join_page",
    """
SELECT o.id, p.page_status, CASE WHEN p.page_status < 400 THEN 'yes' WHEN p.page_status IS NULL AND p.failure = 'timeout'
 THEN 'unknown' ELSE 'no' END AS page_online, p.page_title,
 p.page_language FROM obs o LEFT JOIN dim_page p ON p.url = o.page_url""",
)
def join_page(spark, sf_dir):
    facts = fx.obs(spark, sf_dir).select("id", F.col("page_url").alias("url"))
    joined = lookups.join_page(facts, fx.dim_page(spark, sf_dir), F.col("id"))
    return joined.select("id", "page_status", "page_online", "page_title", "page_language")


def _stored(spark, sf_dir):
    """URLs seen before the load day count as stored."""
    early = F.col("first_seen") < F.lit(fx.LOAD_DAY).cast("timestamp_ntz")
    return fx.obs(spark, sf_dir).where(early).select("url")


_STORED_SQL = "(SELECT url FROM obs WHERE first_seen < TIMESTAMP '2024-01-15 00:00:00')"


@query(
    "skip_existing",
    f"SELECT url, source_feed, source_id FROM raw_work WHERE url NOT IN {_STORED_SQL}",
)
def skip_known(spark, sf_dir):
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    fresh = skip_existing(work, _stored(spark, sf_dir), spread=F.struct(*work.columns))
    return fresh.select("url", "source_feed", "source_id")


@query(
    "exists_flag",
    f"SELECT url, source_feed, source_id, url IN {_STORED_SQL} AS is_enriched FROM raw_work",
)
def exists_flag(spark, sf_dir):
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    marked = with_exists_flag(work, _stored(spark, sf_dir), spread=F.struct(*work.columns))
    return marked.select("url", "source_feed", "source_id", "is_enriched")


_NAMES_SQL = (
    "CASE country WHEN 'US' THEN 'United States' WHEN 'CN' THEN 'China' WHEN 'RU' THEN 'Russia' "
    "WHEN 'DE' THEN 'Germany' ELSE country END"
)

ENRICHED_COLUMNS = (
    "url", "domain", "online", "http_status_code", "ip_address", "cidr_block", "asn", "asn_name",
    "isp", "country", "country_name", "region", "city", "latitude", "longitude", "ssl_enabled",
    "cert_issuer", "cert_subject", "cert_valid_to", "tld", "registrar", "creation_date",
    "name_servers", "page_language", "page_title", "threat_type", "target_brand", "threat_tags",
    "source_feed", "source_id", "risk_score",
)

_ENRICH_SQL = f"""
WITH work AS (SELECT * FROM raw_work QUALIFY row_number() OVER
  (PARTITION BY url ORDER BY feed_rank DESC, CAST(source_id AS BIGINT) DESC NULLS LAST) = 1),
probe AS (SELECT url, max(http_status_code) AS head_status, max(online) AS seen_online,
  min(page_url) AS link FROM obs GROUP BY url),
a AS (SELECT w.*, coalesce(nullif(w.ip_address, ''), d.dns_ip) AS final_ip, p.*  EXCLUDE (url), q.* EXCLUDE (url),
  wh.* EXCLUDE (base_domain), c.* EXCLUDE (domain), CASE WHEN c.domain IS NULL THEN 'no' ELSE 'yes' END AS ssl_enabled
 FROM work w LEFT JOIN dim_dns d USING (domain) LEFT JOIN probe p ON p.url = w.url
 LEFT JOIN dim_page q ON q.url = p.link LEFT JOIN dim_whois wh ON wh.base_domain = w.base_domain
 LEFT JOIN dim_cert c ON c.domain = w.domain),
b AS (SELECT *, CASE WHEN final_ip IS NOT NULL THEN
  CAST(split_part(final_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(final_ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(final_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(final_ip, '.', 4) AS BIGINT) END AS ip FROM a),
e AS (SELECT b.*, g.country AS g_country, g.country_name AS g_name, g.region, g.city, g.latitude, g.longitude,
  n.n_nationkey AS fallback_key, n.n_name AS fallback_name, s.asn AS g_asn, s.asn_name AS g_asn_name,
  r.cidr_block, r.asn AS r_asn, r.asn_name AS r_asn_name, r.isp AS r_isp
 FROM b LEFT JOIN dim_geo g ON b.ip BETWEEN g.lo AND g.hi LEFT JOIN nation n ON b.ip // 167772160 = n.n_nationkey
 LEFT JOIN dim_asn s ON b.ip BETWEEN s.lo AND s.hi
 LEFT JOIN dim_rdap r ON b.ip >= r.lo AND b.ip < r.lo + CAST(pow(2, 32 - r.bits) AS BIGINT)
 QUALIFY row_number() OVER (PARTITION BY b.url ORDER BY r.bits DESC NULLS LAST) = 1),
f AS (SELECT e.* EXCLUDE (online, country, asn, page_language),
 coalesce(online, CASE WHEN head_status IS NOT NULL THEN 'yes' WHEN seen_online = 'no' THEN 'no' ELSE 'unknown' END)
  AS online,
 CASE WHEN online IS NULL THEN coalesce(head_status, page_status) ELSE page_status END AS http_status_code,
 coalesce(nullif(asn, 0), g_asn, r_asn) AS asn, coalesce(g_asn_name, r_asn_name) AS asn_name,
 coalesce(r_isp, g_asn_name, r_asn_name) AS isp,
 CASE WHEN g_country IS NULL THEN lower(fallback_name) ELSE g_name END AS geo_name,
 coalesce(country, g_country, 'C' || CAST(fallback_key AS VARCHAR), CASE WHEN r_asn IS NOT NULL THEN 'RD' END) AS country,
 coalesce(page_language, CASE WHEN regexp_matches(lower(page_title), 'sign|login|account|verify|update|security')
  THEN 'en' WHEN regexp_matches(lower(page_title), 'iniciar|cuenta|verificar|actualizar') THEN 'es'
  WHEN regexp_matches(lower(page_title), 'connexion|compte|vérifier|mettre') THEN 'fr'
  WHEN regexp_matches(lower(page_title), 'anmelden|konto|überprüfen|aktualisieren') THEN 'de'
  WHEN regexp_matches(lower(page_title), 'accesso|conto|verificare|aggiornare') THEN 'it' END) AS page_language,
 (epoch_us({AS_OF_SQL}) - epoch_us(whois_created)) / 86400000000.0 AS age_days
 FROM e)
SELECT url, domain, online, http_status_code, final_ip AS ip_address, cidr_block, asn, asn_name, isp, country,
 coalesce(geo_name, {_NAMES_SQL}) AS country_name, region, city, latitude, longitude, ssl_enabled, cert_issuer,
 cert_subject, cert_valid_to, tld, registrar, strftime(whois_created, '%Y-%m-%d') AS creation_date, name_servers,
 page_language, page_title,
 coalesce(threat, CASE source_feed WHEN 'urlhaus' THEN 'malware' ELSE 'phishing' END) AS threat_type,
 target AS target_brand, tags AS threat_tags, source_feed, source_id,
 25 + CASE WHEN age_days IS NULL THEN 8 WHEN age_days <= 7 THEN 20 WHEN age_days <= 30 THEN 15
  WHEN age_days <= 90 THEN 10 ELSE 5 END
 + CASE WHEN http_status_code IN (200, 301, 302, 307, 308) THEN 35
  WHEN http_status_code IN (401, 403, 405, 429, 451) THEN 28 WHEN http_status_code BETWEEN 500 AND 599 THEN 20
  WHEN http_status_code IN (404, 410) THEN 12 WHEN http_status_code IS NOT NULL THEN 10
  WHEN online = 'yes' THEN 20 ELSE 10 END
 + CASE WHEN regexp_matches(lower(url), '[.](vercel[.]app|web[.]app|github[.]io|cprapid[.]com|pages[.]dev|netlify[.]app|render[.]com|fly[.]dev)')
  THEN 10 ELSE 7 END
 + CASE WHEN regexp_matches(lower(url), 'login|verify|secure|update|invoice|mfa|password|wallet|bank|microsoft|office365|att')
  THEN 10 ELSE 0 END AS risk_score
FROM f"""


@query("enrich_full", _ENRICH_SQL)
def enrich_full(spark, sf_dir):
    # Raw tables and snapshots are stored tables in practice; here all come from one.
    rows = staged(fx.hosted_obs(spark, sf_dir).drop("html"), "observations")
    work = dedup_feeds(fx.raw_work(rows))
    enriched = enrich(work, fx.snapshots(spark, sf_dir, rows), fx.AS_OF)
    shown = enriched.withColumn("creation_date", F.date_format("creation_date", "yyyy-MM-dd"))
    return shown.select(*ENRICHED_COLUMNS)
