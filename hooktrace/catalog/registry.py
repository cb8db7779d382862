"""Named queries, each with the SQL another engine runs to check it.

The SQL may use the views ``obs``, ``hosted`` and ``enr`` of this module; they
state the same fixtures as ``hooktrace.fixtures`` and are put in front as needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hooktrace.fixtures import ENR_SQL, OBS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF_SQL = "TIMESTAMP '2024-02-05 00:00:00'"

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)"

_VIEWS = {
    "obs": OBS_SQL.format(events="events", pages="pages", nation="nation"),
    "hosted": f"""
SELECT *, nullif(regexp_extract(domain, '([.][^.]*)$', 1), '') AS tld,
 CASE WHEN regexp_matches(domain, '[.](co|ac|gov|org)[.]uk$')
   THEN regexp_extract(domain, '([^.]*[.][^.]*[.][^.]*)$', 1)
   ELSE regexp_extract(domain, '([^.]*[.][^.]*)$', 1) END AS base_domain
FROM (SELECT *, lower(nullif(regexp_extract(url, '{_HOST}', 2), '')) AS domain FROM obs)""",
    "enr": ENR_SQL.format(hosted="hosted"),
    "scored": f"""
SELECT *, live + recent + young + platform + words AS risk_score FROM (
SELECT *,
 CASE WHEN http_status_code IN (200, 301, 302, 307, 308) THEN 35
   WHEN http_status_code IN (401, 403, 405, 429, 451) THEN 28
   WHEN http_status_code BETWEEN 500 AND 599 THEN 20 WHEN http_status_code IN (404, 410) THEN 12
   WHEN http_status_code IS NOT NULL THEN 10 WHEN online = 'yes' THEN 20 ELSE 10 END AS live,
 CASE WHEN seen_days IS NULL THEN 5 WHEN seen_days <= 3 THEN 25 WHEN seen_days <= 7 THEN 20
   WHEN seen_days <= 14 THEN 15 WHEN seen_days <= 30 THEN 10 ELSE 5 END AS recent,
 CASE WHEN age_days IS NULL THEN 8 WHEN age_days <= 7 THEN 20 WHEN age_days <= 30 THEN 15
   WHEN age_days <= 90 THEN 10 ELSE 5 END AS young,
 CASE WHEN hosting THEN 10 ELSE 7 END AS platform,
 CASE WHEN hosting THEN CASE WHEN bare IN ('com', 'net', 'org') THEN 8 ELSE 10 END
   WHEN bare IN ('zip', 'mov', 'top', 'cc', 'icu', 'xyz', 'click', 'info') THEN 10
   WHEN bare IN ('com', 'net', 'org') THEN 5 ELSE 7 END AS platform_bare,
 CASE WHEN regexp_matches(lower(url),
   'login|verify|secure|update|invoice|mfa|password|wallet|bank|microsoft|office365|att')
   THEN 10 ELSE 0 END AS words
FROM (SELECT *,
 (epoch_us({AS_OF_SQL}) - epoch_us(last_seen)) / 86400000000.0 AS seen_days,
 (epoch_us({AS_OF_SQL}) - epoch_us(creation_date)) / 86400000000.0 AS age_days,
 regexp_matches(lower(url), '[.](vercel[.]app|web[.]app|github[.]io|cprapid[.]com|pages[.]dev|netlify[.]app|render[.]com|fly[.]dev)')
   AS hosting,
 substr(tld, 2) AS bare FROM hosted))""",
    "dim_geo": """
SELECT CAST(n_nationkey AS BIGINT) * 167772160 AS lo, CAST(n_nationkey AS BIGINT) * 167772160 + 167772159 AS hi,
 CASE WHEN n_nationkey NOT IN (3, 8, 13) THEN 'N' || CAST(n_nationkey AS VARCHAR) END AS country,
 CASE WHEN n_nationkey NOT IN (3, 8, 13) THEN n_name END AS country_name,
 'Region ' || CAST(n_regionkey AS VARCHAR) AS region, 'City ' || CAST(n_nationkey AS VARCHAR) AS city,
 CAST(n_nationkey - 12 AS DOUBLE) AS latitude, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS longitude
FROM nation""",
    "dim_asn": """
SELECT CAST(n_nationkey AS BIGINT) * 167772160 + 70001 AS lo,
 CAST(n_nationkey AS BIGINT) * 167772160 + 167772159 - 3333333 AS hi,
 CAST(n_nationkey + 64512 AS BIGINT) AS asn, 'AS-' || n_name AS asn_name FROM nation""",
    "dim_rdap": """
SELECT *, 'NET ' || cidr_block AS isp, CAST(split_part(cidr_block, '/', 2) AS INTEGER) AS bits,
 CAST(split_part(cidr_block, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(cidr_block, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(cidr_block, '.', 3) AS BIGINT) * 256 AS lo
FROM (SELECT unnest([a || '.0.0.0/8', a || '.64.0.0/10', a || '.' || b || '.0.0/16', a || '.' || b || '.3.0/25'])
   AS cidr_block, CAST(n_nationkey + 65000 AS BIGINT) AS asn, 'RDAP ' || n_name AS asn_name
 FROM (SELECT *, CAST(n_nationkey * 8 + 11 AS VARCHAR) AS a, CAST(n_nationkey + 64 AS VARCHAR) AS b FROM nation))""",
    "dim_dns": "SELECT domain, min(ip_address) AS dns_ip FROM hosted GROUP BY domain",
    "dim_whois": """
SELECT base_domain, CASE length(base_domain) % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma'
   ELSE 'Delta' END AS registrar,
 CASE WHEN length(base_domain) % 5 <> 0 THEN TIMESTAMP '2024-01-01' - INTERVAL '1' DAY * length(base_domain) END
   AS whois_created,
 'ns1.' || base_domain || ',ns2.' || base_domain AS name_servers
FROM (SELECT DISTINCT base_domain FROM hosted) WHERE base_domain NOT LIKE '%.net'""",
    "dim_cert": """
SELECT domain, 'CA ' || CAST(length(domain) AS VARCHAR) AS cert_issuer, domain AS cert_subject,
 CASE WHEN length(domain) > 16 THEN 'organizationName' ELSE 'commonName' END AS issuer_kind,
 TIMESTAMP '2024-01-25 10:20:30' + INTERVAL '1' DAY * length(domain) AS expiry,
 strftime(TIMESTAMP '2024-01-25 10:20:30' + INTERVAL '1' DAY * length(domain), '%b ')
  || lpad(CAST(day(TIMESTAMP '2024-01-25 10:20:30' + INTERVAL '1' DAY * length(domain)) AS VARCHAR), 2, ' ')
  || strftime(TIMESTAMP '2024-01-25 10:20:30' + INTERVAL '1' DAY * length(domain), ' %H:%M:%S %Y GMT')
   AS cert_valid_to
FROM (SELECT DISTINCT domain FROM hosted WHERE url LIKE 'https:%')""",
    "dim_page": r"""
SELECT url, min(status) AS page_status, min(page_title) AS page_title, min(page_language) AS page_language,
 min(failure) AS failure FROM (
SELECT url, CASE WHEN page_id % 11 IN (5, 6) THEN NULL WHEN page_id % 4 = 0 THEN 200 WHEN page_id % 4 = 1 THEN 301
   WHEN page_id % 4 = 2 THEN 404 ELSE 503 END AS status,
 CASE page_id % 11 WHEN 5 THEN 'connection' WHEN 6 THEN 'timeout' END AS failure,
 substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200) AS page_title,
 nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '') AS page_language
FROM pages) GROUP BY url""",
    # Identity of a host: an address is itself, a name on a hosting platform keeps the label before it.
    "sites": """
SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$') THEN domain
 WHEN regexp_matches(domain, '[.](vercel[.]app|web[.]app|github[.]io|cprapid[.]com|pages[.]dev|netlify[.]app|render[.]com|fly[.]dev)$')
  THEN regexp_extract(domain, '([^.]*[.][^.]*[.][^.]*)$', 1)
 WHEN regexp_matches(domain, '[.](co|ac|gov|org)[.]uk$') THEN regexp_extract(domain, '([^.]*[.][^.]*[.][^.]*)$', 1)
 ELSE regexp_extract(domain, '([^.]*[.][^.]*)$', 1) END AS site FROM (
 SELECT id, url, domain, first_seen FROM hosted UNION ALL
 SELECT id, page_url, regexp_extract(page_url, '://([^/?#:]*)', 1), NULL FROM obs UNION ALL
 SELECT id + 1000000000, 'http://' || ip_address || '/' || CAST(id % 2 AS VARCHAR), ip_address, first_seen FROM obs
  WHERE ip_address IS NOT NULL)""",
    "obs_ip": """
SELECT *, CASE WHEN ip_address IS NOT NULL THEN
  CAST(split_part(ip_address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip_address, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(ip_address, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip_address, '.', 4) AS BIGINT) END AS ip
FROM hosted""",
    "raw_work": """
SELECT id, url, source_feed, CASE source_feed WHEN 'openphish' THEN 0 WHEN 'phishtank' THEN 1 ELSE 2 END AS feed_rank,
 CASE WHEN source_feed = 'phishtank' THEN CAST(id AS VARCHAR) END AS source_id,
 CASE WHEN source_feed = 'phishtank' THEN online END AS online,
 CASE WHEN source_feed = 'phishtank' THEN 'Brand ' || CAST(id % 17 AS VARCHAR) END AS target,
 CASE WHEN source_feed = 'phishtank' THEN ip_address END AS ip_address,
 CASE WHEN source_feed <> 'openphish' THEN asn END AS asn,
 CASE WHEN source_feed = 'urlhaus' AND online = 'no' THEN 'malware_download' END AS threat,
 CASE WHEN source_feed = 'urlhaus' THEN 'elf' || coalesce(',' || online, '') END AS tags,
 CASE WHEN source_feed = 'urlhaus' AND asn > 64530 THEN 'DE' END AS country,
 domain, tld, base_domain, page_url, first_seen
FROM hosted QUALIFY source_feed = 'phishtank' OR row_number() OVER (PARTITION BY source_feed, url ORDER BY id) = 1""",
}


def _views_for(sql: str) -> str:
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, body in _VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed[name] = body

    visit(sql)
    return ", ".join(f"{n} AS ({needed[n]})" for n in needed)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its check."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            views = _views_for(sql)
            body = sql.strip()
            if views and body.startswith("WITH RECURSIVE "):
                ORACLES[name] = f"WITH RECURSIVE {views}, {body[15:]}"
            elif views and body.startswith("WITH "):
                ORACLES[name] = f"WITH {views}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {views} {body}" if views else body
        return function

    return add
