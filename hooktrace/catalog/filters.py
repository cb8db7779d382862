"""Filter, search, page and option-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import AS_OF_SQL, query
from hooktrace.operators import analytics, filters, paging
from hooktrace.operators.filters import ThreatFilter
from hooktrace.operators.lookups import join_cert

_TEXT_SQL = "(url ILIKE '%bank%' OR domain ILIKE '%bank%' OR ip_address ILIKE '%bank%')"


def _ids(rows):
    return rows.select("id", "url")


@query("filter_text", "SELECT id, url FROM enr WHERE url ILIKE '%WALLET/1%' OR ip_address LIKE '%.3.24%'")
def filter_text(spark, sf_dir):
    rows = fx.enr(spark, sf_dir)
    return _ids(rows.where(filters.text_matches("WALLET/1") | filters.text_matches(".3.24")))


@query(
    "filter_in",
    """
SELECT id, url FROM enr WHERE source_feed IN ('phishtank', 'urlhaus') AND threat_type IN ('phishing')
 AND target_brand IN ('Brand 1', 'Brand 2', 'Brand 3') AND country IN ('US', 'DE', 'RU')""",
)
def filter_in(spark, sf_dir):
    chosen = ThreatFilter(
        source_feeds=["phishtank", "urlhaus"],
        threat_types=["phishing"],
        target_brands=["Brand 1", "Brand 2", "Brand 3"],
        countries=["US", "DE", "RU"],
    )
    return _ids(chosen.apply(fx.enr(spark, sf_dir)))


@query(
    "filter_online",
    """
SELECT choice, count(*) AS count FROM (
 SELECT 'Yes' AS choice FROM enr WHERE online = 'yes' UNION ALL SELECT 'No' FROM enr WHERE online = 'no'
 UNION ALL SELECT 'Unknown' FROM enr WHERE online = 'unknown' OR online IS NULL
 UNION ALL SELECT 'All' FROM enr)
GROUP BY choice""",
)
def filter_online(spark, sf_dir):
    rows = fx.enr(spark, sf_dir)
    choices = {c: ThreatFilter(online_status=c, unknown_includes_null=True) for c in ("Yes", "No", "Unknown", "All")}
    # One scan: each row is counted under every choice that lets it through.
    hits = F.array_compact(F.array(*[F.when(f.condition(), F.lit(c)) for c, f in choices.items()]))
    return rows.select(F.explode(hits).alias("choice")).groupBy("choice").agg(
        F.count(F.lit(1)).alias("count")
    )


@query(
    "filter_date_range",
    """
SELECT id, url FROM enr
WHERE CAST(first_seen AS DATE) >= DATE '2024-01-10' AND CAST(first_seen AS DATE) <= DATE '2024-01-20'""",
)
def filter_date_range(spark, sf_dir):
    chosen = ThreatFilter(date_from="2024-01-10", date_to="2024-01-20")
    return _ids(chosen.apply(fx.enr(spark, sf_dir)))


@query(
    "filter_ssl_expiring",
    f"""
SELECT o.id, o.url FROM hosted o JOIN dim_cert c ON c.domain = o.domain
WHERE (epoch_us(c.expiry) - epoch_us({AS_OF_SQL})) / 86400000000.0 BETWEEN 0 AND 30""",
)
def filter_ssl_expiring(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir).drop("html")
    with_certs = join_cert(rows, fx.dim_cert(rows), F.col("id"))
    return _ids(ThreatFilter(ssl_expiring_soon=True).apply(with_certs, fx.AS_OF))


@query(
    "filter_age_bucket",
    """
SELECT id, url FROM (SELECT id, url, age_days FROM scored)
WHERE age_days <= 30 OR age_days BETWEEN 31 AND 180""",
)
def filter_age_bucket(spark, sf_dir):
    chosen = ThreatFilter(domain_age_buckets=["new", "medium"])
    return _ids(chosen.apply(fx.enr(spark, sf_dir), fx.AS_OF))


@query(
    "filter_combined",
    f"""
SELECT id, url FROM enr WHERE {_TEXT_SQL} AND source_feed IN ('openphish', 'urlhaus') AND online = 'yes'
 AND first_seen >= TIMESTAMP '2024-01-05' AND first_seen < TIMESTAMP '2024-01-29'
 AND (epoch_us({AS_OF_SQL}) - epoch_us(creation_date)) / 86400000000.0 > 180""",
)
def filter_combined(spark, sf_dir):
    chosen = ThreatFilter(
        text_search="bank",
        source_feeds=["openphish", "urlhaus"],
        online_status="Yes",
        date_from="2024-01-05",
        date_to="2024-01-28",
        domain_age_buckets=["old"],
    )
    return _ids(chosen.apply(fx.enr(spark, sf_dir), fx.AS_OF))


@query(
    "search",
    """
SELECT * FROM (SELECT 'url' AS kind, id, url FROM enr WHERE url ILIKE '%bank%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'domain', id, url FROM enr WHERE domain ILIKE '%pages%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'ip', id, url FROM enr WHERE ip_address ILIKE '%.3.7%' ORDER BY id LIMIT 10)
UNION ALL SELECT 'id', id, url FROM enr WHERE id = 77""",
)
def search(spark, sf_dir):
    rows = fx.enr(spark, sf_dir)
    found = None
    for kind, term in (("url", "bank"), ("domain", "pages"), ("ip", ".3.7"), ("id", "77")):
        hits = filters.search(rows, kind, term).select(F.lit(kind).alias("kind"), "id", "url")
        found = hits if found is None else found.unionByName(hits)
    return found


@query(
    "row_details",
    f"""
SELECT id, url, cert_valid_to,
 CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(creation_date)) / 86400000000.0) AS BIGINT) AS domain_age_days,
 CAST(floor((epoch_us(expiry) - epoch_us({AS_OF_SQL})) / 86400000000.0) AS BIGINT) AS cert_days_to_expiry
FROM hosted LEFT JOIN dim_cert USING (domain) WHERE id = 123""",
)
def row_details(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir).drop("html")
    with_certs = join_cert(rows, fx.dim_cert(rows), F.col("id"))
    return filters.row_details(with_certs, 123, fx.AS_OF).select(
        "id", "url", "cert_valid_to", "domain_age_days", "cert_days_to_expiry"
    )


@query(
    "live_phishing",
    """
SELECT url, domain, country, target_brand FROM enr WHERE online = 'yes' AND threat_type = 'phishing'
ORDER BY first_seen DESC, id LIMIT 20""",
)
def live_phishing(spark, sf_dir):
    return filters.live_phishing(fx.enr(spark, sf_dir)).select(
        "url", "domain", "country", "target_brand"
    )


@query(
    "ssl_list",
    "SELECT o.id, o.url, o.domain, c.cert_issuer, c.cert_valid_to FROM hosted o JOIN dim_cert c USING (domain)",
)
def ssl_list(spark, sf_dir):
    rows = fx.hosted_obs(spark, sf_dir).drop("html")
    with_certs = join_cert(rows, fx.dim_cert(rows), F.col("id"))
    return filters.with_valid_tls(with_certs).select(
        "id", "url", "domain", "cert_issuer", "cert_valid_to"
    )


_PAGE_SQL = """
SELECT id, url, domain, online, http_status_code, country, asn_name, ssl_enabled, registrar, threat_type,
 target_brand, strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM enr
"""


@query("rows_page", _PAGE_SQL + "ORDER BY enr.first_seen DESC, id LIMIT 50 OFFSET 100")
def rows_page(spark, sf_dir):
    return fx.time_text(paging.page(fx.enr(spark, sf_dir), number=2), "first_seen")


@query(
    "rows_page_after",
    _PAGE_SQL + "WHERE enr.first_seen < TIMESTAMP '2024-01-20 12:00:00' ORDER BY enr.first_seen DESC, id LIMIT 50",
)
def rows_page_after(spark, sf_dir):
    rows = paging.page_after(fx.enr(spark, sf_dir), "2024-01-20 12:00:00", 0)
    return fx.time_text(rows, "first_seen")


@query("filtered_count", "SELECT count(*) AS total FROM enr WHERE online = 'yes' AND country = 'US'")
def filtered_count(spark, sf_dir):
    chosen = ThreatFilter(online_status="Yes", countries=["US"])
    return analytics.filtered_count(chosen.apply(fx.enr(spark, sf_dir)))


@query(
    "map_points",
    """
SELECT latitude AS lat, longitude AS lon, country, domain, threat_type FROM enr
WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY id LIMIT 2000""",
)
def map_points(spark, sf_dir):
    return paging.map_points(fx.enr(spark, sf_dir))


@query(
    "opt_brands",
    """
SELECT target_brand, count(*) AS count FROM enr WHERE target_brand IS NOT NULL
GROUP BY target_brand ORDER BY count DESC, target_brand LIMIT 100""",
)
def opt_brands(spark, sf_dir):
    return analytics.brand_options(fx.enr(spark, sf_dir))


@query(
    "opt_distinct",
    """
SELECT DISTINCT 'source_feed' AS option, source_feed AS value FROM enr WHERE source_feed IS NOT NULL
UNION ALL SELECT DISTINCT 'threat_type', threat_type FROM enr WHERE threat_type IS NOT NULL
UNION ALL SELECT DISTINCT 'country', country FROM enr WHERE country IS NOT NULL""",
)
def opt_distinct(spark, sf_dir):
    return analytics.distinct_options(fx.enr(spark, sf_dir))
