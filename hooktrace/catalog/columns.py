"""URL, text and merge columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.registry import AS_OF_SQL, query
from hooktrace.functions import fields, urls
from hooktrace.functions.dates import cert_days_left as days_left
from hooktrace.functions.dates import domain_age_days as age_days
from hooktrace.operators.lookups import cert_columns, latest_first, page_columns, whois_columns
from hooktrace.operators.upsert import one_per_key
from hooktrace.sources.feeds import feed_lines, map_phish_records


@query(
    "scan_line_feed",
    r"""
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars,
 min(line) AS first_line, max(line) AS last_line
FROM (SELECT doc_id, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)
 WHERE NOT starts_with(raw, '#'))
WHERE line <> '' GROUP BY doc_id""",
)
def scan_line_feed(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("value")
    )
    return feed_lines(lines).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("value")).alias("chars"),
        F.min("value").alias("first_line"),
        F.max("value").alias("last_line"),
    )


@query("domain_feed", "SELECT id, domain FROM hosted")
def domain_feed(spark, sf_dir):
    return fx.obs(spark, sf_dir).select("id", urls.feed_host(F.col("url")).alias("domain"))


@query(
    "domain_enrich",
    """
SELECT id, domain, CASE WHEN url LIKE 'https:%' THEN domain END AS feed_domain
FROM hosted""",
)
def domain_enrich(spark, sf_dir):
    # http URLs lose their scheme here, which only the scheme-optional rule can read.
    url = F.regexp_replace("url", "^http://", "")
    return fx.obs(spark, sf_dir).select(
        "id", urls.url_host(url).alias("domain"), urls.feed_host(url).alias("feed_domain")
    )


@query("tld", "SELECT domain, tld, count(*) AS count FROM hosted GROUP BY ALL")
def tld(spark, sf_dir):
    rows = fx.obs(spark, sf_dir).select(urls.url_host(F.col("url")).alias("domain"))
    return (
        rows.groupBy("domain")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("tld", urls.tld(F.col("domain")))
    )


@query("base_domain", "SELECT domain, base_domain, count(*) AS count FROM hosted GROUP BY ALL")
def base_domain(spark, sf_dir):
    rows = fx.obs(spark, sf_dir).select(urls.url_host(F.col("url")).alias("domain"))
    return (
        rows.groupBy("domain")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("base_domain", urls.base_domain(F.col("domain")))
    )


@query(
    "feed_json_map",
    """
SELECT id AS phish_id, url,
 CASE source_feed WHEN 'openphish' THEN 'yes' WHEN 'phishtank' THEN 'no' END AS verified,
 online, ip_address, CASE WHEN ip_address IS NOT NULL THEN 'AS' || CAST(asn AS VARCHAR) END
  AS announcing_network
FROM obs""",
)
def feed_json_map(spark, sf_dir):
    detail = "struct<ip_address:string,cidr_block:string,announcing_network:string,rir:string,detail_time:string>"
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("ip_address"), none.alias("cidr_block"),
        F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("announcing_network"),
        none.alias("rir"), none.alias("detail_time"),
    ).cast(detail)
    other = F.struct(F.lit("0.0.0.0"), none, F.lit("AS0"), none, none).cast(detail)
    records = fx.obs(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("phish_id"),
        "url",
        none.alias("phish_detail_url"),
        none.alias("submission_time"),
        F.when(F.col("source_feed") == "openphish", "true")
        .when(F.col("source_feed") == "phishtank", "no")
        .otherwise("maybe")
        .alias("verified"),
        none.alias("verification_time"),
        F.when(F.col("online") == "yes", "true").otherwise(F.col("online")).alias("online"),
        none.alias("target"),
        F.when(F.col("ip_address").isNull(), F.array().cast(f"array<{detail}>"))
        .otherwise(F.array(own, other))
        .alias("details"),
    )
    return map_phish_records(records).select(
        "phish_id", "url", "verified", "online", "ip_address", "announcing_network"
    )


@query(
    "safe_int",
    """
SELECT event_id, try_cast(trim(regexp_replace(props, '[^0-9 ]', '', 'g')) AS BIGINT) AS number,
 CAST(NULL AS BIGINT) AS unreadable FROM events""",
)
def safe_int(spark, sf_dir):
    digits = F.regexp_replace("props", "[^0-9 ]", "")
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        fields.safe_int(digits).alias("number"),
        fields.safe_int(F.col("props")).alias("unreadable"),
    )


@query(
    "coalesce_chain",
    """
SELECT event_id, coalesce(nullif(CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN NULL ELSE props END, ''),
 event_type) AS chosen FROM events""",
)
def coalesce_chain(spark, sf_dir):
    first = F.when(F.col("event_type") == "click", "").when(
        F.col("event_type") != "view", F.col("props")
    )
    return fx.table(spark, sf_dir, "events").select(
        "event_id", fields.first_text(first, F.col("event_type")).alias("chosen")
    )


@query(
    "tags_join",
    """
SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN ''
 ELSE event_type || ',' || props END AS tags FROM events""",
)
def tags_join(spark, sf_dir):
    kind = F.col("event_type")
    tags = F.when(kind == "view", F.array().cast("array<string>")).when(
        kind != "click", F.array("event_type", "props")
    )
    return fx.table(spark, sf_dir, "events").select("event_id", fields.joined_list(tags).alias("tags"))


@query("asn_parse", "SELECT id, CASE WHEN online = 'yes' THEN asn END AS asn FROM obs")
def asn_parse(spark, sf_dir):
    number = F.col("asn").cast("string")
    network = F.when(F.col("online") == "yes", F.concat(F.lit("AS "), number)).otherwise(
        F.concat(F.lit("net-"), number)
    )
    return fx.obs(spark, sf_dir).select("id", fields.asn_number(network).alias("asn"))


@query(
    "asn_split",
    """
SELECT id, asn, CASE WHEN asn IS NOT NULL THEN country_name || ', Inc.' END AS asn_name
FROM obs WHERE country_name IS NOT NULL""",
)
def asn_split(spark, sf_dir):
    text = F.concat(F.lit("AS"), F.col("asn").cast("string"), F.lit(" "), F.col("country_name"), F.lit(", Inc."))
    number, name = fields.asn_split(text)
    rows = fx.obs(spark, sf_dir).where(F.col("country_name").isNotNull())
    return rows.select("id", number.alias("asn"), name.alias("asn_name"))


@query(
    "page_title",
    "SELECT page_id, substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200)"
    " AS page_title FROM pages",
)
def page_title(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", fields.page_title(F.col("html")).alias("page_title")
    )


@query(
    "page_language",
    """
SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '')
 AS page_language FROM pages""",
)
def page_language(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", fields.page_language(F.col("html")).alias("page_language")
    )


_WORDS_SQL = """
 CASE WHEN regexp_matches(lower({0}), 'sign|login|account|verify|update|security') THEN 'en'
 WHEN regexp_matches(lower({0}), 'iniciar|cuenta|verificar|actualizar') THEN 'es'
 WHEN regexp_matches(lower({0}), 'connexion|compte|vérifier|mettre') THEN 'fr'
 WHEN regexp_matches(lower({0}), 'anmelden|konto|überprüfen|aktualisieren') THEN 'de'
 WHEN regexp_matches(lower({0}), 'accesso|conto|verificare|aggiornare') THEN 'it' END"""


@query(
    "title_language",
    f"SELECT doc_id, {_WORDS_SQL.format('text')} AS guess, lang FROM documents",
)
def title_language(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", fields.title_language(F.col("text")).alias("guess"), "lang"
    )


@query(
    "online_from_probe",
    """
SELECT id, CASE WHEN http_status_code IS NULL THEN CASE WHEN online = 'no' THEN 'no' ELSE 'unknown' END
 WHEN source_feed = 'openphish' OR http_status_code < 400 THEN 'yes' ELSE 'no' END AS probed
FROM obs""",
)
def online_from_probe(spark, sf_dir):
    method = F.when(F.col("source_feed") == "openphish", "HEAD").otherwise("GET")
    failure = F.when(F.col("online") == "no", "connection").otherwise("timeout")
    return fx.obs(spark, sf_dir).select(
        "id", fields.online_from_probe(method, F.col("http_status_code"), failure).alias("probed")
    )


@query(
    "threat_type",
    """
SELECT id, CASE WHEN online = 'no' THEN 'malware_download' WHEN source_feed = 'urlhaus' THEN 'malware'
 ELSE 'phishing' END AS threat_type FROM obs""",
)
def threat_type(spark, sf_dir):
    stated = F.when(F.col("online") == "no", "malware_download").when(F.col("online") == "yes", "")
    return fx.obs(spark, sf_dir).select(
        "id", fields.threat_type(stated, F.col("source_feed")).alias("threat_type")
    )


@query(
    "country_name",
    """
SELECT id, country, coalesce(nullif(CASE WHEN asn IS NULL THEN country_name WHEN online = 'yes' THEN '' END, ''),
 CASE country WHEN 'US' THEN 'United States' WHEN 'DE' THEN 'Germany' WHEN 'CN' THEN 'China'
  WHEN 'RU' THEN 'Russia' ELSE country END,
 CASE WHEN asn IS NULL THEN country_name WHEN online = 'yes' THEN '' END) AS country_name
FROM enr""",
)
def country_name(spark, sf_dir):
    stated = F.when(F.col("asn").isNull(), F.col("country_name")).when(F.col("online") == "yes", "")
    return fx.enr(spark, sf_dir).select(
        "id", "country", fields.country_name(stated, F.col("country")).alias("country_name")
    )


@query(
    "isp_fill",
    """
SELECT id, CASE WHEN online = 'yes' THEN registrar WHEN online = 'no' THEN coalesce(asn_name, '') ELSE asn_name END
 AS isp FROM (SELECT id, online, asn_name, coalesce(registrar, asn_name) AS registrar FROM enr)""",
)
def isp_fill(spark, sf_dir):
    stated = F.when(F.col("online") == "yes", F.col("registrar")).when(F.col("online") == "no", "")
    return fx.enr(spark, sf_dir).select(
        "id", fields.isp_name(stated, F.col("asn_name")).alias("isp")
    )


@query(
    "merge_precedence",
    """
SELECT id, CASE WHEN online = 'yes' AND asn IS NOT NULL THEN asn
  WHEN http_status_code IS NOT NULL THEN http_status_code ELSE id END AS asn,
 coalesce(nullif(CASE WHEN online = 'no' THEN '' ELSE country END, ''), country_name, registrar) AS country
FROM enr""",
)
def merge_precedence(spark, sf_dir):
    own = F.when(F.col("online") == "yes", F.col("asn")).otherwise(F.lit(0))
    text = F.when(F.col("online") == "no", "").otherwise(F.col("country"))
    return fx.enr(spark, sf_dir).select(
        "id",
        fields.first_number(own, F.col("http_status_code").cast("bigint"), F.col("id")).alias("asn"),
        fields.first_text(text, F.col("country_name"), F.col("registrar")).alias("country"),
    )


@query(
    "whois_shape",
    """
SELECT base_domain, registrar, strftime(whois_created, '%Y-%m-%d') AS creation_date, name_servers
FROM dim_whois""",
)
def whois_shape(spark, sf_dir):
    """The latest capture of every registrable domain, shaped; the older one must not show."""
    shaped = whois_columns(fx.dim_whois(fx.hosted_obs(spark, sf_dir)))
    latest = one_per_key(shaped, "base_domain", latest_first(shaped, "base_domain"))
    return latest.select(
        "base_domain", "registrar", F.date_format("creation_date", "yyyy-MM-dd").alias("creation_date"), "name_servers"
    )


@query("cert_shape", "SELECT domain, cert_issuer, cert_subject, cert_valid_to FROM dim_cert")
def cert_shape(spark, sf_dir):
    return cert_columns(fx.dim_cert(fx.hosted_obs(spark, sf_dir)))


@query(
    "domain_age_days",
    f"""
SELECT id, CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(creation_date)) / 86400000000.0) AS BIGINT)
 AS domain_age_days FROM obs""",
)
def domain_age_days(spark, sf_dir):
    return fx.obs(spark, sf_dir).select(
        "id", age_days(F.col("creation_date"), fx.AS_OF).alias("domain_age_days")
    )


@query(
    "cert_days_left",
    f"""
SELECT domain, CAST(floor((epoch_us(expiry) - epoch_us({AS_OF_SQL})) / 86400000000.0) AS BIGINT)
 AS cert_days_to_expiry FROM dim_cert""",
)
def cert_days_left(spark, sf_dir):
    certs = fx.dim_cert(fx.hosted_obs(spark, sf_dir))
    return certs.select(
        "domain", days_left(F.col("cert_valid_to"), fx.AS_OF).alias("cert_days_to_expiry")
    )


@query(
    "page_columns",
    """
WITH f AS (SELECT url, CASE WHEN page_id % 11 IN (5, 6) THEN NULL WHEN page_id % 4 = 0 THEN 200
  WHEN page_id % 4 = 1 THEN 301 WHEN page_id % 4 = 2 THEN 404 ELSE 503 END AS page_status,
 page_id % 11 = 6 AS timed_out,
 substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 200) AS page_title,
 nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '') AS page_language FROM pages),
o AS (SELECT url, page_status, CASE WHEN page_status < 400 THEN 'yes' WHEN timed_out THEN 'unknown' ELSE 'no' END AS page_online,
 page_title, page_language FROM f)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_status NULLS LAST, page_online,
 page_title NULLS LAST, page_language NULLS LAST) = 1""",
)
def page_facts(spark, sf_dir):
    """What is kept of one page of each URL: all columns are those of the same page."""
    short = page_columns(fx.dim_page(spark, sf_dir))
    return one_per_key(short, "url", latest_first(short, "url"))
