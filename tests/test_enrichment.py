from pyspark.sql import functions as F

from hooktrace.plans.enrichment import Snapshots, enrich
from hooktrace.plans.feedload import enrich_feeds
from hooktrace.schemas import ENRICHED, WORK_LIST
from hooktrace.sources.tables import conform

NOW = "2024-02-05 00:00:00"


def _work(spark, **fields):
    row = {"url": "http://a.example.com/x", "source_feed": "openphish", "feed_rank": 0, **fields}
    kinds = {f.name: f.dataType.simpleString() for f in WORK_LIST}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))
    return conform(frame, WORK_LIST)


def _snapshots(spark):
    make = spark.createDataFrame
    return Snapshots(
        dns=make([("a.example.com", "1.2.3.4")], "domain string, ip_address string"),
        city=make(
            [(16777216, 33554431, "", None, "R", "C", 1.0, 2.0)],
            "lo long, hi long, country string, country_name string, region string, city string, latitude double, longitude double",
        ),
        country=make([(16777216, 33554431, "FR", None)], "lo long, hi long, country string, country_name string"),
        asn=make([(16777216, 33554431, 0, "")], "lo long, hi long, asn long, asn_name string"),
        rdap=make(
            [("1.2.0.0/16", 77, "RNAME", "RISP", "XX"), ("9.0.0.0/8", 99, "NINE", None, "QQ")],
            "cidr_block string, asn long, asn_name string, isp string, country string",
        ),
        probes=make([("http://a.example.com/x", None, "timeout")], "url string, status int, failure string"),
        pages=make([("http://a.example.com/x", 404, "<html><title>Mein Konto</title>")], "url string, status int, html string"),
    )


def test_sources_fill_in_order(spark):
    row = enrich(_work(spark), _snapshots(spark), NOW).first()
    assert row.__fields__ == ENRICHED.names
    # Empty country and ASN 0 count as missing, so the fallbacks speak.
    assert (row.ip_address, row.country, row.country_name) == ("1.2.3.4", "FR", "France")
    assert (row.asn, row.asn_name, row.isp, row.cidr_block) == (77, "RNAME", "RISP", "1.2.0.0/16")
    assert (row.region, row.city, row.latitude, row.longitude) == ("R", "C", 1.0, 2.0)
    # The probe timed out and that counts as a flag, so the page only gives the status.
    assert (row.online, row.http_status_code) == ("unknown", 404)
    assert (row.page_title, row.page_language, row.threat_type) == ("Mein Konto", "de", "phishing")
    assert row.tld == ".com" and row.risk_score == 12 + 25 + 8 + 7 + 0


def test_stated_values_win(spark):
    work = _work(
        spark, source_feed="phishtank", online="no", ip_address="9.9.9.9", cidr_block="9.9.0.0/16",
        asn=5, country="DE", threat="own", target="Brand", tags="a,b", source_id="3",
    )
    row = enrich(work, _snapshots(spark), NOW).first()
    assert (row.ip_address, row.cidr_block, row.asn, row.country, row.country_name) == (
        "9.9.9.9", "9.9.0.0/16", 5, "DE", "Germany",
    )
    # Both ASN and CIDR block are stated, so RDAP is not asked for the name either.
    assert (row.asn_name, row.isp) == (None, None)
    assert (row.online, row.http_status_code, row.threat_type) == ("no", 404, "own")
    assert (row.target_brand, row.threat_tags, row.source_id) == ("Brand", "a,b", "3")


def test_rdap_is_asked_when_only_the_block_is_missing(spark):
    row = enrich(_work(spark, ip_address="9.9.9.9", asn=5), _snapshots(spark), NOW).first()
    assert (row.asn, row.asn_name, row.cidr_block, row.isp, row.country) == (5, "NINE", "9.0.0.0/8", "NINE", "QQ")


def test_url_without_host_is_stored_bare(spark):
    row = enrich(_work(spark, url="http:///x", online="yes", country="DE"), _snapshots(spark), NOW).first()
    filled = {k: v for k, v in row.asDict().items() if v is not None}
    assert set(filled) == {"id", "url", "source_feed", "first_seen", "last_checked", "created_at", "updated_at", "risk_score"}


def test_every_snapshot_is_optional(spark):
    row = enrich(_work(spark), Snapshots(), NOW, stage=False).first()
    assert (row.domain, row.ip_address, row.ssl_enabled, row.page_title) == ("a.example.com", None, None, None)


def test_from_raw_tables_with_source_and_skip(spark):
    line = spark.createDataFrame([("http://a.com/", "a.com"), ("http://b.com/", "b.com")], "url string, domain string")
    malware = spark.createDataFrame([("http://a.com/", "t", None, None, None)], "url string, threat string, tags string, asn long, country string")
    raw = {"line_feed": line, "malware_feed": malware}
    got = {r.url: r.source_feed for r in enrich_feeds(raw, Snapshots(), NOW, stage=False).collect()}
    assert got == {"http://a.com/": "urlhaus", "http://b.com/": "openphish"}
    stored = spark.createDataFrame([("http://a.com/",)], "url string")
    rest = enrich_feeds(raw, Snapshots(), NOW, enriched=stored, source="openphish", stage=False)
    assert [r.url for r in rest.select("url").collect()] == ["http://b.com/"]


def test_one_row_per_url_with_hot_domain_and_hot_ip(spark):
    """Many URLs on one domain and many on one address, joined in slices."""
    from hooktrace.operators import skew

    urls = spark.range(3000).select(
        F.concat(F.when(F.col("id") < 1500, "http://hot.com/").otherwise(F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".com/"))), F.col("id").cast("string")).alias("url"),
        F.lit("openphish").alias("source_feed"),
        F.when(F.col("id") % 3 == 0, "1.2.3.4").alias("ip_address"),
    )
    before, skew.ROWS_PER_SLICE = skew.balanced_left_join.__kwdefaults__["rows_per_slice"], 100
    skew.balanced_left_join.__kwdefaults__["rows_per_slice"] = 100
    try:
        rows = enrich(conform(urls, WORK_LIST), _snapshots(spark), NOW)
        assert rows.count() == rows.select("url").distinct().count() == 3000
        assert rows.where("asn = 77").count() == 1000
    finally:
        skew.balanced_left_join.__kwdefaults__["rows_per_slice"] = skew.ROWS_PER_SLICE = before
