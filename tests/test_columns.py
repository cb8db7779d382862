from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hooktrace.functions import dates, fields, ipaddr, urls


def test_hosts(texts):
    cases = {
        "https://User:pw@Ex.COM:8080/a": ("ex.com", "ex.com", "ex.com"),
        "example.com/x": (None, "example.com", "example.com"),
        "httpbin.org/x": (None, "httpbin.org", None),
        "http://a_b.com/": ("a_b.com",) * 3,
        "http://[::1]/a": ("::1",) * 3,
        "http://[::1]:80/": ("::1",) * 3,
        "ftp://z.com/x": ("z.com", "z.com", "ftp"),
        "HTTP://UP.com": ("up.com", "up.com", "http"),
        "//x.com/a": ("x.com", "x.com", None),
        " http://q.com ": ("q.com", "q.com", " http"),
        "http://a@b@c.com/": ("c.com",) * 3,
        "http:///x": (None, None, None),
        "http://h?x": ("h",) * 3,
        "": (None, None, None),
    }
    strict = lambda t: urls.url_host(t, strict=True)
    got = texts(list(cases), urls.feed_host, urls.url_host, strict)
    assert dict(zip(cases, got)) == cases


def test_tld_and_base_domain(texts):
    cases = {
        "a.b.co.uk": (".uk", "b.co.uk"), "b.co.uk": (".uk", "b.co.uk"), "co.uk": (".uk", "co.uk"),
        "x.y.com": (".com", "y.com"), "y.com": (".com", "y.com"), "localhost": (None, "localhost"),
        "1.2.3.4": (".4", "3.4"), "a..co.uk": (".uk", ".co.uk"), "a.b.govt.nz": (".nz", "b.govt.nz"),
        "x.": (".", "x."),
    }
    assert dict(zip(cases, texts(list(cases), urls.tld, urls.base_domain))) == cases


def test_every_suffix(texts):
    names = [f"a.b{s}" for s in urls.TWO_LABEL_SUFFIXES]
    assert texts(names, urls.base_domain) == [f"b{s}" for s in urls.TWO_LABEL_SUFFIXES]


def test_ip_and_cidr(texts):
    assert texts(["1.2.3.4", "256.1.1.1", "1.2.3", "::1", "255.255.255.255", None], ipaddr.ip_number) == [
        16909060, None, None, None, 4294967295, None,
    ]
    got = texts(
        ["10.0.0.0/8", "1.2.3.4/0", "1.2.3.255/31", "1.2.3.4/33", "1.2.3.4", "1.2.3.4/32"],
        ipaddr.cidr_low, ipaddr.cidr_high,
    )
    assert got == [
        (167772160, 184549375), (0, 4294967295), (16909310, 16909311), (None, None), (None, None),
        (16909060, 16909060),
    ]


def test_utc_timestamp(texts):
    cases = {
        "2024-01-02": datetime(2024, 1, 2), "2024-01-02T03:04:05": datetime(2024, 1, 2, 3, 4, 5),
        "2024-01-02 03:04:05.5": datetime(2024, 1, 2, 3, 4, 5, 500000),
        "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5),
        "2024-01-02T03:04:05+02:00": datetime(2024, 1, 2, 1, 4, 5), "": None, "junk": None, None: None,
    }
    assert texts(list(cases), dates.utc_timestamp) == list(cases.values())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, texts, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert texts(["2024-01-02T03:04:05+02:00"], dates.utc_timestamp) == [datetime(2024, 1, 2, 1, 4, 5)]
        assert texts(["Dec 31 23:59:59 2024 GMT"], dates.cert_timestamp) == [datetime(2024, 12, 31, 23, 59, 59)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_certificate_days(texts):
    values = ["Jan  5 00:00:00 2024 GMT", "Jan 15 12:00:00 2024 GMT", "2024-01-15", None]
    assert texts(values, lambda t: dates.cert_days_left(t, "2024-01-06 00:00:00")) == [-1, 9, None, None]


def test_day_counts_round_down(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 12:00:00' AS a, TIMESTAMP_NTZ '2024-01-03 00:00:00' AS b")
    ages = frame.select(*[dates.domain_age_days(F.col(c), "2024-01-02 00:00:00") for c in "ab"]).first()
    assert tuple(ages) == (0, -1)


def test_small_fields(texts):
    assert texts([" 12 ", "1.5", "x", "", None, "-3"], fields.safe_int) == [12, None, None, None, None, -3]
    assert texts(["AS13335", "AS 7", "AS", "x1"], fields.asn_number) == [13335, 7, None, None]
    assert texts(["true", "yes", "false", "no", "True", None], fields.yes_no) == ["yes", "yes", "no", "no", None, None]
    assert texts(["AS13335 Cloudflare, Inc.", "AS5", "x"], lambda t: fields.asn_split(t)[0]) == [13335, 5, None]
    assert texts(["AS13335 Cloudflare, Inc.", "AS5", "x"], lambda t: fields.asn_split(t)[1]) == ["Cloudflare, Inc.", None, None]
    assert texts(["", None, "a"], lambda t: fields.first_text(t, F.lit("b"))) == ["b", "b", "a"]


def test_lists(spark):
    frame = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in frame.select(fields.joined_list(F.col("l"))).collect()] == ["a,b", "", None]
    back = frame.select(fields.split_list(fields.joined_list(F.col("l")))).collect()
    assert [r[0] for r in back] == [["a", "b"], [], None]


def test_page_fields(texts):
    long = "x" * 300
    pages = [
        "<HTML xml:lang='fr'><TITLE id=a>\n  Hi\nthere </TITLE><title>two</title>",
        f"<html lang=\"en\"><title>{long}</title>", "<html><title></title>", "plain", None,
    ]
    assert texts(pages, fields.page_title) == ["Hi\nthere", "x" * 200, "", None, None]
    assert texts(pages, fields.page_language) == ["fr", "en", None, None, None]
    titles = ["Sign in", "Su cuenta", "Votre compte", "Mein Konto", "Il tuo conto", "Überprüfen", "zzz", None]
    assert texts(titles, fields.title_language) == ["en", "es", "fr", "de", "it", "de", None, None]


def test_probe_flags(spark):
    cases = [
        ("GET", 399, None, "yes"), ("GET", 400, None, "no"), ("HEAD", 500, None, "yes"),
        ("HEAD", None, "connection", "no"), ("GET", None, "timeout", "unknown"), ("GET", None, None, "unknown"),
        ("GET", None, "tls", "no"),
    ]
    frame = spark.createDataFrame(cases, "m string, s int, f string, want string")
    got = frame.select("want", fields.online_from_probe(F.col("m"), F.col("s"), F.col("f"))).collect()
    assert all(a == b for a, b in got)


def test_inferences(spark):
    frame = spark.createDataFrame(
        [("", "phishtank"), (None, "openphish"), (None, "urlhaus"), ("x", "urlhaus"), (None, "other")],
        "t string, s string",
    )
    got = [r[0] for r in frame.select(fields.threat_type(F.col("t"), F.col("s"))).collect()]
    assert got == ["phishing", "phishing", "malware", "x", None]
    frame = spark.createDataFrame([(None, "US"), ("", "ZZ"), ("Mine", "US"), (None, None)], "n string, c string")
    got = [r[0] for r in frame.select(fields.country_name(F.col("n"), F.col("c"))).collect()]
    assert got == ["United States", "ZZ", "Mine", None]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_ip_numbers_round_trip(spark, numbers):
    texts_ = [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers]
    frame = spark.createDataFrame(list(zip(texts_, numbers)), "t string, n long")
    assert frame.where(ipaddr.ip_number(F.col("t")) != F.col("n")).count() == 0
