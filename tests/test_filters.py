from datetime import date, datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators import analytics, filters, paging
from hooktrace.operators.filters import ThreatFilter

NOW = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def threats(spark):
    day = timedelta(days=1)
    rows = [
        (1, "http://Bank.com/a", "bank.com", "1.1.1.1", "openphish", "phishing", "B", "US", "yes", datetime(2024, 2, 1, 23, 59), "Mar 10 00:00:00 2024 GMT", NOW - 30 * day),
        (2, "http://x.org/100%", "x.org", None, "urlhaus", "malware", None, "DE", "no", datetime(2024, 2, 2), "Feb  1 00:00:00 2024 GMT", NOW - 30.5 * day),
        (3, "http://y.net/c_d", "y.net", "2.2.2.2", "phishtank", "phishing", "B", None, None, datetime(2024, 2, 3), "2024-03-05", NOW - 31 * day),
        (4, "http://z.net/cxd", "z.net", "2.2.2.3", "phishtank", None, "C", "US", "unknown", None, None, NOW - 180 * day),
        (5, "http://q.net/\\e", "q.net", "3.3.3.3", None, "phishing", "C", "US", "yes", NOW, "Mar 31 00:00:00 2024 GMT", NOW - 181 * day),
        (6, "http://p.net/", "p.net", "3.3.3.4", "urlhaus", "malware", "D", "FR", "yes", NOW, "Apr  1 00:00:00 2024 GMT", None),
    ]
    return spark.createDataFrame(
        rows,
        "id long, url string, domain string, ip_address string, source_feed string, threat_type string, "
        "target_brand string, country string, online string, first_seen timestamp_ntz, cert_valid_to string, "
        "creation_date timestamp_ntz",
    )


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


@pytest.mark.parametrize(
    "options,want",
    [
        ({}, [1, 2, 3, 4, 5, 6]),
        ({"text_search": "BANK"}, [1]),
        ({"text_search": "2.2.2"}, [3, 4]),
        ({"text_search": "c_d"}, [3, 4]),
        ({"text_search": "0%"}, [2]),
        ({"text_search": "\\e"}, [5]),
        ({"source_feeds": ["urlhaus"]}, [2, 6]),
        ({"threat_types": ["phishing"], "countries": ["US"]}, [1, 5]),
        ({"target_brands": ["B", "D"]}, [1, 3, 6]),
        ({"online_status": "All"}, [1, 2, 3, 4, 5, 6]),
        ({"online_status": "Yes"}, [1, 5, 6]),
        ({"online_status": "Unknown"}, [4]),
        ({"online_status": "Unknown", "unknown_includes_null": True}, [3, 4]),
        ({"date_from": "2024-02-02"}, [2, 3, 5, 6]),
        ({"date_to": date(2024, 2, 2)}, [1, 2]),
        ({"date_from": date(2024, 2, 1), "date_to": "2024-02-01"}, [1]),
        ({"ssl_expiring_soon": True}, [1, 5]),
        ({"ssl_expiring_soon": True, "cert_dates_as_iso": True}, [3]),
        ({"domain_age_buckets": ["new"]}, [1]),
        ({"domain_age_buckets": ["medium"]}, [3, 4]),
        ({"domain_age_buckets": ["old"]}, [5]),
        ({"domain_age_buckets": ["new", "old"]}, [1, 5]),
        ({"domain_age_buckets": ["new", "medium", "old"]}, [1, 3, 4, 5]),
        ({"text_search": "net", "online_status": "yes", "countries": ["FR"]}, [6]),
    ],
)
def test_filters(threats, options, want):
    assert ids(ThreatFilter(**options).apply(threats, NOW)) == want


def test_day_filters_need_a_point_in_time():
    with pytest.raises(ValueError):
        ThreatFilter(ssl_expiring_soon=True).condition()


def test_filters_reach_the_scan(spark, threats, tmp_path):
    path = str(tmp_path / "t")
    threats.write.parquet(path)
    stored = spark.read.parquet(path)
    chosen = ThreatFilter(source_feeds=["urlhaus"], online_status="Yes", date_from="2024-02-02", domain_age_buckets=["old"])
    plan = plan_of(chosen.apply(stored, NOW).select("id"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters")[1]
    for part in ("source_feed", "online", "first_seen", "creation_date"):
        assert part in pushed
    assert "cert_valid_to" not in pushed.split("ReadSchema")[1]


def test_search_and_details(threats):
    assert ids(filters.search(threats, "url", "net")) == [3, 4, 5, 6]
    assert ids(filters.search(threats, "domain", "x.")) == [2]
    assert ids(filters.search(threats, "ip", "3.3.3")) == [5, 6]
    assert ids(filters.search(threats, "id", "4")) == [4]
    with pytest.raises(ValueError):
        filters.search(threats, "id", "x")
    row = filters.row_details(threats, 1, NOW).first()
    assert (row.domain_age_days, row.cert_days_to_expiry) == (30, 9)
    row = filters.row_details(threats, 3, NOW).first()
    assert (row.domain_age_days, row.cert_days_to_expiry) == (31, None)


def test_pages_by_offset_and_by_last_row_agree(threats):
    everything = [r.id for r in paging.page(threats, 0, 10).collect()]
    assert everything == [5, 6, 3, 2, 1, 4]
    first, second = ([r.id for r in paging.page(threats, n, 2).collect()] for n in (0, 1))
    assert first + second == everything[:4]
    after = paging.page_after(threats, NOW, 6, 2)
    assert [r.id for r in after.collect()] == second
    assert [r.id for r in paging.page_after(threats, datetime(2024, 2, 1, 23, 59), 1, 5).collect()] == [4]
    assert paging.page_after(threats, None, 4).count() == 0
    own = paging.page(threats, 0, 3, order_by=[F.desc("id")])
    assert [r.id for r in own.collect()] == [6, 5, 4]


def test_reports(threats):
    kpi = analytics.kpis(threats, NOW).first()
    assert (kpi.total, kpi.new_7d, kpi.online, kpi.top_source, kpi.top_source_count) == (6, 2, 3, "phishtank", 2)
    assert (kpi.new_7d_pct, kpi.online_pct) == (33.33, 50.0)
    none = analytics.kpis(threats.where("id < 0"), NOW).first()
    assert (none.total, none.top_source, none.top_source_count, none.online_pct) == (0, "N/A", 0, 0.0)
    assert [tuple(r) for r in analytics.by_online_status(threats).collect()] == [("Online", 3), ("Unknown", 2), ("Offline", 1)]
    assert [tuple(r) for r in analytics.by_domain_age(threats, NOW).collect()] == [
        ("0-30 days", 1), ("31-90 days", 2), ("91-180 days", 1), ("181-365 days", 1),
    ]
    assert [tuple(r) for r in analytics.timeline(threats, datetime(2024, 3, 2, 12)).collect()] == [
        ("2024-02-01", 1), ("2024-02-02", 1), ("2024-02-03", 1), ("2024-03-01", 2),
    ]
    counted = {r.source: r["count"] for r in analytics.feed_counts({"a": threats, "b": threats.where("id < 0")}).collect()}
    assert counted == {"a": 6, "b": 0, "total": 6}


def test_kpis_read_the_table_once(spark, threats, tmp_path):
    path = str(tmp_path / "t")
    threats.write.parquet(path)
    plan = plan_of(analytics.kpis(spark.read.parquet(path), NOW))
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("FileScan") == 1


@pytest.mark.parametrize("count", [1500, 2000, 4000])
def test_first_rows_equal_a_plain_limit(spark, count):
    """Evenly spread, clustered, equal and missing keys."""
    keys = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id"))
        .when(F.col("id") % 3 == 1, F.xxhash64("id"))
        .when(F.col("id") % 2 == 0, F.lit(7))
        .alias("id")
    )
    got = [r.id for r in paging.first_rows(keys, count).collect()]
    want = [r.id for r in keys.orderBy("id").limit(count).collect()]
    assert got == want


def test_first_rows_of_nothing_and_of_one_key(spark):
    assert paging.first_rows(spark.range(0), 5000).count() == 0
    assert paging.first_rows(spark.createDataFrame([(3,)] * 10, "id long"), 5000).count() == 10
