from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators.upsert import dedup_feeds
from hooktrace.operators import paging, upsert
from hooktrace.plans import feedload
from hooktrace.schemas import RAW_LINE_FEED, RAW_MALWARE_FEED, RAW_PHISH_FEED
from hooktrace.sources.tables import conform

LATE = "2024-02-01 00:00:00"


def _rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_ignore_keeps_stored_rows_and_first_new_one(spark):
    stored = spark.createDataFrame([("a", 1)], "url string, n int")
    incoming = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5)], "url string, n int")
    merged = upsert.upsert_ignore(stored, incoming, "url", [F.asc("n")])
    assert _rows(merged, "url", "n") == [("a", 1), ("b", 2)]
    again = upsert.upsert_ignore(merged, incoming, "url", [F.asc("n")])
    assert _rows(again, "url", "n") == _rows(merged, "url", "n")


def test_replace_takes_the_last_row_and_may_keep_first_seen(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("c", 1, "x")], "url string, n int, seen string")
    incoming = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("b", 4, "z"), (None, 5, "z")], "url string, n int, seen string")
    latest = [F.desc("n")]
    assert _rows(upsert.upsert_replace(stored, incoming, "url", latest), "url", "n", "seen") == [
        ("a", 3, "z"), ("b", 4, "z"), ("c", 1, "x"),
    ]
    kept = upsert.upsert_replace(stored, incoming, "url", latest, keep=["seen"])
    assert _rows(kept, "url", "n", "seen") == [("a", 3, "x"), ("b", 4, "z"), ("c", 1, "x")]


def test_one_per_key_cuts_before_the_shuffle(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = plan_of(upsert.one_per_key(frame, "k", [F.desc("id")]))
    physical = plan[plan.index("== Physical Plan"):]
    exchange = physical.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in physical[exchange:] and "Partial" in physical[exchange:]


def test_stored_table_is_not_sorted_by_an_upsert(spark):
    """The large side only meets an anti-join; the window runs over the load alone."""
    stored = spark.range(1000).select(F.col("id").cast("string").alias("url"), F.lit(1).alias("n"))
    incoming = spark.createDataFrame([("5", 2)], "url string, n int")
    plan = plan_of(upsert.upsert_replace(stored, incoming, "url", [F.desc("n")]))
    physical = plan[plan.index("== Physical Plan"):]
    assert "LeftAnti" in physical
    assert physical.count("Window [") == 1


def test_feeds_precedence(spark):
    work = spark.createDataFrame(
        [("u", 0, None, "openphish"), ("u", 1, "9", "phishtank"), ("u", 1, "10", "phishtank"),
         ("v", 0, None, "openphish"), ("v", 2, None, "urlhaus"), (None, 2, None, "urlhaus")],
        "url string, feed_rank int, source_id string, source_feed string",
    )
    last = upsert.dedup_feeds(work)
    assert _rows(last, "url", "source_feed", "source_id") == [("u", "phishtank", "10"), ("v", "urlhaus", None)]
    first = upsert.dedup_feeds(work, first_wins=True)
    assert _rows(first, "url", "source_feed") == [("u", "openphish"), ("v", "openphish")]


def test_limit_orders(spark):
    work = spark.createDataFrame([(u, 0, None) for u in "abcd"], "url string, feed_rank int, source_id string")
    stored = spark.createDataFrame([("a",), ("b",)], "url string")
    assert _rows(paging.limit_work(work, 2, stored), "url") == [("c",), ("d",)]
    assert _rows(paging.limit_work(work, 2, stored, skip_first=False), "url") == []
    assert _rows(paging.limit_work(work, 2), "url") == [("a",), ("b",)]


def test_counts_of_a_load(spark):
    stored = spark.createDataFrame([(1,), (2,)], "k int")
    incoming = spark.createDataFrame([(2,), (2,), (3,), (None,), (None,)], "k int")
    assert tuple(upsert.upsert_counts(stored, incoming, "k").first()) == (1, 1, 2)


def test_exists_flag_and_skip(spark):
    work = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    stored = spark.createDataFrame([("a",), ("a",)], "url string")
    assert _rows(upsert.with_exists_flag(work, stored), "url", "is_enriched") == [("a", True), ("a", True), ("b", False)]
    assert _rows(upsert.skip_existing(work, stored), "url") == [("b",)]


def test_phish_update_keeps_load_time(spark):
    empty = spark.createDataFrame([], RAW_PHISH_FEED)
    one = conform(spark.createDataFrame([(1, "u1", "a"), (2, "u2", "a"), (None, "u3", "a"), (4, None, "a")], "phish_id long, url string, target string"), RAW_PHISH_FEED)
    first = feedload.load_phish_feed(empty, one, "2024-01-01 00:00:00")
    two = conform(spark.createDataFrame([(2, "u2b", "b"), (3, "u3", "b")], "phish_id long, url string, target string"), RAW_PHISH_FEED)
    second = feedload.load_phish_feed(first, two, LATE)
    got = _rows(second, "phish_id", "url", "target", F.date_format("inserted_at", "MM"))
    assert got == [(1, "u1", "a", "01"), (2, "u2b", "b", "01"), (3, "u3", "b", "02")]


def test_line_and_malware_loads_are_idempotent(spark):
    lines = spark.createDataFrame([("http://a/1", "a"), ("http://a/1", "a"), ("http://b/", "b")], "url string, domain string")
    once = feedload.load_line_feed(spark.createDataFrame([], RAW_LINE_FEED), lines, LATE)
    assert once.count() == 2
    assert feedload.load_line_feed(once, lines, LATE).count() == 2
    entries = conform(spark.createDataFrame([("u", "2024-01-02"), ("u", "2024-01-01")], "url string, url_dateadded string"), RAW_MALWARE_FEED)
    loaded = feedload.load_malware_feed(spark.createDataFrame([], RAW_MALWARE_FEED), entries, LATE)
    assert _rows(loaded, "url", "url_dateadded") == [("u", "2024-01-01")]


def test_equal_feed_rows_do_not_depend_on_order(spark):
    rows = [("u", "openphish", None, 0, f"t{i}") for i in range(9)]
    work = spark.createDataFrame(rows, "url string, source_feed string, source_id string, feed_rank int, target string")
    picked = {dedup_feeds(work.repartition(n)).first().target for n in (1, 3, 7)}
    assert picked == {"t0"}
