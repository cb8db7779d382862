import pytest
from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.operators.upsert import dedup_feeds
from hooktrace.plans.enrichment import Snapshots, enrich
from hooktrace.sinks import store
from hooktrace.streaming import feeds

SF = "/root/testdata/sf0.001"


def _drop_folder(spark, tmp_path, rows, files):
    path = str(tmp_path / "drop")
    rows.repartition(files).write.parquet(path)
    return feeds.read_drop_folder(spark, path, rows.schema, files_per_batch=1)


def test_dedup_over_batches_equals_distinct(spark, tmp_path):
    rows = fx.obs(spark, SF).select("url", "first_seen")
    stream = _drop_folder(spark, tmp_path, rows, 4)
    query = feeds.run_available(
        feeds.dedup_stream(stream, "first_seen", "400 days"), str(tmp_path / "out"), str(tmp_path / "state")
    )
    assert len(query.recentProgress) >= 4
    got = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.url for r in rows.select("url").distinct().collect()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_daily_counts_equal_batch(spark, tmp_path, zone):
    rows = fx.obs(spark, SF).select("first_seen", "source_feed")
    stream = _drop_folder(spark, tmp_path, rows, 3)
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        feeds.run_available_complete(feeds.daily_counts(stream, "first_seen"), out, str(tmp_path / "state"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {tuple(r) for r in feeds.read_newest(spark, out).select("date", "source_feed", "count").collect()}
    want = rows.groupBy(F.date_format("first_seen", "yyyy-MM-dd"), "source_feed").count().collect()
    assert got == {tuple(r) for r in want}


def test_append_mode_holds_back_open_days(spark, tmp_path):
    rows = fx.obs(spark, SF).select("first_seen", "source_feed")
    stream = _drop_folder(spark, tmp_path, rows, 1)
    out = str(tmp_path / "out")
    feeds.run_available(feeds.daily_counts(stream, "first_seen", "1 day"), out, str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(out).select("date", "source_feed", "count").collect()}
    want = rows.groupBy(F.date_format("first_seen", "yyyy-MM-dd"), "source_feed").count().collect()
    assert 0 < len(got) < len(want) and got < {tuple(r) for r in want}


def test_enrich_stream_stores_each_url_once(spark, tmp_path):
    rows = fx.hosted_obs(spark, SF).drop("html")
    work = fx.raw_work(rows)
    snapshots = Snapshots(dns=fx.dim_dns(rows), city=fx.dim_geo(spark, SF), asn=fx.dim_asn(spark, SF))
    root, state = str(tmp_path / "threats"), str(tmp_path / "state")
    stream = _drop_folder(spark, tmp_path, work, 2)
    feeds.enrich_stream(stream, snapshots, root, state, fx.AS_OF)
    stored = store.current(spark, root)
    urls = [r.url for r in stored.select("url").collect()]
    assert len(urls) == len(set(urls)) == work.select("url").distinct().count()
    # The log holds each URL once too: later batches skipped what was stored.
    assert spark.read.parquet(f"{root}/log").count() == len(urls)

    batch = enrich(dedup_feeds(work), snapshots, fx.AS_OF)
    facts = ["url", "domain", "tld", "risk_score"]
    short = lambda frame: {tuple(r)[:3] for r in frame.select(*facts).collect()}
    assert short(stored) == short(batch)


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "threats")
    rows = fx.hosted_obs(spark, SF).drop("html")
    work = fx.raw_work(rows).select("*")
    urls = sorted(r.url for r in work.select("url").distinct().collect())
    for i, compact in enumerate((True, False, False)):
        part = work.where(F.col("url").isin(urls[i::3]))
        path = tmp_path / f"run{i}"
        path.mkdir()
        stream = _drop_folder(spark, path, part, 1)
        feeds.enrich_stream(stream, Snapshots(), root, str(path / "state"), fx.AS_OF)
        if compact:
            store.compact(spark, root)
    assert sorted(r.url for r in store.current(spark, root).collect()) == urls
