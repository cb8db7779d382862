import csv
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hooktrace.schemas import ENRICHED
from hooktrace.sinks import export, store
from hooktrace.sources.tables import conform

NOW = "2024-02-05 00:00:00"


def _threats(spark, rows):
    frame = spark.createDataFrame(
        rows,
        "id long, url string, domain string, online string, asn long, threat_type string, target_brand string, "
        "source_feed string, first_seen timestamp_ntz",
    )
    return conform(frame, ENRICHED)


SEEN = datetime(2024, 1, 2, 3, 4, 5, 678000)


@pytest.fixture
def threats(spark):
    return _threats(
        spark,
        [
            (2, "http://a/'q'\\b", "a", "yes", 5, "phishing", "Brand", "openphish", SEEN),
            (1, 'http://b/,"x"', None, "no", 0, "", None, "urlhaus", None),
            (3, "", "c", "no", None, None, None, "urlhaus", SEEN),
        ],
    )


def test_csv_round_trip(spark, threats, tmp_path):
    path = tmp_path / "out"
    export.write_csv(threats, str(path))
    lines = [row for file in sorted(path.glob("*.csv")) for row in csv.reader(file.open())]
    assert lines[0] == ENRICHED.names
    assert sorted(row[1] for row in lines if row != lines[0]) == ["", "http://a/'q'\\b", 'http://b/,"x"']
    export.write_csv(threats, str(tmp_path / "one"), limit=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 1


def test_indicators(threats):
    rows = {r.id: json.loads(r.indicator) for r in export.stix_indicators(threats, NOW).collect()}
    assert set(rows) == {1, 2}
    full = rows[2]
    assert full["pattern"] == "[url:value = 'http://a/\\'q\\'\\\\b']"
    assert full["labels"] == ["phishing", "targets-Brand", "active"]
    assert full["created"] == full["modified"] == full["valid_from"] == "2024-01-02T03:04:05.678Z"
    assert full["x_asn"] == 5 and "x_country" not in full
    bare = rows[1]
    assert "labels" not in bare and "x_asn" not in bare
    assert bare["name"] == "Phishing URL: Unknown"
    assert bare["created"] == "2024-02-05T00:00:00.000Z"
    ids = [r["id"] for r in rows.values()]
    assert len(set(ids)) == 2 and all(len(i) == len("indicator--") + 36 for i in ids)


def test_bundle_is_one_document(threats, tmp_path):
    bundle = json.loads(export.stix_bundle(threats, NOW, limit=10).first()[0])
    assert [o["type"] for o in bundle["objects"]] == ["identity", "indicator", "indicator"]
    assert bundle["type"] == "bundle" and len(bundle["id"]) == len("bundle--") + 36
    assert bundle["objects"][0]["name"] == "Threat feed analytics"
    again = json.loads(export.stix_bundle(threats, NOW, limit=10).first()[0])
    assert again == bundle
    with pytest.raises(ValueError):
        export.stix_bundle(threats, NOW, limit=export.MAX_BUNDLE_ROWS + 1)
    export.write_stix(threats, str(tmp_path / "s"), NOW, limit=None)
    lines = [line for f in Path(tmp_path / "s").glob("*.txt") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and all(json.loads(line)["type"] == "indicator" for line in lines)


def _load(spark, *rows):
    return _threats(spark, [(i, url, "d", online, 1, "t", None, "urlhaus", seen) for i, url, online, seen in rows])


def test_store_keeps_last_load_and_first_sighting(spark, tmp_path):
    root = str(tmp_path / "threats")
    day = lambda n: datetime(2024, 1, n)
    assert store.current(spark, root).count() == 0
    store.append_batch(_load(spark, (1, "a", "yes", day(1)), (2, "b", "yes", day(1))), root, 0)
    store.append_batch(_load(spark, (3, "a", "no", day(5)), (4, "c", "no", day(5))), root, 1)
    show = lambda **o: sorted((r.url, r.id, r.online, r.first_seen.day) for r in store.current(spark, root, **o).collect())
    want = [("a", 3, "no", 1), ("b", 2, "yes", 1), ("c", 4, "no", 5)]
    assert show() == want
    assert show(reset_first_seen=True) == [("a", 3, "no", 5), ("b", 2, "yes", 1), ("c", 4, "no", 5)]
    assert show(through=0) == [("a", 1, "yes", 1), ("b", 2, "yes", 1)]

    # The same load again is an error, and as a retry changes nothing.
    again = _load(spark, (3, "a", "no", day(5)), (4, "c", "no", day(5)))
    with pytest.raises(FileExistsError):
        store.append_batch(again, root, 1)
    store.append_batch(again, root, 1, retry=True)
    assert show() == want
    assert store.compact(spark, root) == 0
    assert show() == want
    with pytest.raises(FileExistsError):
        store.append_batch(again, root, 1)
    store.append_batch(again, root, 1, retry=True)
    store.append_batch(_load(spark, (9, "b", "no", day(9))), root, 2)
    assert show() == [("a", 3, "no", 1), ("b", 9, "no", 1), ("c", 4, "no", 5)]
    assert store.compact(spark, root) == 1
    assert store.compact(spark, root) == 1
    assert show() == [("a", 3, "no", 1), ("b", 9, "no", 1), ("c", 4, "no", 5)]


def test_late_loads_and_other_writers_are_read(spark, tmp_path):
    root = str(tmp_path / "threats")
    day = lambda n: datetime(2024, 1, n)
    store.append_batch(_load(spark, (1, "a", "yes", day(5))), root, 5)
    store.compact(spark, root)
    store.append_batch(_load(spark, (2, "a", "no", day(3)), (3, "b", "no", day(3))), root, 3)
    store.append_batch(_load(spark, (4, "c", "no", day(3))), root, 5, writer="other")
    show = lambda: sorted((r.url, r.id, r.first_seen.day) for r in store.current(spark, root).collect())
    want = [("a", 1, 3), ("b", 3, 3), ("c", 4, 3)]
    assert show() == want
    store.compact(spark, root)
    assert show() == want


def test_plans_of_the_store(spark, tmp_path):
    root = str(tmp_path / "threats")
    store.append_batch(_load(spark, (1, "a", "yes", SEEN), (2, "b", "yes", SEEN)), root, 0)
    store.compact(spark, root)
    store.append_batch(_load(spark, (3, "a", "no", SEEN)), root, 1)
    spark.sparkContext.setJobGroup("plan", "building")
    rows = store.current(spark, root)
    found = store.lookup(spark, root, url="a")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("rest", "")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # The bucket of "a" is merged, that of "b" is read as it is: the shuffle is on one side of the union.
    assert plan.count("FileScan") == 3 and plan.count("Exchange hashpartitioning") == 1
    last = plan[plan.rindex(":-") if ":-" in plan else 0 :]
    assert "Union" in plan and last.count("FileScan") >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == plan.count("FileScan") >= 2
    assert [r.id for r in found.collect()] == [3]
    assert store.lookup(spark, root, url="zzz").count() == 0
    with pytest.raises(ValueError):
        store.lookup(spark, root)


def test_last_write_wins_whatever_wrote_it(spark, tmp_path):
    """A high load number of one writer does not beat a later load of another, before and after merging."""
    root = str(tmp_path / "threats")
    day = lambda n: datetime(2024, 1, n)
    show = lambda: sorted((r.url, r.id, r.online) for r in store.current(spark, root).collect())
    store.append_batch(_load(spark, (1, "a", "yes", day(1)), (2, "b", "yes", day(9))), root, 57, writer="stream-a")
    store.append_batch(_load(spark, (3, "a", "no", day(2)), (4, "b", "no", day(2))), root, 0, writer="stream-b")
    want = [("a", 3, "no"), ("b", 4, "no")]
    assert show() == want
    # A late load of the first writer yields to its own later one, and so to what came after that.
    store.append_batch(_load(spark, (6, "a", "late", day(4)), (7, "c", "late", day(4))), root, 56, writer="stream-a")
    want.append(("c", 7, "late"))
    assert show() == want
    # A load that runs again keeps its place.
    store.append_batch(_load(spark, (8, "b", "again", day(9))), root, 57, writer="stream-a", retry=True)
    assert show() == want
    store.compact(spark, root)
    assert show() == want
    store.append_batch(_load(spark, (5, "a", "yes", day(1))), root, 0, writer="stream-c")
    store.append_batch(_load(spark, (9, "b", "yes", day(1))), root, 58, writer="stream-a")
    assert show() == [("a", 5, "yes"), ("b", 9, "yes"), ("c", 7, "late")]


def test_merging_leaves_other_buckets_as_they_are(spark, tmp_path):
    root, day = tmp_path / "threats", datetime(2024, 1, 1)
    urls = [f"u{i}" for i in range(200)]
    store.append_batch(_load(spark, *[(i, u, "yes", day) for i, u in enumerate(urls)]), str(root), 0)
    assert store.compact(spark, str(root)) == 0
    bytes_of = lambda v: {p.relative_to(root): p.read_bytes() for p in (root / f"base/version={v}").rglob("*.parquet")}
    before = bytes_of(0)
    store.append_batch(_load(spark, (999, "u7", "no", datetime(2024, 1, 2))), str(root), 1)
    want = sorted((u, 999 if u == "u7" else i) for i, u in enumerate(urls))
    show = lambda: sorted((r.url, r.id) for r in store.current(spark, str(root)).collect())
    assert show() == want
    assert store.compact(spark, str(root)) == 1
    assert bytes_of(0) == before and len({p.parent.name for p in before}) == store.BUCKETS
    assert len({p.parent.name for p in bytes_of(1)}) == 1 and show() == want
    assert [r.id for r in store.lookup(spark, str(root), url="u7").collect()] == [999]
    assert store.stored_urls(spark, str(root)).count() == 200


def test_stored_urls(spark, tmp_path):
    root = str(tmp_path / "threats")
    assert store.stored_urls(spark, root).count() == 0
    store.append_batch(_load(spark, (1, "a", "yes", SEEN)), root, 0)
    store.compact(spark, root)
    store.append_batch(_load(spark, (2, "b", "yes", SEEN)), root, 1)
    urls = lambda **o: sorted(r.url for r in store.stored_urls(spark, root, **o).collect())
    assert urls() == ["a", "b"] and urls(before=("main", 1)) == ["a"] and urls(before=("x", 0)) == ["a", "b"]
    files = "FileScan"
    plan = store.stored_urls(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert files in plan and "ReadSchema: struct<url:string>" in plan


def test_unfinished_load_is_not_read(spark, tmp_path):
    root = str(tmp_path / "threats")
    store.append_batch(_load(spark, (1, "a", "yes", SEEN)), root, 0)
    store.append_batch(_load(spark, (2, "b", "yes", SEEN)), root, 1)
    (tmp_path / "threats/log/writer=main/batch_id=1/_SUCCESS").unlink()
    assert [r.url for r in store.current(spark, root).collect()] == ["a"]


def test_rows_without_a_score_column_read_as_zero(spark, tmp_path):
    root = str(tmp_path / "threats")
    old = _load(spark, (1, "a", "yes", SEEN)).drop("risk_score").withColumn("bucket", F.lit(0))
    old.write.partitionBy("bucket").parquet(f"{root}/log/writer=main/batch_id=0")
    store.append_batch(_load(spark, (2, "b", "yes", SEEN)).withColumn("risk_score", F.lit(7)), root, 1)
    assert {r.url: r.risk_score for r in store.current(spark, root).collect()} == {"a": 0, "b": 7}


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch, tmp_path):
    from hooktrace.sinks.shared import shared_folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, folder = "local-cluster[2,1,1024]", None

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.folder

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session(), "x")
    Session.sparkContext.folder = str(tmp_path)
    assert shared_folder(Session(), "x").startswith(f"{tmp_path}/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
