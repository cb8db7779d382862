"""Rescoring by due date against rescoring everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hooktrace.plans import rescore
from hooktrace.plans.enrichment import with_score

START = datetime(2024, 2, 1, 6)
SCHEMA = "id long, url string, http_status_code int, online string, last_seen timestamp_ntz, creation_date timestamp_ntz, tld string, extra string"


def _threats(spark, n=300):
    rng = random.Random(3)

    def moment():
        # Many lie on a step exactly, some in the future, some are missing.
        if rng.random() < 0.1:
            return None
        if rng.random() < 0.4:
            return START - timedelta(days=rng.choice([3, 4, 7, 8, 14, 15, 30, 31, 90, 91, 2, 1, 0, -1]))
        return START - timedelta(hours=rng.randrange(-100, 2400), seconds=rng.randrange(3600))

    rows = [(i, f"http://h{i}.example/", 200, "yes", moment(), moment(), ".example", "x") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _scores(frame):
    return {r.id: r.risk_score for r in frame.select("id", "risk_score").collect()}


@pytest.mark.parametrize("calendar", [False, True])
def test_equals_a_full_rescore_at_every_moment(spark, tmp_path, calendar):
    threats, root = _threats(spark), str(tmp_path / "scores")
    rescore.write_scores(threats.where("id < 250"), root, START, calendar=calendar)
    rescore.add_scores(threats.where("id >= 250"), root, START, calendar=calendar)
    for after in (timedelta(0), timedelta(microseconds=1), timedelta(days=1), timedelta(days=3, hours=7), timedelta(days=40)):
        now = START + after
        rescore.rescore_due(spark, root, now, calendar=calendar)
        want = with_score(threats, now.isoformat(sep=" "), calendar=calendar)
        assert _scores(rescore.current_scores(spark, root)) == _scores(want), after


def test_reads_only_what_has_come_due(spark, tmp_path):
    threats, root = _threats(spark), str(tmp_path / "scores")
    rescore.write_scores(threats, root, START)
    before = {r.id: r.next_change for r in rescore.current_scores(spark, root).collect()}
    later = START + timedelta(days=2)
    due = {r.id for r in rescore.due_rows(spark, root, later).collect()}
    assert due == {i for i, at in before.items() if at is not None and at.date() <= later.date()}
    assert 0 < len(due) < 200
    rescore.rescore_due(spark, root, later)
    files = rescore.current_scores(spark, root).inputFiles()
    assert any("version=0/" in f for f in files) and any("version=1/" in f for f in files)
    days = [f.split("due_day=")[1][:10] for f in files if "version=0/" in f]
    assert all(d > later.date().isoformat() for d in days)


def test_unfinished_versions_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "scores")
    assert rescore.current_scores(spark, root).count() == 0
    threats = _threats(spark, 20)
    assert rescore.write_scores(threats, root, "2024-02-01 06:00:00") == 0
    want = _scores(rescore.current_scores(spark, root))
    # Folders of a version without its mark, as a lost job leaves them.
    rescore.current_scores(spark, root).withColumn("due_day", F.lit("2024-02-02")).write.partitionBy("due_day").parquet(f"{root}/scores/version=1")
    assert _scores(rescore.current_scores(spark, root)) == want
    assert rescore.rescore_due(spark, root, "2024-02-01 06:00:00") == 1
    assert _scores(rescore.current_scores(spark, root)) == want
    assert rescore.write_scores(threats.limit(0), root, START) == 2
    assert rescore.current_scores(spark, root).count() == 0
