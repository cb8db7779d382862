"""Observations that cannot match anything are told without a shuffle."""

from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators import screening


def _threats(spark):
    return spark.range(500).select(
        F.concat(F.lit("http://bad"), F.col("id") % 100, F.lit(".evil.example/"), F.col("id")).alias("url"),
        (F.col("id") % 90).cast("int").alias("risk_score"),
    )


def test_only_possible_matches_pass(spark):
    threats = _threats(spark)
    log = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 100 == 0, F.concat(F.lit("http://bad7.evil.example/"), F.col("id")))
        .otherwise(F.concat(F.lit("http://h"), F.col("id"), F.lit(".site"), F.col("id"), F.lit(".org/")))
        .alias("url"),
    )
    log = log.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "no host")], "id long, url string"))
    best = screening.best_scores(threats)
    passed = screening.may_match(log, best)
    assert passed.count() == 6003
    assert 60 <= passed.where("__may_match").count() < 120
    plan = plan_of(passed)
    physical = plan[plan.index("== Physical Plan"):]
    assert "Exchange hashpartitioning(id" not in physical and "SortMergeJoin" not in physical
    got = {r.id: (r.match_level, r.match_score) for r in screening.screen_urls(log, threats).collect()}
    assert len(got) == 6003
    # Threats of bad7 are 7, 107, 207, 307, 407; their scores are the remainders by 90.
    top = max(i % 90 for i in range(7, 500, 100))
    assert {v for k, v in got.items() if k >= 0 and k % 100 == 0} == {("domain", top)}
    assert {v for k, v in got.items() if k < 0 or k % 100} == {(None, None)}


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    threats = _threats(spark)
    log = threats.select("url").limit(50).unionByName(spark.range(50).select(F.concat(F.lit("http://x"), "id", F.lit(".org/")).alias("url")))
    rows = lambda: sorted(map(tuple, screening.screen_urls(log, threats).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(screening, "FILTER_WORDS", 1)
    assert rows() == want


def test_no_threats_and_no_log(spark):
    threats = _threats(spark)
    log = spark.createDataFrame([("http://bad1.evil.example/1", 3)], "url string, domain_rank int")
    assert [tuple(r) for r in screening.screen_urls(log, threats.limit(0)).collect()] == [("http://bad1.evil.example/1", 3, None, None)]
    assert screening.screen_urls(log.limit(0), threats).count() == 0
