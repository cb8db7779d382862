"""Filters of keys, and stream deduplication against a stored table."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators import presence
from hooktrace.streaming import dedup, feeds

SCHEMA = "url string, seen timestamp_ntz, bucket int"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "url string, seen string, bucket int").withColumn("seen", F.col("seen").cast("timestamp_ntz"))


def _all(spark, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((r.url, str(r.seen)[:10], r.bucket) for r in dedup.read_rows(spark, root, schema).collect())


def test_filter_finds_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("int").alias("g"))
    bits = presence.key_bits(keys.unionByName(keys).union(spark.createDataFrame([(None, 0)], "k string, g int")), "k", "g", words=1 << 13)
    assert bits.groupBy("g").count().agg(F.max("count")).first()[0] <= 1 << 13

    def found(rows):
        named = rows.withColumn("word", presence.word_of(F.col("k"), words=1 << 13))
        return named.join(bits, ["g", "word"], "left").where(presence.may_hold(F.col("bits"), F.col("k"))).count()

    assert found(keys) == 20_000
    others = keys.withColumn("k", F.concat(F.lit("no "), "k"))
    assert found(others) < 400


def test_first_batch_of_a_key_counts(spark, tmp_path):
    root = str(tmp_path / "seen")
    one = [("a", "2024-01-03", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3), (None, "2024-01-01", 4), ("n", None, 9), ("n", "2024-01-09", 8)]
    dedup.add_new(_rows(spark, one), root, ("w", 0), "seen")
    kept = [("a", "2024-01-02", 2), ("b", "2024-01-01", 3), ("n", "2024-01-09", 8)]
    assert _all(spark, root) == kept
    dedup.add_new(_rows(spark, [("a", "2023-01-01", 5), ("c", "2024-01-05", 6), ("c", "2024-01-05", 6)]), root, ("w", 1), "seen")
    kept.insert(2, ("c", "2024-01-05", 6))
    assert _all(spark, root) == kept
    # An older batch that runs again does not see the later one, another writer sees all.
    dedup.add_new(_rows(spark, one), root, ("w", 0), "seen")
    dedup.add_new(_rows(spark, [("c", "2020-01-01", 0), ("d", "2024-01-06", 7)]), root, ("other", 0), "seen")
    assert _all(spark, root) == sorted([*kept, ("d", "2024-01-06", 7)])
    dedup.add_new(_rows(spark, []), root, ("other", 1), "seen")
    assert len(_all(spark, root)) == 5


def test_unfinished_batches_do_not_count(spark, tmp_path):
    root = str(tmp_path / "seen")
    assert _all(spark, root) == []
    dedup.add_new(_rows(spark, [("a", "2024-01-01", 1)]), root, ("w", 0), "seen")
    # Rows of a batch that stopped before its filter was written.
    _rows(spark, [("b", "2024-01-01", 1)]).withColumn("key_bucket", F.lit(0)).write.partitionBy("key_bucket").parquet(
        f"{root}/rows/writer=w/batch_id=1"
    )
    assert [r[0] for r in _all(spark, root)] == ["a"]
    dedup.add_new(_rows(spark, [("b", "2024-01-02", 2), ("a", "2024-01-02", 2)]), root, ("w", 1), "seen")
    assert _all(spark, root) == [("a", "2024-01-01", 1), ("b", "2024-01-02", 2)]


def test_a_hot_key_is_cut_before_the_shuffle(spark, tmp_path):
    batch = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS url",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS seen", "CAST(id AS INT) AS bucket",
    )
    fresh = dedup._unseen(batch, str(tmp_path / "none"), ("w", 0), "seen", "url")
    assert fresh.count() == 2001
    plan = plan_of(fresh)
    physical = plan[plan.index("== Physical Plan"):]
    # One row per key and task goes on (the plan is printed from its end).
    assert "WindowGroupLimit" in physical[physical.index("Exchange"):]


@pytest.mark.parametrize("files", [1, 4])
def test_streams_that_start_anew_store_each_key_once(spark, tmp_path, files):
    rows = spark.range(400).selectExpr("concat('u', id % 90) AS url", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS seen", "0 AS bucket")
    rows.repartition(files).write.parquet(str(tmp_path / "drop"))
    root = str(tmp_path / "seen")
    for state in ("one", "two"):
        stream = feeds.read_drop_folder(spark, str(tmp_path / "drop"), rows.schema, files_per_batch=1)
        dedup.dedup_into(stream, root, str(tmp_path / state), "seen")
    assert sorted(r[0] for r in _all(spark, root)) == sorted({f"u{i}" for i in range(90)})
