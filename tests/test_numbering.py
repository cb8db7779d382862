"""Row numbers and first rows of an order, against sorting on one machine."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hooktrace.operators import numbering
from hooktrace.operators.numbering import By
from hooktrace.sinks import export

NOW = "2024-02-05 00:00:00"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice([None, 1, 1, 1, 2, 7]), rng.choice([None, "a", "b", "ä", ""]), rng.choice([None, 0.5, -1.0]))
        for i in range(3000)
    ]
    rows += rows[:40]
    return rows, spark.createDataFrame(rows, "id long, rank int, name string, x double").repartition(7)


def _key(by):
    def one(value, b):
        null = value is None
        first = b.nulls_first if b.nulls_first is not None else not b.descending
        place = (0 if first else 2) if null else 1
        if null:
            return (place, 0)
        if isinstance(value, str):
            value = tuple(value.encode()) + (-1,)
            return (place, tuple(-v for v in value) if b.descending else value)
        return (place, -value if b.descending else value)

    return lambda row: tuple(one(row[b.name], b) for b in by)


ORDERS = [
    [By("id")],
    [By("rank"), By("name"), By("id")],
    [By("rank", descending=True), By("name", nulls_first=False), By("x", descending=True, nulls_first=True), By("id")],
    [By("x", descending=True), By("id", descending=True)],
]


@pytest.mark.parametrize("by", ORDERS, ids=["id", "three", "mixed", "descending"])
def test_numbers_follow_the_order(data, by):
    rows, frame = data
    got = numbering.numbered(frame, by).collect()
    assert sorted(r.row_no for r in got) == list(range(len(rows)))
    names = ("id", "rank", "name", "x")
    want = sorted((dict(zip(names, r)) for r in rows), key=_key(by))
    in_order = sorted(got, key=lambda r: r.row_no)
    assert [tuple(r[n] for n in names) for r in in_order] == [tuple(w.values()) for w in want]


@pytest.mark.parametrize("by", ORDERS, ids=["id", "three", "mixed", "descending"])
@pytest.mark.parametrize("count", [0, 1, 1500, 3040, 5000])
def test_first_rows_of_any_order(data, by, count):
    rows, frame = data
    names = ("id", "rank", "name", "x")
    want = sorted((dict(zip(names, r)) for r in rows), key=_key(by))[:count]
    got = [tuple(r) for r in numbering.first_in_order(frame, by, count).collect()]
    assert sorted(got, key=repr) == sorted((tuple(w.values()) for w in want), key=repr)


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, name string")
    assert numbering.numbered(empty, [By("id")]).count() == 0
    assert numbering.first_in_order(empty, [By("name"), By("id")], 10).count() == 0


def test_ties_are_broken_alike_and_a_hot_value_is_cut(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    first = {r.id for r in numbering.first_in_order(rows, [By("k")], 20_000).collect()}
    assert first == {r.id for r in numbering.first_in_order(rows.repartition(5), [By("k")], 20_000).collect()}
    kept = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        dealt = numbering._dealt(rows, [By("k"), By("__mix")]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 40_000 / 8


def test_bundles_hold_every_indicator_once(spark):
    rows = [(i, f"http://h{i}.example/'x", f"h{i}.example") for i in range(25)] + [(99, None, "lost.example")]
    threats = spark.createDataFrame(rows, "id long, url string, domain string").selectExpr(
        "*", "'phishing' AS threat_type", "CAST(NULL AS STRING) AS target_brand", "'yes' AS online",
        "CAST(NULL AS TIMESTAMP_NTZ) AS first_seen", "'feed' AS source_feed", "CAST(NULL AS STRING) AS ip_address",
        "CAST(NULL AS STRING) AS country", "CAST(NULL AS BIGINT) AS asn", "CAST(NULL AS STRING) AS asn_name",
        "CAST(NULL AS STRING) AS ssl_enabled",
    )
    made = export.stix_bundles(threats, NOW, size=10).orderBy("bundle_no").collect()
    assert [(r.bundle_no, r.indicators) for r in made] == [(0, 10), (1, 10), (2, 5)]
    bundles = [json.loads(r.bundle) for r in made]
    assert len({b["id"] for b in bundles}) == 3 and all(b["objects"][0]["type"] == "identity" for b in bundles)
    patterns = [o["pattern"] for b in bundles for o in b["objects"][1:]]
    assert patterns == [f"[url:value = 'http://h{i}.example/\\'x']" for i in range(25)]
    assert export.stix_bundles(threats.limit(0), NOW, size=10).count() == 0
    for size in (0, export.MAX_BUNDLE_ROWS + 1):
        with pytest.raises(ValueError, match="bundle"):
            export.stix_bundles(threats, NOW, size=size)
