import ipaddress
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.operators import lookups
from hooktrace.operators.asof import join_as_of
from hooktrace.operators.ranges import block_marks, range_blocks, range_segments, segment_lookup

BASE = 0x20010DB8 << 96
LAST = 2**128 - 1


def _six(number):
    return str(ipaddress.IPv6Address(number))


def _ranges_and_addresses(rng):
    ranges = [(LAST - 4, LAST, "end"), (0, 3, "start"), (BASE, BASE + 2**96 - 1, "wide"), (9, 4, "empty"), (BASE, BASE, "one")]
    for n in range(60):
        low = BASE + rng.randrange(2**40)
        low = low >> 16 << 16 if rng.random() < 0.3 else low
        ranges.append((low, min(low + rng.choice([0, 1, 15, 255, 4096, 65535, 2**30, 2**38, 2**70]), LAST), f"r{n}"))
    near = {end + step for r in ranges for end in r[:2] for step in (-1, 0, 1)}
    return ranges, sorted({BASE + rng.randrange(2**40) for _ in range(200)} | {n for n in near if 0 <= n <= LAST})


@pytest.mark.parametrize("seed", range(2))
def test_text_ranges_equal_brute_force(spark, seed):
    """Ranges of both families that nest, overlap, repeat and touch the ends; unreadable ones are left out."""
    ranges, numbers = _ranges_and_addresses(random.Random(seed))
    rows = [(_six(lo), _six(hi), name) for lo, hi, name in ranges]
    rows += [("10.0.0.250", "10.0.1.4", "four"), ("255.255.255.0", "255.255.255.255", "last"), ("0.0.0.0", "::5", "mixed")]
    rows += [(None, "::9", "null"), ("x", "::9", "bad"), rows[7]]
    table = spark.createDataFrame(rows, "lo string, hi string, name string")
    fours = ["10.0.0.249", "10.0.0.250", "10.0.1.4", "10.0.1.5", "255.255.255.255", "0.0.0.0"]
    keys = [f"x{n:032x}" for n in numbers] + [str(int(ipaddress.IPv4Address(t))) for t in fours] + [None, "odd"]
    addresses = spark.createDataFrame([(k,) for k in keys], "ip string")
    found = lookups.address_lookup(addresses, table, ["name"]).collect()
    want = {str(int(ipaddress.IPv4Address(t))): n for t, n in zip(fours, [None, "four", "four", None, "last", None])}
    for number in numbers:
        holding = [r for r in ranges if r[0] <= number <= r[1]]
        if holding:
            want[f"x{number:032x}"] = min(holding, key=lambda r: (r[1] - r[0], r[0], r[2]))[2]
    assert len(found) == len({r.ip for r in found})
    assert {r.ip: r.name for r in found} == {k: v for k, v in want.items() if v}


def test_range_blocks_tile_their_range(spark):
    cases = [(3, 65543), (0, 2**32 - 1), (0x0A000000, 0x0AFFFFFF), (15, 15), (0x0A000001, 0x0A00FFFF), (2**28, 3 * 2**28 - 1)]
    rng = random.Random(3)
    cases += [(lo, lo + rng.randrange(2**20)) for lo in (rng.randrange(2**31) for _ in range(30))]
    table = spark.createDataFrame([(f"n{lo:08x}", f"n{hi:08x}") for lo, hi in cases], "lo string, hi string")
    low, high = F.col("lo"), F.col("hi")
    marked = table.withColumns(block_marks(low, high))
    for row in marked.withColumn("b", range_blocks(low, high, F.col("shared"), F.col("keep_lo"), F.col("keep_hi"))).collect():
        pieces = sorted((int(x[1:].ljust(8, "0"), 16), int(x[1:].ljust(8, "f"), 16)) for x in row.b)
        assert pieces[0][0] == int(row.lo[1:], 16) and pieces[-1][1] == int(row.hi[1:], 16)
        assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))


def test_no_ranges_and_no_addresses(spark):
    none = spark.createDataFrame([], "lo string, hi string, name string")
    one = spark.createDataFrame([("::1", "::2", "a")], "lo string, hi string, name string")
    ips = spark.createDataFrame([("x" + "0" * 31 + "1",)], "ip string")
    assert segment_lookup(ips, range_segments(none, ["name"])).count() == 0
    assert segment_lookup(ips.limit(0), range_segments(one, ["name"])).count() == 0
    plan = plan_of(segment_lookup(ips, range_segments(one, ["name"])))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _as_of(rows, captures):
    want = {}
    for number, key, at in rows:
        known = [c for c in captures if key is not None and at is not None and c[0] == key and (c[1] is None or c[1] <= at)]
        want[number] = max(known, key=lambda c: (c[1] is not None, c[1] or 0, -ord(c[2])))[2] if known else None
    return want


def test_as_of_equals_brute_force(spark):
    """Half of the rows have one key, many of them one time too; keys, times and capture times may be null."""
    rng = random.Random(4)
    pick = lambda values, empty: None if rng.random() < empty else rng.choice(values)
    rows = [(n, "hot" if n % 2 else pick(["a", "b", "c", "d"], 0.1), pick([5, 5, 5, *range(40)], 0.1)) for n in range(600)]
    captures = [(pick(["hot", "a", "b", "c", "x"], 0.1), pick(range(45), 0.1), rng.choice("pqrs")) for _ in range(60)]
    facts = spark.createDataFrame(rows, "id int, key string, at long")
    known = spark.createDataFrame(captures, "key string, captured_at int, v string")
    joined = join_as_of(facts, known, "key", "at", "captured_at", F.col("id"))
    assert joined.columns == ["id", "key", "at", "v"]
    got = joined.collect()
    assert len(got) == 600 and {r.id: r.v for r in got} == _as_of(rows, captures)
    assert {r.v for r in join_as_of(facts, known.limit(0), "key", "at", "captured_at", F.col("id")).collect()} == {None}
    assert join_as_of(facts.limit(0), known, "key", "at", "captured_at", F.col("id")).count() == 0


def test_rows_of_one_key_and_time_are_spread(spark):
    """All rows alike: the pass still cuts them into several partitions."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(8000).select("id", F.lit("hot").alias("key"), F.lit(7).alias("at"))
        known = spark.createDataFrame([("hot", 3, "old"), ("hot", 6, "new"), ("hot", 8, "late")], "key string, captured_at int, v string")
        joined = join_as_of(facts, known, "key", "at", "captured_at", F.col("id")).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part", "v").count().collect()]
        values = [r.v for r in joined.select("v").distinct().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert values == ["new"] and sum(sizes) == 8000 and len(sizes) > 1 and max(sizes) < 6000


def test_page_and_certificate_as_of(spark):
    rows = spark.createDataFrame([(1, "u", "d.com", 5), (2, "u", "d.com", 1)], "id int, url string, domain string, seen int")
    pages = spark.createDataFrame(
        [("u", 200, 2), ("u", 404, 9)], "url string, page_status int, captured_at int"
    )
    certs = spark.createDataFrame([("d.com", "CA", 4), ("d.com", "CB", 6)], "domain string, cert_issuer string, captured_at int")
    page = lookups.join_page(rows, pages, at="seen").collect()
    assert {r.id: r.page_status for r in page} == {1: 200, 2: None}
    cert = lookups.join_cert(rows, certs, at="seen").collect()
    assert {r.id: (r.ssl_enabled, r.cert_issuer) for r in cert} == {1: ("yes", "CA"), 2: ("no", None)}
