import ipaddress
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hooktrace.functions.ipaddr import ip_key, ipv6_hex
from hooktrace.operators import lookups, skew
from hooktrace.operators.screening import screen_urls


def _narrowest(ip, ranges):
    holding = [r for r in ranges if r[0] <= ip <= r[1]]
    return min(holding, key=lambda r: (r[1] - r[0], r[0], r[2]))[2] if holding else None


@pytest.mark.parametrize("seed", range(3))
def test_range_lookup_equals_brute_force(spark, seed):
    """Random ranges that nest, overlap and touch the ends of the address space."""
    rng = random.Random(seed)
    ranges = [(0, 5, "low"), (2**32 - 3, 2**32 - 1, "high"), (7, 7, "one")]
    for n in range(60):
        lo = rng.randrange(2**20)
        ranges.append((lo, min(lo + rng.choice([0, 1, 3, 255, 4097, 65536, 300_000]), 2**32 - 1), f"r{n}"))
    ranges.append((100, 90, "empty"))
    ips = sorted({rng.randrange(2**20 + 400_000) for _ in range(400)} | {0, 5, 6, 7, 8, 2**32 - 1, 2**32 - 4})
    found = lookups.range_lookup(
        spark.createDataFrame([(i,) for i in ips], "ip long"),
        spark.createDataFrame(ranges, "lo long, hi long, name string"),
        ["name"],
    )
    got = {r.ip: r.name for r in found.collect()}
    want = {ip: _narrowest(ip, ranges) for ip in ips}
    assert got == {ip: name for ip, name in want.items() if name is not None}


def test_blocks_tile_their_range(spark):
    rng = random.Random(5)
    cases = [(0, 2**20), (1, 1), (65535, 131073), (0, 65535)]
    cases += [(lo, lo + rng.randrange(400_000)) for lo in (rng.randrange(10**6) for _ in range(40))]
    frame = spark.createDataFrame(cases, "lo long, hi long")
    rows = frame.select("lo", "hi", lookups.range_blocks(F.col("lo"), F.col("hi")).alias("b")).collect()
    for row in rows:
        pieces = sorted((x.block << x.bits, (x.block + 1 << x.bits) - 1) for x in row.b)
        assert pieces[0][0] == row.lo and pieces[-1][1] == row.hi
        assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))
        assert len(pieces) <= 2 * lookups.BLOCK_BITS + (row.hi - row.lo) // 65536 + 1


def test_no_ranges_at_all(spark):
    ips = spark.createDataFrame([(1,)], "ip long")
    none = spark.createDataFrame([], "lo long, hi long, name string")
    assert lookups.range_lookup(ips, none, ["name"]).count() == 0


def test_range_lookup_has_no_nested_loop(spark):
    ips = spark.createDataFrame([(1,)], "ip long")
    ranges = spark.createDataFrame([(1, 2, "a")], "lo long, hi long, name string")
    plan = plan_of(lookups.range_lookup(ips, ranges, ["name"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_longest_prefix_wins(spark):
    rdap = spark.createDataFrame(
        [("10.0.0.0/8", 1), ("10.1.0.0/16, 10.2.0.0/16", 2), ("10.1.2.0/24", 3), ("bad", 9), (None, 8)],
        "cidr_block string, asn long",
    ).selectExpr("*", "'n' AS asn_name", "'i' AS isp", "'c' AS country")
    texts = ["10.1.2.3", "10.1.3.3", "10.2.0.1", "10.9.9.9", "11.0.0.1", "x"]
    rows = spark.createDataFrame([(t, t) for t in texts], "url string, ip_address string")
    resolved = lookups.resolve_ips(lookups.distinct_ips(rows.select("ip_address")), rdap=rdap)
    got = {r.url: r.rdap_asn for r in lookups.join_ip(rows, resolved).collect()}
    assert got == dict(zip(texts, [3, 2, 2, 1, None, None]))


@pytest.mark.parametrize("limit", [1, 100])
def test_balanced_join_equals_left_join(spark, limit):
    """One key with a third of the rows, another third without a key, the rest spread out."""
    facts = spark.range(3000).select(
        "id",
        F.when(F.col("id") < 1000, "hot")
        .when(F.col("id") >= 2000, F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
        .alias("key"),
    )
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "key string, v int")
    joined = skew.balanced_left_join(facts, dim, "key", F.col("id"), rows_per_slice=20, limit=limit)
    plain = facts.join(dim, "key", "left").select("id", "key", "v")
    assert joined.columns == ["key", "id", "v"]
    by_id = lambda frame: sorted((tuple(r) for r in frame.select("id", "key", "v").collect()), key=lambda r: r[0])
    assert by_id(joined) == by_id(plain)


def test_heavy_keys_are_sliced_by_size(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("key"))
    assert [tuple(r) for r in skew.heavy_keys(facts, "key", rows_per_slice=100).collect()] == [("hot", 9)]


def test_slices_spread_a_hot_key_over_tasks(spark):
    facts = spark.range(10_000).select("id", F.lit("hot").alias("key"))
    dim = spark.createDataFrame([("hot", 1)], "key string, v int")
    before = {
        k: spark.conf.get(k, None)
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.balanced_left_join(facts, dim, "key", F.col("id"), rows_per_slice=500)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sum(r["count"] for r in sizes) == 10_000
    assert max(r["count"] for r in sizes) < 6_000 and len(sizes) > 1


def test_snapshot_with_repeated_keys_keeps_row_count(spark):
    rows = spark.createDataFrame([("u1", "a.com", None), ("u2", "b.com", "9.9.9.9")], "url string, domain string, ip_address string")
    dns = spark.createDataFrame([("a.com", "2.2.2.2"), ("a.com", "1.1.1.1"), ("b.com", "3.3.3.3")], "domain string, ip_address string")
    got = {r.url: r.ip_address for r in lookups.join_dns(rows, dns).collect()}
    assert got == {"u1": "1.1.1.1", "u2": "9.9.9.9"}


def test_whois_and_cert_shapes(spark):
    rows = spark.createDataFrame([("u1", "x.a.co.uk"), ("u2", "b.com")], "url string, domain string")
    whois = spark.createDataFrame(
        [("a.co.uk", ["R1", "R2"], ["n1", "n2"]), ("b.com", [], [])],
        "base_domain string, registrar array<string>, name_servers array<string>",
    )
    got = {r.url: (r.registrar, r.name_servers) for r in lookups.join_whois(rows, whois).collect()}
    assert got == {"u1": ("R1", "n1,n2"), "u2": (None, None)}
    certs = spark.createDataFrame(
        [("b.com", {"organizationName": "Org", "commonName": "CN"}, {"commonName": "b.com"})],
        "domain string, issuer map<string,string>, subject map<string,string>",
    )
    got = {r.url: (r.ssl_enabled, r.cert_issuer, r.cert_subject) for r in lookups.join_cert(rows, certs).collect()}
    assert got == {"u1": ("no", None, None), "u2": ("yes", "Org", "b.com")}


def test_small_stored_table_is_joined_without_slices(spark, tmp_path):
    path = str(tmp_path / "dim")
    spark.createDataFrame([("a", 1)], "key string, v int").write.parquet(path)
    facts = spark.range(10).select("id", F.when(F.col("id") < 5, "a").alias("key"))
    joined = skew.balanced_left_join(facts, spark.read.parquet(path), "key", F.col("id"))
    plan = plan_of(joined)
    physical = plan[plan.index("== Physical Plan"):]
    assert "BroadcastHashJoin" in physical and "hashpartitioning" not in physical
    assert joined.where("v = 1").count() == 5 and joined.count() == 10


def test_repeated_ranges_make_no_pairs(spark):
    """A block repeated for every address meets each address once."""
    ranges = spark.range(300).selectExpr("0L AS lo", "65535L AS hi", "concat('r', id) AS name")
    ips = spark.range(500).selectExpr("id AS ip")
    found = lookups.range_lookup(ips, ranges.unionByName(ranges.selectExpr("lo", "255L AS hi", "'in' AS name")), ["name"])
    assert {(r.ip, r.name) for r in found.collect()} == {(i, "in" if i < 256 else "r0") for i in range(500)}
    pieces = lookups.narrowest_pieces(ranges, ["name"])
    assert [(r.bits, r.block, r.name) for r in pieces.collect()] == [(16, 0, "r0")]


def test_ipv6_keys(spark):
    texts = [
        "::", "::1", "1::", "2001:0DB8:0:0:0:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3",
        "12345::", "g::", "1.2.3.4", ":1:2", None, "", "[fe80::1]", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", ":::",
    ]

    def plain(text):
        try:
            return format(int(ipaddress.IPv6Address(text.strip("[]").split("%")[0])), "032x")
        except (AttributeError, ValueError):
            return None

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", ipv6_hex(F.col("t")).alias("h"), ip_key(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.h for r in rows] == [plain(t) for t in texts]
    assert rows[10].k == str(0x01020304) and rows[1].k == "x" + "0" * 31 + "1"


def test_longest_ipv6_prefix_wins(spark):
    blocks = ["2001:db8::/32", "2001:db8:8000::/33", "2001:db8:8000::/46, 10.0.0.0/8", "bad/40", "::/129", None]
    rdap = spark.createDataFrame([(b, i) for i, b in enumerate(blocks)], "cidr_block string, asn long").selectExpr(
        "*", "'n' AS asn_name", "'i' AS isp", "'c' AS country"
    )
    texts = ["2001:db8:8003::9", "2001:db8:8004::9", "2001:db8:1::", "2001:db9::", "10.3.3.3"]
    rows = spark.createDataFrame([(t, t) for t in texts], "url string, ip_address string")
    resolved = lookups.resolve_ips(lookups.distinct_ips(rows.select("ip_address")), rdap=rdap)
    got = {r.url: r.rdap_asn for r in lookups.join_ip(rows, resolved).collect()}
    assert got == dict(zip(texts, [2, 1, 0, None, 2]))


def test_failed_page_fetch(spark):
    pages = spark.createDataFrame(
        [("a", None, "connection", "x"), ("b", None, "timeout", "x"), ("c", 200, None, "x"), ("d", 404, None, "x")],
        "url string, status int, failure string, html string",
    )
    got = {r.url: r.page_online for r in lookups.page_columns(pages).collect()}
    assert got == {"a": "no", "b": "unknown", "c": "yes", "d": "no"}


def test_whois_dates_and_captures(spark):
    whois = spark.createDataFrame(
        [("a.com", "2024-01-01", "New", "before Aug-1996"), ("a.com", "2023-01-01", "Aaa", "2020-01-01"),
         ("b.com", None, "B", " 2020-05-06T07:08:09+02:00 ")],
        "base_domain string, captured_at string, registrar string, creation_date string",
    )
    rows = spark.createDataFrame([("u", "x.a.com"), ("v", "b.com")], "url string, domain string")
    got = {r.url: (r.registrar, r.creation_date and str(r.creation_date)) for r in lookups.join_whois(rows, whois).collect()}
    assert got == {"u": ("New", None), "v": ("B", "2020-05-06 05:08:09")}


def test_screening_keeps_owners_apart(spark):
    threats = spark.createDataFrame(
        [("http://1.2.3.4/y", 90), ("http://evil.vercel.app/", 80), ("http://a.bad.com/", 70), ("http://[2001:db8::1]/", 60)],
        "url string, risk_score int",
    )
    urls = ["http://9.9.3.4/x", "http://1.2.3.4/z", "http://good.vercel.app/", "http://x.evil.vercel.app/", "http://b.bad.com/", "http://[2001:db8::2]/"]
    observed = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(9, urls[1]), (10, None)], "id int, url string")
    found = screen_urls(observed, threats)
    got = {r.id: (r.match_level, r.match_score) for r in found.collect()}
    assert got == {
        0: (None, None), 1: ("domain", 90), 2: (None, None), 3: ("base_domain", 80), 4: ("base_domain", 70),
        5: (None, None), 9: ("domain", 90), 10: (None, None),
    }
