import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hooktrace.operators.graph import connected_components
from hooktrace.operators.screening import campaign_components, campaign_members


def roots_of(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        return x if up[x] == x else find(up[x])

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        else:
            find(a if a is not None else b) if (a, b) != (None, None) else None
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("rows_per_slice", [4_000_000, 5])
def test_components_equal_union_find(spark, rows_per_slice):
    draw = random.Random(7)
    pairs = [(f"n{draw.randrange(150)}", f"n{draw.randrange(150)}") for _ in range(90)]
    pairs += [("hub", f"h{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    pairs += [("self", "self"), ("n1", None), (None, "alone"), (None, None), pairs[0]]
    got = connected_components(spark.createDataFrame(pairs, "a string, b string"), rows_per_slice)
    assert {r.node: r.root for r in got.collect()} == roots_of(pairs) and got.count() == len(roots_of(pairs))
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


COLUMNS = (
    "url string, ip_address string, asn long, target_brand string, first_seen string, last_seen string, risk_score int"
)


def brute(rows, by):
    """URL to campaign name, by union of all names that rows hold."""
    from hooktrace.functions.scoring import HOSTING_PLATFORMS

    def site(url):
        host = url.split("/")[2] if "//" in url else None
        if host is None or host.replace(".", "").isdigit():
            return host
        n = next((p.count(".") + 1 for p in HOSTING_PLATFORMS if host.endswith(p)), 2)
        return ".".join(host.split(".")[-n:])

    names = {}
    pairs = []
    for url, ip, asn, brand, *_ in rows:
        if url is None:
            continue
        first = (f"s:{site(url)}" if site(url) else f"u:{url}") if "base_domain" in by else f"u:{url}"
        own = [first]
        if "ip_address" in by and ip is not None:
            own.append(f"i:{ip}")
        if "asn_brand" in by and asn is not None and brand is not None:
            own.append(f"b:{asn}:{brand}")
        names[url] = first
        pairs += [(first, n) for n in own]
    roots = roots_of(pairs)
    return {url: roots[n] for url, n in names.items()}


def threats_of(seed):
    draw = random.Random(seed)
    rows = []
    for i in range(120):
        url = draw.choice([f"https://a{draw.randrange(40)}.com/{i % 7}", f"http://x{draw.randrange(9)}.vercel.app/", f"http://10.0.0.{i % 9}/p"])
        ip = draw.choice([None, f"1.2.3.{draw.randrange(60)}"])
        rows.append((url, ip, draw.choice([None, 1, 2, 3]), draw.choice([None, None, f"B{draw.randrange(9)}"]), f"d{i:03}", f"e{i:03}", i))
    return rows + [(None, "1.2.3.4", 1, "B1", "d", "e", 1), (rows[0][0], None, None, None, None, None, None), rows[3], rows[3]]


@pytest.mark.parametrize("by", [("base_domain", "ip_address", "asn_brand"), ("ip_address",), ("base_domain",), ("asn_brand", "base_domain")])
def test_members_equal_union_find(spark, by):
    rows = threats_of(len(by))
    got = campaign_members(spark.createDataFrame(rows, COLUMNS), by)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, by).items())


def test_summary_of_campaigns(spark):
    rows = threats_of(4)
    by = ("base_domain", "ip_address")
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("campaign", F.lit("x"))
    want, urls = Counter(), {}
    for row in rows:
        if row[0] is not None:
            name = brute(rows, by)[row[0]]
            want[name] += 1
            urls.setdefault(name, set()).add(row[0])
    got = campaign_components(frame, by).collect()
    assert {r.campaign: (r.sightings, r.urls) for r in got} == {c: (n, len(urls[c])) for c, n in want.items()}
    assert max(r.max_score for r in got) == 119 and min(r.first_seen for r in got) == "d000"
    assert campaign_components(frame.limit(0), by).count() == 0
    with pytest.raises(ValueError):
        campaign_members(frame, ("tld",))


def test_a_hub_of_a_third_of_all_rows_is_cut_up(spark):
    """One address of 4,000 sites: no task of a round sees most of its edges, without adaptive execution."""
    from hooktrace.operators import skew

    edges = spark.range(12_000).selectExpr("case when id % 3 = 0 then 'zhub' else concat('t', id) end a", "concat('s', id) b")
    dim = edges.groupBy("a").agg(F.min("b").alias("least")).where("a is not null")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.balanced_left_join(edges, dim, "a", F.col("b"), rows_per_slice=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 5_500
        got = connected_components(edges, rows_per_slice=500)
        assert got.where("node = 'zhub' or root = 's0'").count() == 4_001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_threats_are_computed_once(spark, tmp_path):
    """What is summed up comes from the staged rows and not from the threats again."""
    rows = threats_of(5)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/threats")
    threats = spark.read.parquet(f"{tmp_path}/threats")
    for made in (campaign_components(threats), campaign_members(threats)):
        assert made.inputFiles() and not [f for f in made.inputFiles() if str(tmp_path) in f]
    assert sum(r.sightings for r in campaign_components(threats).collect()) == sum(r[0] is not None for r in rows)
