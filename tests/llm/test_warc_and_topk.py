import hashlib

import pytest
from pyspark.sql import functions as F

from hooktrace.llm import topk, warc
from hooktrace.llm.catalog import QUERIES
from hooktrace.sinks.shared import shared_folder


def test_chunked_round_trip():
    for payload in (b"", b"a", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 100):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    for broken in (b"", b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcde"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


PAGES = [
    (1, "http://a/1", "x" * 1500),
    (2, "http://a/2", "x" * 1500),
    (3, "http://a/3", "é" * 40_000),
    (4, "http://a/\r\nX-Evil: 1", "small"),
    (5, None, "small"),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (8, "http://a/8", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 900),
    (9, "u", "y" * 2000), (9, "u", "y" * 2000), (10, "v", "y" * 2000), (10, "v", "y" * 2000),
    (None, "n", "x" * 1500),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("name", F.lit("clash"))
    path = shared_folder(spark, "warc-test")
    warc.archive_pages(pages.repartition(3), path, compression=compression, segment_bytes=700)
    records = warc.reassemble(warc.read_archives(spark, path))
    rows = warc.restore_payloads(records).withColumn("page", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to"))).collect()
    assert len(rows) == len(PAGES) and len({r.record_id for r in rows}) == len(PAGES)
    assert all(r.problem is None and r.verified for r in rows)
    got = sorted((r.page or 0, r.bytes, r.sha1, r.warc_type, r.to) for r in rows)
    best = {"x" * 1500: 2, "y" * 2000: 10}
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        to = best.get(html) if best.get(html) not in (None, page) else None
        want.append((page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=lambda t: (t[0], t[1]))
    payloads = {r.record_id: r.payload for r in records.where("warc_type = 'response'").collect()}
    assert "é" * 40_000 in {bytes(p).decode() for p in payloads.values()}


def test_no_pages(spark):
    path = shared_folder(spark, "warc-test")
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.reassemble(warc.read_archives(spark, path)).collect() == []


def test_broken_segments_are_named(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    rows = [
        ("<a>", "response", None, 1, None, None, body[:10]), ("<a2>", "continuation", None, 2, "<a>", len(body), body[10:]),
        ("<b>", "response", None, 1, None, None, body[:10]), ("<b3>", "continuation", None, 3, "<b>", len(body), body[10:]),
        ("<c>", "response", None, 1, None, None, body[:10]), ("<c2>", "continuation", None, 2, "<c>", 99, body[10:]),
        ("<d2>", "continuation", None, 2, "<d>", len(body), body[10:]),
        ("<e2>", "continuation", None, 2, None, len(body), body),
        ("<f>", "response", None, None, None, None, b"no header"),
        ("<g>", "response", None, None, None, None, body), ("<h>", "warcinfo", None, None, None, None, b"x"),
    ]
    frame = spark.createDataFrame(rows, "record_id string, warc_type string, refers_to string, segment int, origin string, total_length long, block binary")
    frame = frame.withColumn("target_uri", F.lit("u")).withColumn("payload_digest", F.lit(None).cast("string"))
    got = {r.record_id: (r.problem, r.payload and bytes(r.payload)) for r in warc.reassemble(frame.repartition(4)).collect()}
    assert got == {
        "<a>": (None, b"abcdef"), "<b>": ("gap", None), "<c>": ("length", None), "<d>": ("orphan", None),
        "<e2>": ("orphan", None), "<f>": ("framing", None), "<g>": (None, b"abcdef"), "<h>": (None, None),
    }


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    import random

    draw = random.Random(3)
    rows = [(i, [draw.randint(-3, 3) for _ in range(20)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, [0] * 20), (401, [1, 2]), (402, [3, 4]), (403, [9])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<bigint>").withColumn("score", F.lit(1))
    frame = frame.unionByName(spark.createDataFrame([(None, [1] * 20, 1), (999, None, 1)], frame.schema))
    asked = [r for r in rows if r[0] % 25 == 0 or r[0] > 400]
    got = topk.top_k(frame, spark.createDataFrame(asked, "vec_id long, vector array<bigint>"), 5, group_rows=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 5)
    assert topk.top_k(frame.limit(0), frame, 5).collect() == []


def test_scaled(spark):
    rows = [([0.5, -0.001],), ([1.0, float("nan")],), ([1.0, None],), (None,), ([float("inf")],), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(topk.scaled(F.col("v"))).collect()
    assert [r[0] for r in got] == [[128, -1], None, None, None, None, []]


def test_queries_equal_sql(spark):
    import check

    con = check.duck("/root/testdata/sf0.001")
    for name in ("op1_warc", "op2_exact_top_k", "op3_poisson_mix", "op7_pii", "op10_jaccard"):
        good, note = check.compare(con, name, QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert good, (name, note)
