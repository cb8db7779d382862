import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from hooktrace.sources import feeds, tables
from hooktrace.schemas import ENRICHED

RECORDS = [
    {"phish_id": "7", "url": "http://a.com/", "verified": "yes", "online": True, "target": "Bank",
     "details": [{"ip_address": "1.2.3.4", "announcing_network": "13335", "rir": "arin"}, {"ip_address": "9.9.9.9"}]},
    {"phish_id": 8, "url": "http://b.com/", "verified": False, "online": "no", "details": []},
    {"phish_id": "", "url": "http://c.com/é", "verified": "maybe", "online": None},
]


def test_line_feed(spark, tmp_path):
    path = tmp_path / "feed.txt"
    path.write_text("# head\n\nhttp://A.com/x\n   \n  # kept\n  http://b.com:80/  \nno-scheme.com/x\n")
    got = {(r.url, r.domain) for r in feeds.read_line_feed(spark, str(path)).collect()}
    assert got == {("http://A.com/x", "a.com"), ("# kept", None), ("http://b.com:80/", "b.com"), ("no-scheme.com/x", None)}


@pytest.mark.parametrize("suffix,pack", [("json", lambda b: b), ("json.gz", gzip.compress), ("json.bz2", bz2.compress)])
def test_phish_json(spark, tmp_path, suffix, pack):
    path = tmp_path / f"feed.{suffix}"
    path.write_bytes(pack(json.dumps(RECORDS, indent=1).encode()))
    mapped = feeds.map_phish_records(feeds.read_phish_json(spark, str(path)))
    got = {r.url: r for r in mapped.collect()}
    a, b, c = (got[r["url"]] for r in RECORDS)
    assert (a.phish_id, a.verified, a.online, a.ip_address, a.announcing_network, a.rir) == (7, "yes", "yes", "1.2.3.4", "13335", "arin")
    assert (b.phish_id, b.verified, b.online, b.ip_address) == (8, "no", "no", None)
    assert (c.phish_id, c.verified, c.online, c.target) == (None, None, None, None)


def test_phish_csv(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(
        "phish_id,url,phish_detail_url,submission_time,verified,verification_time,online,target\n"
        '1,"http://a.com/?x=1,2",d,t,yes,t,yes,"Big ""Bank"", Inc"\n2,http://b.com,d,t,no,t,no,\n'
    )
    rows = feeds.read_phish_csv(spark, str(path))
    mapped = {r.phish_id: r for r in feeds.map_phish_records(rows).collect()}
    assert mapped[1].url == "http://a.com/?x=1,2" and mapped[1].target == 'Big "Bank", Inc'
    assert mapped[2].target == "" and mapped[2].online == "no" and mapped[2].ip_address is None


def test_phish_csv_without_target(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text("phish_id,url\n1,http://a.com\n")
    row = feeds.map_phish_records(feeds.read_phish_csv(spark, str(path))).first()
    assert (row.phish_id, row.target, row.online) == (1, "", None)


def test_malware_envelope(spark, tmp_path):
    ok = {"query_status": "ok", "urls": [
        {"url": "u1", "date_added": "", "url_dateadded": "d1", "lastseen": "l1", "reporter": "rep", "tags": ["a", "b"],
         "filename": None, "file_name": "f", "file_size": "12", "asn": "x", "response_code": 200,
         "reference": "ref", "comments": {"k": ["é", 1]}},
        {"url": "u2", "date_added": "d2", "url_dateadded": "z", "reporter": "rep", "reporter_handle": "h",
         "tags": [], "comments": "text", "asn": 5},
        {"url": "u3", "tags": None}, {"url": "u4", "tags": "one,two"},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(ok, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"query_status": "no_results", "urls": [{"url": "x"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"query_status": "ok", "urls": None}))
    got = {r.url: r for r in feeds.map_malware_records(feeds.read_malware_json(spark, str(tmp_path))).collect()}
    assert set(got) == {"u1", "u2", "u3", "u4"}
    one, two, three, four = (got[f"u{i}"] for i in range(1, 5))
    assert (one.url_dateadded, one.url_lastseen, one.reporter_handle, one.tags) == ("d1", "l1", "rep", "a,b")
    assert (one.file_name, one.file_size, one.asn, one.response_code, one.referrer) == ("f", 12, None, 200, "ref")
    assert json.loads(one.comments) == {"k": ["é", 1]}
    assert (two.url_dateadded, two.reporter_handle, two.tags, two.comments, two.asn) == ("d2", "h", "", "text", 5)
    assert three.tags is None and four.tags == "one,two" and one.verifier is None


def test_work_list_order_and_columns(spark):
    line = spark.createDataFrame([("u", "d")], "url string, domain string")
    phish = spark.createDataFrame([(5, "u", "yes", "T", "1.1.1.1", "1.0.0.0/8", "AS12", "r")], "phish_id long, url string, online string, target string, ip_address string, cidr_block string, announcing_network string, rir string")
    malware = spark.createDataFrame([("u", "t", "a,b", 7, "DE")], "url string, threat string, tags string, asn long, country string")
    rows = {r.source_feed: r for r in tables.work_list(line, phish, malware).collect()}
    assert [rows[f].feed_rank for f in ("openphish", "phishtank", "urlhaus")] == [0, 1, 2]
    assert (rows["phishtank"].source_id, rows["phishtank"].asn, rows["phishtank"].rir) == ("5", 12, "r")
    assert (rows["urlhaus"].tags, rows["urlhaus"].asn, rows["urlhaus"].source_id) == ("a,b", 7, None)
    assert rows["openphish"].feed_domain == "d"
    with pytest.raises(ValueError):
        tables.work_list()


def test_missing_table_is_empty_and_old_rows_get_score_zero(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_enriched(spark, path).schema == ENRICHED
    spark.createDataFrame([("u",)], "url string").write.parquet(f"{path}/a")
    assert tables.read_enriched(spark, f"{path}/a").select("url", "risk_score", "domain").first() == ("u", 0, None)
    spark.createDataFrame([("v", 9)], "url string, risk_score int").write.parquet(f"{path}/b")
    both = spark.read.option("mergeSchema", True).parquet(f"{path}/a", f"{path}/b")
    got = {r.url: r.risk_score for r in tables.with_default_score(both).collect()}
    assert got == {"u": 0, "v": 9}


def test_tags_text(spark):
    tags = spark.createDataFrame([('["x","y"]',), ("[]",), ("plain",), (None,)], "t string")
    assert [r[0] for r in tags.select(feeds.tags_text(F.col("t"))).collect()] == ["x,y", "", "plain", None]


def test_create_table_leaves_a_table_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_table(spark, path, ENRICHED)
    assert spark.read.parquet(path).schema == ENRICHED
    spark.createDataFrame([("u",)], "url string").write.mode("overwrite").parquet(path)
    tables.create_table(spark, path, ENRICHED)
    assert tables.read_enriched(spark, path).count() == 1


@pytest.mark.parametrize("read", [feeds.read_phish_json, feeds.read_malware_json])
@pytest.mark.parametrize("lines", [False, True])
def test_a_bad_file_is_an_error(spark, tmp_path, read, lines):
    path = tmp_path / "feed.json"
    text = json.dumps(RECORDS if read is feeds.read_phish_json else {"query_status": "ok", "urls": RECORDS})
    path.write_text(text[: len(text) // 2])
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, str(path), lines=lines).collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "feed.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RECORDS))
    rows = feeds.map_phish_records(feeds.read_phish_json(spark, str(path), lines=True)).collect()
    assert sorted(r.url for r in rows) == sorted(r["url"] for r in RECORDS)


def test_an_envelope_is_read_once(spark, tmp_path):
    """Lists and numbers that become text are cut from what was read, and are the same from a compressed file."""
    entries = [{"url": f"http://a.b/{i}", "tags": ["x",  i], "asn": i, "file_size": 1e5} for i in range(2000)]
    text = json.dumps({"query_status": "ok", "urls": entries}, indent=1)
    plain, packed = tmp_path / "plain.json", tmp_path / "packed.json.gz"
    plain.write_text(text)
    packed.write_bytes(gzip.compress(text.encode()))
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
    read = lambda: sum(s.getBytesRead() for s in statistics())
    before = read()
    rows = feeds.read_malware_json(spark, str(plain)).select("url", "tags", "asn", "file_size").collect()
    assert len(rows) == 2000 and read() - before < 2 * len(text)
    assert rows == feeds.read_malware_json(spark, str(packed)).select("url", "tags", "asn", "file_size").collect()
    assert json.loads(rows[7].tags) == ["x", 7] and rows[7].asn == "7" and rows[7].file_size == "100000.0"
