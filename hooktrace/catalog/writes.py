"""Unions, upserts, exports and the stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hooktrace import fixtures as fx
from hooktrace.catalog.joins import _STORED_SQL, _stored
from hooktrace.catalog.registry import query
from hooktrace.operators import numbering, paging, upsert
from hooktrace.plans.enrichment import with_score
from hooktrace.schemas import ENRICHED, RAW_LINE_FEED
from hooktrace.sinks import export, store, textindex
from hooktrace.sinks.shared import shared_folder, staged
from hooktrace.sources import feeds
from hooktrace.sources.tables import conform, read_enriched, read_table
from hooktrace.sources.tables import create_table as new_table


def _early():
    return F.col("first_seen") < F.lit(fx.LOAD_DAY).cast("timestamp_ntz")


@query(
    "raw_union",
    """
SELECT url, source_feed, source_id, feed_rank, online, target, ip_address, asn, threat, tags, country
FROM raw_work""",
)
def raw_union(spark, sf_dir):
    return fx.raw_work(fx.hosted_obs(spark, sf_dir)).select(
        "url", "source_feed", "source_id", "feed_rank", "online", "target", "ip_address", "asn",
        "threat", "tags", "country",
    )


@query(
    "dedup_feeds",
    """
SELECT url, source_feed, source_id, asn, threat, tags FROM raw_work
QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed_rank DESC, CAST(source_id AS BIGINT) DESC NULLS LAST) = 1""",
)
def dedup_feeds(spark, sf_dir):
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    return upsert.dedup_feeds(work).select("url", "source_feed", "source_id", "asn", "threat", "tags")


@query(
    "dedup_feeds_first",
    """
SELECT url, source_feed, source_id, asn, threat, tags FROM raw_work
QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed_rank, CAST(source_id AS BIGINT) DESC NULLS LAST) = 1""",
)
def dedup_feeds_first(spark, sf_dir):
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    kept = upsert.dedup_feeds(work, first_wins=True)
    return kept.select("url", "source_feed", "source_id", "asn", "threat", "tags")


_FIRST_EARLY_SQL = """
stored AS (SELECT id, url, online, first_seen FROM obs WHERE first_seen < TIMESTAMP '2024-01-15 00:00:00'
 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
late AS (SELECT id, url, online, first_seen FROM obs WHERE first_seen >= TIMESTAMP '2024-01-15 00:00:00')"""


def _stored_and_late(spark, sf_dir):
    rows = fx.obs(spark, sf_dir).select("id", "url", "online", "first_seen")
    stored = upsert.one_per_key(rows.where(_early()), "url", [F.asc("id")])
    return stored, rows.where(~_early())


@query(
    "upsert_ignore",
    f"""
WITH {_FIRST_EARLY_SQL}
SELECT id, url, online FROM stored UNION ALL
SELECT id, url, online FROM late WHERE url NOT IN (SELECT url FROM stored)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1""",
)
def upsert_ignore(spark, sf_dir):
    stored, late = _stored_and_late(spark, sf_dir)
    return upsert.upsert_ignore(stored, late, "url", [F.asc("id")]).select("id", "url", "online")


_REPLACE_SQL = f"""
WITH {_FIRST_EARLY_SQL},
winners AS (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1)
SELECT id, url, online, strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM stored
 WHERE url NOT IN (SELECT url FROM winners)
UNION ALL SELECT w.id, w.url, w.online,
 strftime({{first_seen}}, '%Y-%m-%d %H:%M:%S.%f') AS first_seen
FROM winners w LEFT JOIN stored s USING (url)"""


@query("upsert_replace", _REPLACE_SQL.format(first_seen="coalesce(s.first_seen, w.first_seen)"))
def upsert_replace(spark, sf_dir):
    stored, late = _stored_and_late(spark, sf_dir)
    merged = upsert.upsert_replace(stored, late, "url", [F.desc("id")], keep=["first_seen"])
    return fx.time_text(merged, "first_seen").select("id", "url", "online", "first_seen")


@query("upsert_replace_reset", _REPLACE_SQL.format(first_seen="w.first_seen"))
def upsert_replace_reset(spark, sf_dir):
    stored, late = _stored_and_late(spark, sf_dir)
    merged = upsert.upsert_replace(stored, late, "url", [F.desc("id")])
    return fx.time_text(merged, "first_seen").select("id", "url", "online", "first_seen")


@query(
    "upsert_update",
    """
WITH stored AS (SELECT user_id, event_type, props, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
late AS (SELECT user_id, event_type, props, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id AS phish_id, coalesce(l.event_type, s.event_type) AS target,
 CASE WHEN l.user_id IS NULL THEN s.props ELSE l.props END AS announcing_network,
 strftime(coalesce(s.ts, l.ts), '%Y-%m-%d %H:%M:%S.%f') AS inserted_at
FROM stored s FULL JOIN late l USING (user_id)""",
)
def upsert_update(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("phish_id"),
        F.col("event_type").alias("target"),
        F.col("props").alias("announcing_network"),
        F.col("ts").alias("inserted_at"),
        "event_id",
    )
    early = F.col("inserted_at") < F.lit(fx.LOAD_DAY).cast("timestamp_ntz")
    stored = upsert.one_per_key(rows.where(early), "phish_id", [F.asc("event_id")])
    merged = upsert.upsert_update(
        stored, rows.where(~early), "phish_id", [F.desc("event_id")], "inserted_at"
    )
    return fx.time_text(merged, "inserted_at").drop("event_id")


@query(
    "work_limit",
    f"""
SELECT * FROM (SELECT 'skip first' AS mode, url, source_feed, source_id FROM raw_work
 WHERE url NOT IN {_STORED_SQL} ORDER BY feed_rank, url NULLS FIRST, source_id NULLS FIRST LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'limit first' AS mode, url, source_feed, source_id FROM
 (SELECT * FROM raw_work ORDER BY feed_rank, url NULLS FIRST, source_id NULLS FIRST LIMIT 100)
 WHERE url NOT IN {_STORED_SQL})""",
)
def work_limit(spark, sf_dir):
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    stored = _stored(spark, sf_dir)
    parts = [
        paging.limit_work(work, 100, stored, skip_first).select(
            F.lit(mode).alias("mode"), "url", "source_feed", "source_id"
        )
        for mode, skip_first in (("skip first", True), ("limit first", False))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "load_stats",
    f"""
WITH work AS (SELECT source_feed, url, false AS bare FROM raw_work
 UNION ALL SELECT source_feed, '?' || url, true FROM raw_work WHERE source_feed = 'openphish')
SELECT source_feed, count(*) FILTER (NOT known) AS processed, count(*) FILTER (known) AS skipped,
 count(*) FILTER (bare) AS without_host, count(DISTINCT url) FILTER (NOT known) AS rows_added
FROM (SELECT *, url IN {_STORED_SQL} AS known FROM work) GROUP BY source_feed""",
)
def load_stats(spark, sf_dir):
    """A load in which one feed also lists texts without a host."""
    work = fx.raw_work(fx.hosted_obs(spark, sf_dir))
    bare = work.where("source_feed = 'openphish'").withColumn("url", F.concat(F.lit("?"), "url"))
    return upsert.load_stats(work.unionByName(bare), _stored(spark, sf_dir))


@query(
    "upsert_counts",
    """
WITH keyed AS (SELECT CASE WHEN user_id % 50 <> 3 THEN user_id END AS user_id, ts FROM events),
stored AS (SELECT DISTINCT user_id FROM keyed WHERE ts < TIMESTAMP '2024-01-03 00:00:00' AND user_id IS NOT NULL),
late AS (SELECT user_id FROM keyed WHERE ts >= TIMESTAMP '2024-01-03 00:00:00')
SELECT (SELECT count(DISTINCT user_id) FROM late WHERE user_id NOT IN (SELECT user_id FROM stored)) AS inserted,
 (SELECT count(DISTINCT user_id) FROM late WHERE user_id IN (SELECT user_id FROM stored)) AS updated,
 (SELECT count(*) FROM late WHERE user_id IS NULL) AS dropped_without_key""",
)
def upsert_counts(spark, sf_dir):
    """Rows of some users come without their key."""
    user = F.when(F.col("user_id") % 50 != 3, F.col("user_id")).alias("user_id")
    rows = fx.table(spark, sf_dir, "events").select(user, "ts")
    early = F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return upsert.upsert_counts(rows.where(early), rows.where(~early), "user_id")


_CSV_COLUMNS = (
    "id", "url", "domain", "online", "http_status_code", "source_feed", "asn", "country",
    "target_brand", "latitude", "first_seen",
)


@query(
    "export_csv",
    """
SELECT id, url, domain, online, http_status_code, source_feed, asn, country, target_brand, latitude,
 strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM enr""",
)
def export_csv(spark, sf_dir):
    rows = fx.time_text(fx.enr(spark, sf_dir), "first_seen").select(*_CSV_COLUMNS)
    path = shared_folder(spark, "csv-export")
    export.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query("export_capped", "SELECT id, url FROM enr ORDER BY id LIMIT 300")
def export_capped(spark, sf_dir):
    """A cap only where the caller asks for one: the first rows by id."""
    rows = fx.enr(spark, sf_dir).select("id", "url")
    path = shared_folder(spark, "csv-export")
    export.write_csv(rows, path, limit=300)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


_INDICATORS_SQL = r"""
SELECT id, '{"type":"indicator","spec_version":"2.1","id":"indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4)
 || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12)
 || '","created":"' || seen || '","modified":"' || seen || '","name":"Phishing URL: ' || domain
 || '","description":"Malicious URL detected by ' || source_feed
 || '","indicator_types":["malicious-activity"],"pattern":"[url:value = ''' || url
 || ''']","pattern_type":"stix","valid_from":"' || seen || '","labels":["' || threat_type || '"'
 || coalesce(',"targets-' || target_brand || '"', '') || CASE WHEN online = 'yes' THEN ',"active"' ELSE '' END || ']'
 || coalesce(',"x_ip_address":"' || ip_address || '"', '') || coalesce(',"x_country":"' || country || '"', '')
 || coalesce(',"x_asn":' || CAST(asn AS VARCHAR), '') || coalesce(',"x_asn_name":"' || asn_name || '"', '')
 || coalesce(',"x_ssl_enabled":"' || ssl_enabled || '"', '') || '}' AS indicator
FROM (SELECT *, sha256(url) AS h, strftime(first_seen, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(first_seen, '%f'), 1, 3)
  || 'Z' AS seen FROM enr)"""


@query("export_stix", _INDICATORS_SQL)
def export_stix(spark, sf_dir):
    return export.stix_indicators(fx.enr(spark, sf_dir), fx.AS_OF)


def _uuid_sql(digest: str) -> str:
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-8' || substr({digest}, 14, 3) || '-a'"
        f" || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


@query(
    "export_stix_bundles",
    f"""
WITH placed AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 300 AS bundle_no FROM ({_INDICATORS_SQL})),
cut AS (SELECT bundle_no, count(*) AS indicators, string_agg(indicator, ',' ORDER BY id) AS objects FROM placed GROUP BY bundle_no),
named AS (SELECT *, sha256('Threat feed analytics') AS i,
 sha256('Threat feed analytics2024-02-05T00:00:00.000Z/' || CAST(bundle_no AS VARCHAR)) AS b FROM cut)
SELECT bundle_no, indicators, sha256('{{"type":"bundle","id":"bundle--' || {_uuid_sql("b")}
 || '","objects":[{{"type":"identity","spec_version":"2.1","id":"identity--' || {_uuid_sql("i")}
 || '","created":"2024-02-05T00:00:00.000Z","modified":"2024-02-05T00:00:00.000Z","name":"Threat feed analytics"'
 || ',"identity_class":"system"}},' || objects || ']}}') AS bundle_sha256 FROM named""",
)
def export_stix_bundles(spark, sf_dir):
    """All indicators in bundles of 300, by a hash of the whole document."""
    made = export.stix_bundles(fx.enr(spark, sf_dir), fx.AS_OF, size=300)
    return made.select("bundle_no", "indicators", F.sha2("bundle", 256).alias("bundle_sha256"))


@query(
    "work_limit_half",
    """
SELECT url, source_feed, source_id FROM raw_work
ORDER BY feed_rank, url NULLS FIRST, source_id NULLS FIRST LIMIT (SELECT count(*) // 2 FROM raw_work)""",
)
def work_limit_half(spark, sf_dir):
    """Half of the work list, by two passes over ranges of its order."""
    work = staged(fx.raw_work(fx.hosted_obs(spark, sf_dir)), "work")
    half = work.count() // 2
    order = [numbering.By(c) for c in ("feed_rank", "url", "source_id")]
    return numbering.first_in_order(work, order, half).select("url", "source_feed", "source_id")


_LOADS_SQL = """
WITH loads AS (SELECT id, url, online, first_seen, last_seen, CASE WHEN first_seen < TIMESTAMP '2024-01-10 00:00:00' THEN 0
 WHEN first_seen < TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 2 END AS batch FROM obs),
last AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch DESC, last_seen DESC, id DESC) = 1),
now AS (SELECT l.id, l.url, l.online, strftime(k.earliest, '%Y-%m-%d %H:%M:%S.%f') AS first_seen
 FROM last l JOIN (SELECT url, min(first_seen) AS earliest FROM loads GROUP BY url) k USING (url))
SELECT * FROM now"""


def _scored_loads(spark, sf_dir):
    """Scored observations, and the load that each is part of."""
    rows = staged(
        conform(with_score(fx.hosted_obs(spark, sf_dir).withColumn("source_id", F.col("id")), fx.AS_OF), ENRICHED),
        "loads",
    )
    day = lambda text: F.lit(f"{text} 00:00:00").cast("timestamp_ntz")
    number = F.when(F.col("first_seen") < day("2024-01-10"), 0).when(F.col("first_seen") < day("2024-01-20"), 1).otherwise(2)
    return rows, number


def _three_loads(spark, sf_dir) -> str:
    """A stored table: loads 0 and 2 and a compaction, then load 1 comes late."""
    rows, number = _scored_loads(spark, sf_dir)
    root = shared_folder(spark, "threats")
    for n in (0, 2):
        store.append_batch(rows.where(number == n), root, n)
    store.compact(spark, root)
    store.append_batch(rows.where(number == 1), root, 1)
    return root


@query("store_current", _LOADS_SQL)
def store_current(spark, sf_dir):
    root = _three_loads(spark, sf_dir)
    return fx.time_text(store.current(spark, root), "first_seen").select("id", "url", "online", "first_seen")


@query(
    "store_merge",
    """
WITH loads AS (SELECT id, url, online, first_seen, last_seen, CASE WHEN first_seen < TIMESTAMP '2024-01-10 00:00:00' THEN 0
 WHEN first_seen < TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 2 END AS batch FROM obs),
last AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, last_seen DESC, id DESC) = 1)
SELECT l.id, l.url, l.online, strftime(k.earliest, '%Y-%m-%d %H:%M:%S.%f') AS first_seen
FROM last l JOIN (SELECT url, min(first_seen) AS earliest FROM loads GROUP BY url) k USING (url)""",
)
def store_merge(spark, sf_dir):
    """Three streams, each with loads from 0 on: the last write wins, through merges of touched buckets only."""
    rows, number = _scored_loads(spark, sf_dir)
    root = shared_folder(spark, "threats")
    # The newest rows are written first, so the oldest are what is written last.
    for n in (2, 1, 0):
        store.append_batch(rows.where(number == n), root, n * 40, writer=f"stream-{n}")
        if n:
            store.compact(spark, root)
    return fx.time_text(store.current(spark, root), "first_seen").select("id", "url", "online", "first_seen")


@query("store_lookup", f"{_LOADS_SQL} WHERE url = (SELECT min(url) FROM obs)")
def store_lookup(spark, sf_dir):
    """One row by its URL."""
    root = _three_loads(spark, sf_dir)
    url = fx.obs(spark, sf_dir).agg(F.min("url")).first()[0]
    found = store.lookup(spark, root, url=url)
    return fx.time_text(found, "first_seen").select("id", "url", "online", "first_seen")


@query(
    "search_indexed",
    """
WITH loads AS (SELECT *, CASE WHEN first_seen < TIMESTAMP '2024-01-10 00:00:00' THEN 0
 WHEN first_seen < TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 2 END AS batch FROM hosted),
now AS (SELECT id, url, domain, ip_address FROM loads
 QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch DESC, last_seen DESC, id DESC) = 1)
SELECT * FROM (SELECT 'url' AS kind, id, url FROM now WHERE url ILIKE '%BANK%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'url with gaps', id, url FROM now WHERE url ILIKE '%log_n%/9%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'domain', id, url FROM now WHERE domain ILIKE '%pages%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'ip', id, url FROM now WHERE ip_address ILIKE '%.3.7%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'two letters', id, url FROM now WHERE url ILIKE '%xy%' ORDER BY id LIMIT 10)
UNION ALL SELECT 'any', id, url FROM now WHERE url ILIKE '%secure%' OR domain ILIKE '%secure%' OR ip_address ILIKE '%secure%'""",
)
def search_indexed(spark, sf_dir):
    """Substrings of a stored table of three loads, two of which are indexed."""
    rows, number = _scored_loads(spark, sf_dir)
    root = shared_folder(spark, "threats")
    for n in (0, 1):
        store.append_batch(rows.where(number == n), root, n)
    textindex.index_loads(spark, root)
    store.compact(spark, root)
    store.append_batch(rows.where(number == 2), root, 2)
    found = textindex.matching(spark, root, "secure").select(F.lit("any").alias("kind"), "id", "url")
    for kind, field, term in (
        ("url", "url", "BANK"), ("url with gaps", "url", "log_n%/9"), ("domain", "domain", "pages"),
        ("ip", "ip", ".3.7"), ("two letters", "url", "xy"),
    ):
        hits = textindex.search(spark, root, field, term)
        found = found.unionByName(hits.select(F.lit(kind).alias("kind"), "id", "url"))
    return found


@query(
    "schema_evolve",
    """
SELECT id, url, CASE WHEN first_seen < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE risk_score END AS risk_score,
 CASE WHEN first_seen >= TIMESTAMP '2024-01-15 00:00:00' THEN domain END AS domain FROM scored""",
)
def schema_evolve(spark, sf_dir):
    """Files from before a column was added, beside files that have it."""
    rows = conform(with_score(fx.hosted_obs(spark, sf_dir), fx.AS_OF), ENRICHED)
    path = shared_folder(spark, "evolved")
    rows.where(_early()).drop("risk_score", "domain", "notes").write.parquet(path)
    rows.where(~_early()).write.mode("append").parquet(path)
    return read_enriched(spark, path).select("id", "url", "risk_score", "domain")


@query("create_table", "SELECT id, url, domain FROM raw_work WHERE source_feed = 'openphish'")
def create_table(spark, sf_dir):
    """A table made once, made again without harm, and filled."""
    path = shared_folder(spark, "raw-line-feed")
    new_table(spark, path, RAW_LINE_FEED)
    rows = conform(fx.raw_line_feed(fx.hosted_obs(spark, sf_dir)), RAW_LINE_FEED)
    rows.write.mode("append").parquet(path)
    new_table(spark, path, RAW_LINE_FEED)
    return read_table(spark, path, RAW_LINE_FEED).select("id", "url", "domain")


def _phish_records(spark, sf_dir):
    rows = fx.obs(spark, sf_dir).where("source_feed = 'phishtank'")
    detail = F.struct("ip_address", F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("announcing_network"))
    return rows.select(
        F.col("id").cast("string").alias("phish_id"),
        "url",
        F.when(F.col("id") % 3 != 0, "yes").otherwise("no").alias("verified"),
        F.col("online"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit('Brand, "'), (F.col("id") % 17).cast("string"))).alias("target"),
        F.array(detail).alias("details"),
    )


_PHISH_SQL = """
SELECT id AS phish_id, url, CASE WHEN id % 3 <> 0 THEN 'yes' ELSE 'no' END AS verified, {online} AS online,
 {target} AS target, {ip} AS ip_address FROM obs WHERE source_feed = 'phishtank'"""
_BRAND_SQL = "CASE WHEN id % 4 <> 0 THEN 'Brand, \"' || CAST(id % 17 AS VARCHAR) END"
_PHISH_SHOWN = ("phish_id", "url", "verified", "online", "target", "ip_address")


def _file_number(number, cycle: int):
    """File of a record: ``cycle`` files for every ``cycle`` times 10,000 numbers, so files stay short as tables grow."""
    return (F.floor(number / (cycle * 10_000)) * cycle + number % cycle).cast("bigint").alias("file")


@query("scan_json_feed", _PHISH_SQL.format(target=_BRAND_SQL, ip="ip_address", online="online"))
def scan_json_feed(spark, sf_dir):
    """JSON array files, plain, gzip and bzip2, and a file with one record per line."""
    rows = _phish_records(spark, sf_dir)
    path = shared_folder(spark, "json-feed")
    number = F.col("phish_id").cast("bigint")
    for i, codec in enumerate(("none", "gzip", "bzip2")):
        part = rows.where(number % 4 == i)
        files = part.groupBy(_file_number(number, 20)).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
        files.select("value", "file").write.option("compression", codec).option("maxRecordsPerFile", 1).partitionBy("file").text(f"{path}/array/{codec}")
    rows.where(number % 4 == 3).write.json(f"{path}/lines")
    arrays = feeds.read_phish_json(spark, [f"{path}/array/{c}/file=*" for c in ("none", "gzip", "bzip2")])
    lines = feeds.read_phish_json(spark, f"{path}/lines", lines=True)
    return feeds.map_phish_records(arrays.unionByName(lines)).select(*_PHISH_SHOWN)


@query("scan_csv_feed", _PHISH_SQL.format(target=f"coalesce({_BRAND_SQL}, '')", ip="CAST(NULL AS VARCHAR)", online="online"))
def scan_csv_feed(spark, sf_dir):
    path = shared_folder(spark, "csv-feed")
    _phish_records(spark, sf_dir).drop("details").write.option("header", True).option("escape", '"').csv(path)
    return feeds.map_phish_records(feeds.read_phish_csv(spark, path)).select(*_PHISH_SHOWN)


def _envelopes(spark, sf_dir) -> str:
    """Envelope files; every fifth says that its query failed and is not read."""
    rows = fx.obs(spark, sf_dir).where("source_feed = 'urlhaus'")
    comments = F.when(F.col("id") % 2 == 0, F.concat(F.lit("seen "), F.col("id").cast("string")))
    entry = F.struct(
        "url", F.col("id").cast("string").alias("file_size"), F.array(F.lit("elf"), "online").alias("tags"),
        F.col("asn").cast("string").alias("asn"), F.lit("x").alias("reporter"), comments.alias("comments"),
    )
    status = F.when(F.col("file") % 5 == 4, "no_results").otherwise("ok").alias("query_status")
    files = rows.groupBy(_file_number(F.col("id"), 10)).agg(F.collect_list(entry).alias("urls"))
    path = shared_folder(spark, "envelopes")
    text = files.select(F.to_json(F.struct(status, "urls")).alias("value"), "file")
    text.write.option("maxRecordsPerFile", 1).partitionBy("file").text(path)
    return path


@query(
    "scan_envelope",
    """
SELECT url, id AS file_size, 'elf' || coalesce(',' || online, '') AS tags, asn, 'x' AS reporter_handle FROM obs
WHERE source_feed = 'urlhaus' AND id % 10 NOT IN (4, 9)""",
)
def scan_envelope(spark, sf_dir):
    entries = feeds.read_malware_json(spark, f"{_envelopes(spark, sf_dir)}/file=*")
    return feeds.map_malware_records(entries).select("url", "file_size", "tags", "asn", "reporter_handle")


@query(
    "comments_text",
    """
SELECT id AS file_size, CASE WHEN id % 2 = 0 THEN 'seen ' || CAST(id AS VARCHAR) END AS comments FROM obs
WHERE source_feed = 'urlhaus' AND id % 10 NOT IN (4, 9)""",
)
def comments_text(spark, sf_dir):
    entries = feeds.read_malware_json(spark, f"{_envelopes(spark, sf_dir)}/file=*")
    return feeds.map_malware_records(entries).select("file_size", "comments")
