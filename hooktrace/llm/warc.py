"""WARC archives: write records with segments and chunked framing, read and reassemble them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 2_000
REVISIT_LEAST = 1_000
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, "
    "segment int, origin string, total_length long, block binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line without end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter or longer than its size says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, with chunked framing decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
        return dechunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    # The writer ends every row with the last line feed.
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r"


def _header_value(text: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", text or "").strip()


def _written(segment_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out: list[bytes] = []
            for row in frame.itertuples(index=False):
                name = f"<urn:page:{row.record}>"
                common = [("WARC-Date", _DATE), ("WARC-Target-URI", _header_value(row.url))]
                digest = [("WARC-Payload-Digest", f"sha1:{row.digest}")]
                if row.refers_to is not None:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *digest]
                    fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:page:{row.refers_to}>")]
                    out.append(_record([*fields, ("Content-Type", "application/http; msgtype=response")], head))
                    continue
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                block = head + chunked(bytes(row.payload))
                cuts = range(0, len(block), segment_bytes)
                for number, at in enumerate(cuts, 1):
                    piece = block[at : at + segment_bytes]
                    if number == 1:
                        fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *digest]
                        fields.append(("Content-Type", "application/http; msgtype=response"))
                        if len(cuts) > 1:
                            fields.append(("WARC-Segment-Number", 1))
                    else:
                        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{row.record}:{number}>")]
                        fields += [*common, ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", name)]
                        if number == len(cuts):
                            fields.append(("WARC-Segment-Total-Length", len(block)))
                    out.append(_record(fields, piece))
            yield pd.DataFrame({"record": out})

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
    compression: str = "none",
) -> None:
    """Write one record per page below ``path``.

    ``pages`` holds ``record`` (a name that is unique in the archive), ``url``, ``payload`` (binary),
    ``digest`` and ``refers_to`` (the name of the record with the same payload, or null). Blocks
    longer than ``segment_bytes`` become a first record and continuation records. A file has at
    most ``records_per_file`` records, which bounds what a reader holds at once.
    """
    columns = pages.select("record", "url", "payload", "digest", "refers_to")
    lines = columns.mapInPandas(_written(segment_bytes), "record binary")
    # A cast from binary keeps the bytes as they are; each row is a record but for its last line feed.
    rows = lines.select(F.col("record").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one uncompressed archive, found by their stated lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record header at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "record_id": fields.get("warc-record-id"),
            "warc_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest"),
            "refers_to": fields.get("warc-refers-to"),
            "segment": None if number is None else int(number),
            "origin": fields.get("warc-segment-origin-id"),
            "total_length": None if total is None else int(total),
            "block": block,
        }
        at = end + 4 + size


def _inflated(content: bytes) -> bytes:
    """The plain bytes of an archive: as they are, one gzip member, or one for each record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        unzip = zlib.decompressobj(31)
        parts += [unzip.decompress(content), unzip.flush()]
        content = unzip.unused_data
    return b"".join(parts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, one row each; see ``RECORD`` for the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in batches:
            for content in frame["content"]:
                rows, held = [], 0
                for record in parse_records(_inflated(bytes(content))):
                    rows.append(record)
                    held += len(record["block"])
                    if held > 8_000_000:
                        yield _typed(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _typed(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def _typed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"segment": "Int32", "total_length": "Int64"})


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments joined in order, lengths verified, payloads decoded.

    A record without a segment number is whole as it is and is not shuffled. Segments are grouped
    by the id of their first record, so a group is one record of the original size. Adds
    ``payload`` (null for revisits and where something is wrong) and ``problem``:
    ``orphan`` (continuations without a first record), ``gap`` (a number missing or twice),
    ``length`` (no stated total, or another one), ``framing`` (HTTP or chunk framing broken), else
    null. A continuation without origin has the problem ``orphan`` for itself.
    """
    names = ["record_id", "warc_type", "target_uri", "payload_digest", "refers_to"]
    is_part = F.col("segment").isNotNull() | (F.col("warc_type") == "continuation")
    lost = (F.col("warc_type") == "continuation") & F.col("origin").isNull()
    whole = records.where(~F.coalesce(is_part, F.lit(False)) | F.coalesce(lost, F.lit(False)))
    whole = whole.select(*names, "block", F.when(lost, "orphan").alias("problem"))
    parts = records.where(is_part & ~F.coalesce(lost, F.lit(False)))
    parts = parts.withColumn("key", F.coalesce("origin", "record_id"))
    first = (F.col("segment") == 1) & F.col("origin").isNull()
    grouped = parts.groupBy("key").agg(
        *[F.max(F.when(first, F.col(n))).alias(n) for n in names],
        F.max("total_length").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("bytes")))).alias("pieces"),
    )
    joined = F.array_join(F.col("pieces.bytes"), "").cast("binary")
    numbers = F.col("pieces.segment")
    grouped = grouped.select(*names, "key", "total", numbers.alias("numbers"), joined.alias("block"))
    expected = F.sequence(F.lit(1), F.size("numbers"))
    problem = (
        F.when(F.col("record_id").isNull(), "orphan")
        .when(F.col("numbers") != expected, "gap")
        .when(F.col("total").isNull() | (F.col("total") != F.octet_length("block")), "length")
    )
    grouped = grouped.select(F.coalesce("record_id", "key").alias("record_id"), *names[1:], "block", problem.alias("problem"))

    @F.pandas_udf("payload binary, broken boolean")
    def decoded(block: pd.Series) -> pd.DataFrame:
        out = []
        for data in block:
            try:
                out.append((http_payload(bytes(data)), False) if data is not None else (None, False))
            except ValueError:
                out.append((None, True))
        return pd.DataFrame(out, columns=["payload", "broken"])

    rows = whole.unionByName(grouped)
    body = F.when((F.col("warc_type") == "response") & F.col("problem").isNull(), F.col("block"))
    rows = rows.select(*names, "problem", decoded(body).alias("d"))
    return rows.select(*names, "d.payload", F.when(F.col("d.broken"), "framing").otherwise(F.col("problem")).alias("problem"))


def revisit_targets(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """(row, refers_to_row) for rows whose payload another row of a larger id carries.

    ``pages``: row (unique name), page_id, digest, bytes. Only names and digests are shuffled. The
    winner of a digest is found by a partial maximum before the shuffle, and the join back is an
    ordinary skew-splittable one, so a payload held by a third of all rows is no special case.
    """
    large = pages.where(F.col("bytes") >= least)
    best = large.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = best.where("n > 1").select("digest", "best.row", "best.page_id")
    found = large.alias("p").join(best.alias("b"), F.col("p.digest") == F.col("b.digest"))
    found = found.where("not (p.page_id <=> b.page_id)")
    return found.select(F.col("p.row").alias("row"), F.col("b.row").alias("refers_to"))


def archive_pages(pages: DataFrame, path: str, *, compression: str = "none", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages (page_id, url, html) as archives, with revisits for repeated payloads.

    A null html is an empty payload, a null url an empty target. Rows that repeat a page id get
    names of their own; of equal payloads every row with the largest page id is a response.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    row = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64("url", "payload"))))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("name", row)
    targets = revisit_targets(rows.select(F.col("name").alias("row"), "page_id", "digest", "bytes").distinct())
    marked = rows.join(targets.withColumnRenamed("row", "name"), "name", "left")
    # Rows equal in every column share a name: the first keeps it, the others get a number. The
    # join has dealt the rows by name already, so this moves nothing.
    number = F.row_number().over(Window.partitionBy("name").orderBy("page_id"))
    marked = marked.withColumn("n", number)
    record = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("+", "name", "n"))
    write_archives(
        marked.select(record.alias("record"), "url", "payload", "digest", "refers_to"),
        path,
        compression=compression,
        segment_bytes=segment_bytes,
    )


def restore_payloads(records: DataFrame) -> DataFrame:
    """Reassembled records with the digest and length of the payload they stand for.

    Adds ``sha1`` (lower-case hex) and ``bytes``: of the payload itself for responses, of the
    response referred to for revisits (null if that is not in the archives). ``verified`` says
    whether the digest equals the one in the header.
    """
    names = ["record_id", "warc_type", "target_uri", "refers_to", "problem"]
    slim = records.select(*names, F.col("payload_digest").alias("stated"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    responses = slim.where("warc_type = 'response'")
    revisits = slim.where("warc_type = 'revisit'").drop("sha1", "bytes")
    source = responses.select(F.col("record_id").alias("refers_to"), "sha1", "bytes")
    restored = revisits.join(source, "refers_to", "left").select(*slim.columns)
    everything = responses.unionByName(restored)
    good = F.col("stated") == F.concat(F.lit("sha1:"), F.col("sha1"))
    return everything.withColumn("verified", F.coalesce(good, F.lit(False))).drop("stated")


def page_of(record_id):
    """The page id in a record's name; null for pages without one."""
    text = F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)-[0-9a-f]+(?:[+][0-9]+)?>$", 1)
    return F.when(text != "", text.cast("bigint"))
