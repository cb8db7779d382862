"""Readers for landed feed files, and the mapping of their records to raw tables.

The readers take files, folders or globs. Gzip and bzip2 are chosen by file
suffix. A JSON array or envelope is one record per file for Spark, of at most 2 GB, so land a
feed as many files (one per download) rather than one ever-growing file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hooktrace.functions import fields
from hooktrace.functions.dates import as_of_column
from hooktrace.functions.urls import feed_host
from hooktrace.schemas import MALWARE_FEED_JSON, PHISH_FEED_JSON

_BLANKS = " \t\n\r\f\v"
_PHISH_CSV_COLUMNS = [f.name for f in PHISH_FEED_JSON if f.name != "details"]


def feed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep URL lines: not blank, and not starting with ``#`` (an indented ``#`` stays)."""
    text = F.col(column)
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return lines.where((trimmed != "") & ~text.startswith("#")).withColumn(column, trimmed)


def read_line_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One URL per line, with its host."""
    lines = feed_lines(spark.read.text(path))
    return lines.select(
        F.col("value").alias("url"), feed_host(F.col("value")).alias("domain")
    )


def _json(spark: SparkSession, schema, path: str | list[str], lines: bool) -> DataFrame:
    # A file that is cut off or not JSON ends the read with an error instead of losing its records.
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    # A whole file is one record up to a byte that JSON cannot hold. With multiLine Spark would go back to the
    # file, by at least a buffer, for the text of every list or number that is wanted as a string.
    return (reader if lines else reader.option("lineSep", "\0")).json(path)


def read_phish_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """JSON array feed, plain or compressed, as unmapped records.

    With ``lines`` files have one record per line; plain and bzip2 files of any size are then split.
    """
    return _json(spark, PHISH_FEED_JSON, path, lines)


def read_phish_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """CSV form of the same feed: found by header, a missing target is an empty text.

    Without line breaks inside of values say ``multi_line=False``: large files are then split.
    """
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )
    details = PHISH_FEED_JSON["details"].dataType
    known = [
        F.col(name) if name in rows.columns else F.lit(None).cast("string").alias(name)
        for name in _PHISH_CSV_COLUMNS
        if name != "target"
    ]
    target = F.coalesce(F.col("target"), F.lit("")) if "target" in rows.columns else F.lit("")
    return rows.select(
        *known, target.alias("target"), F.array().cast(details).alias("details")
    ).select(*[f.name for f in PHISH_FEED_JSON])


def map_phish_records(records: DataFrame) -> DataFrame:
    """Feed records to raw table columns: id as number, flags as yes/no, first detail only."""
    detail = fields.first_item(F.col("details"))
    return records.select(
        fields.safe_int(F.col("phish_id")).alias("phish_id"),
        "url",
        "phish_detail_url",
        "submission_time",
        fields.yes_no(F.col("verified")).alias("verified"),
        "verification_time",
        fields.yes_no(F.col("online")).alias("online"),
        "target",
        *[
            detail[name].alias(name)
            for name in ("ip_address", "cidr_block", "announcing_network", "rir", "detail_time")
        ],
    )


def read_malware_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Entries of all envelopes whose status is ``ok``; with ``lines`` there is an envelope per line."""
    envelopes = _json(spark, MALWARE_FEED_JSON, path, lines)
    return envelopes.where(F.col("query_status") == "ok").select(F.inline("urls"))


def tags_text(tags: Column) -> Column:
    """Raw JSON tags to comma text: a list is joined, plain text is kept."""
    as_list = F.from_json(tags, "array<string>")
    return F.when(tags.startswith("["), fields.joined_list(as_list)).otherwise(tags)


def map_malware_records(entries: DataFrame) -> DataFrame:
    """Feed entries to raw table columns with their fallback names resolved."""
    c = F.col
    return entries.select(
        "url",
        "url_status",
        fields.first_text(c("date_added"), c("url_dateadded")).alias("url_dateadded"),
        fields.first_text(c("lastseen"), c("url_lastseen")).alias("url_lastseen"),
        "reporter",
        fields.first_text(c("reporter_handle"), c("reporter")).alias("reporter_handle"),
        F.lit(None).cast("string").alias("verifier"),
        "threat",
        tags_text(c("tags")).alias("tags"),
        "file_md5",
        "file_sha256",
        fields.first_text(c("filename"), c("file_name")).alias("file_name"),
        fields.safe_int(c("file_size")).alias("file_size"),
        "payload_type",
        "distribution",
        fields.safe_int(c("asn")).alias("asn"),
        "country",
        fields.first_text(c("reference"), c("referrer")).alias("referrer"),
        F.lit(None).cast("string").alias("request_headers"),
        fields.safe_int(c("response_code")).alias("response_code"),
        "cloaking",
        "comments",
    )


def stamped(rows: DataFrame, column: str, as_of) -> DataFrame:
    """Add the load time that the raw tables keep for new rows."""
    return rows.withColumn(column, as_of_column(as_of))
