"""CSV and STIX 2.1 exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions.dates import as_of_column
from hooktrace.functions.fields import present_number, present_text
from hooktrace.operators.numbering import By, numbered
from hooktrace.operators.paging import first_rows

# A bundle is one document, so it has a bound; no other export is cut unless the caller asks.
MAX_BUNDLE_ROWS = 50_000

# Fixed value of the exported indicators.
INDICATOR_TYPE = "malicious-activity"


def export_rows(threats: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows, unsorted; with a ``limit`` the first by id."""
    return threats if limit is None else first_rows(threats, limit)


def write_csv(threats: DataFrame, path: str, limit: int | None = None) -> None:
    """Folder of CSV files with a header each."""
    export_rows(threats, limit).write.option("header", True).option("escape", '"').csv(path)


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _stix_id(kind: str, text: Column) -> Column:
    """Stable UUID-shaped id from a text (custom version 8, RFC variant)."""
    digest = F.sha2(text, 256)
    part = lambda start, length: F.substring(digest, start, length)
    return F.concat(
        F.lit(f"{kind}--"),
        F.concat_ws(
            "-",
            part(1, 8),
            part(9, 4),
            F.concat(F.lit("8"), part(14, 3)),
            F.concat(F.lit("a"), part(18, 3)),
            part(21, 12),
        ),
    )


def _pattern_text(url: Column) -> Column:
    """URL as a STIX string literal: backslash and quote are escaped."""
    slashes = F.replace(url, F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashes, F.lit("'"), F.lit("\\'"))


def stix_indicators(
    threats: DataFrame, as_of, limit: int | None = None
) -> DataFrame:
    """One indicator per threat with a URL: columns ``id`` and ``indicator`` (JSON text).

    Absent properties are left out of the JSON.
    """
    c = F.col
    seen = _iso(F.coalesce(c("first_seen"), as_of_column(as_of)))
    labels = F.array_compact(
        F.array(
            present_text(c("threat_type")),
            F.concat(F.lit("targets-"), present_text(c("target_brand"))),
            F.when(c("online") == "yes", "active"),
        )
    )
    indicator = F.struct(
        F.lit("indicator").alias("type"),
        F.lit("2.1").alias("spec_version"),
        _stix_id("indicator", c("url")).alias("id"),
        seen.alias("created"),
        seen.alias("modified"),
        F.concat(F.lit("Phishing URL: "), F.coalesce(c("domain"), F.lit("Unknown"))).alias("name"),
        F.concat(
            F.lit("Malicious URL detected by "), F.coalesce(c("source_feed"), F.lit("Unknown"))
        ).alias("description"),
        F.array(F.lit(INDICATOR_TYPE)).alias("indicator_types"),
        F.concat(F.lit("[url:value = '"), _pattern_text(c("url")), F.lit("']")).alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        seen.alias("valid_from"),
        F.when(F.size(labels) > 0, labels).alias("labels"),
        present_text(c("ip_address")).alias("x_ip_address"),
        present_text(c("country")).alias("x_country"),
        present_number(c("asn")).alias("x_asn"),
        present_text(c("asn_name")).alias("x_asn_name"),
        present_text(c("ssl_enabled")).alias("x_ssl_enabled"),
    )
    chosen = export_rows(threats.where(present_text(c("url")).isNotNull()), limit)
    return chosen.select("id", F.to_json(indicator).alias("indicator"))


def write_stix(
    threats: DataFrame, path: str, as_of, limit: int | None = None
) -> None:
    """Folder of JSON-lines files, one indicator per line; works at any size."""
    stix_indicators(threats, as_of, limit).select("indicator").write.text(path)


def stix_bundle(
    threats: DataFrame,
    as_of,
    limit: int,
    identity_name: str = "Threat feed analytics",
) -> DataFrame:
    """One row with a bundle of the first ``limit`` threats by id, as JSON text.

    The identity of the sender comes first, then the indicators. A bundle is one document and so
    one row, and the caller says how many threats it may have; ``write_stix`` writes any number.
    """
    if limit is None or limit > MAX_BUNDLE_ROWS:
        raise ValueError(f"a bundle holds at most {MAX_BUNDLE_ROWS} rows; use write_stix")
    members = F.sort_array(F.collect_list(F.struct("id", "indicator")))
    chosen = stix_indicators(threats, as_of, limit)
    return chosen.agg(_bundle_text(members, as_of, identity_name).alias("bundle"))


def stix_bundles(
    threats: DataFrame,
    as_of,
    size: int = MAX_BUNDLE_ROWS,
    identity_name: str = "Threat feed analytics",
) -> DataFrame:
    """All threats as bundles of ``size`` indicators by id: ``bundle_no`` from 0, ``indicators`` and ``bundle``.

    Every indicator is in one bundle, the last may be shorter, and each has the identity. Rows are
    numbered by ranges, so a task only ever gathers the rows of a bundle. Without threats there is none.
    """
    if not 0 < size <= MAX_BUNDLE_ROWS:
        raise ValueError(f"a bundle holds 1 to {MAX_BUNDLE_ROWS} rows")
    placed = numbered(stix_indicators(threats, as_of), [By("id")])
    members = F.sort_array(F.collect_list(F.struct("row_no", "indicator")))
    cut = placed.groupBy(F.floor(F.col("row_no") / size).alias("bundle_no")).agg(members.alias("members"))
    return cut.select(
        "bundle_no",
        F.size("members").alias("indicators"),
        _bundle_text(F.col("members"), as_of, identity_name, F.col("bundle_no")).alias("bundle"),
    )


def write_stix_bundles(threats: DataFrame, path: str, as_of, size: int = MAX_BUNDLE_ROWS, **options) -> None:
    """Folder of text files with one bundle per line."""
    stix_bundles(threats, as_of, size, **options).select("bundle").write.text(path)


def _bundle_text(members: Column, as_of, identity_name: str, number: Column | None = None) -> Column:
    """A bundle of the ``indicator`` texts of an array, the identity first."""
    now = _iso(as_of_column(as_of))
    name = [F.lit(identity_name), now] + ([] if number is None else [F.lit("/"), number.cast("string")])
    identity = F.to_json(
        F.struct(
            F.lit("identity").alias("type"),
            F.lit("2.1").alias("spec_version"),
            _stix_id("identity", F.lit(identity_name)).alias("id"),
            now.alias("created"),
            now.alias("modified"),
            F.lit(identity_name).alias("name"),
            F.lit("system").alias("identity_class"),
        )
    )
    objects = F.concat_ws(",", F.array(identity), F.transform(members, lambda m: m["indicator"]))
    return F.concat(
        F.lit('{"type":"bundle","id":"'), _stix_id("bundle", F.concat(*name)), F.lit('","objects":['), objects, F.lit("]}")
    )
