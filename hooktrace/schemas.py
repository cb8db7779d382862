"""Fixed table schemas and the order of the three feeds."""

from __future__ import annotations

from pyspark.sql import types as T

# Feeds in reading order. For one URL in several feeds the later feed wins.
FEED_RANK = {"openphish": 0, "phishtank": 1, "urlhaus": 2}


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """Flat schema from text. Unlike ``StructType.fromDDL`` it needs no running session."""
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_LINE_FEED = _struct("id BIGINT, url STRING, domain STRING, added_at TIMESTAMP_NTZ, note STRING")

RAW_PHISH_FEED = _struct(
    "phish_id BIGINT, url STRING, phish_detail_url STRING, submission_time STRING, "
    "verified STRING, verification_time STRING, online STRING, target STRING, "
    "ip_address STRING, cidr_block STRING, announcing_network STRING, rir STRING, "
    "detail_time STRING, inserted_at TIMESTAMP_NTZ"
)

RAW_MALWARE_FEED = _struct(
    "urlhaus_id BIGINT, url STRING, url_status STRING, url_dateadded STRING, "
    "url_lastseen STRING, reporter STRING, reporter_handle STRING, verifier STRING, "
    "threat STRING, tags STRING, file_md5 STRING, file_sha256 STRING, file_name STRING, "
    "file_size BIGINT, payload_type STRING, distribution STRING, asn BIGINT, "
    "country STRING, referrer STRING, request_headers STRING, response_code BIGINT, "
    "cloaking STRING, comments STRING, inserted_at TIMESTAMP_NTZ"
)

ENRICHED = _struct(
    "id BIGINT, url STRING, domain STRING, online STRING, http_status_code INT, "
    "ip_address STRING, cidr_block STRING, asn BIGINT, asn_name STRING, isp STRING, "
    "country STRING, country_name STRING, region STRING, city STRING, latitude DOUBLE, "
    "longitude DOUBLE, ssl_enabled STRING, cert_issuer STRING, cert_subject STRING, "
    "cert_valid_from STRING, cert_valid_to STRING, cert_serial STRING, tld STRING, "
    "registrar STRING, creation_date TIMESTAMP_NTZ, expiry_date TIMESTAMP_NTZ, "
    "updated_date TIMESTAMP_NTZ, name_servers STRING, page_language STRING, "
    "page_title STRING, threat_type STRING, target_brand STRING, threat_tags STRING, "
    "source_feed STRING, source_id STRING, first_seen TIMESTAMP_NTZ, "
    "last_seen TIMESTAMP_NTZ, last_checked TIMESTAMP_NTZ, notes STRING, risk_score INT, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)

WORK_LIST = _struct(
    "url STRING, source_feed STRING, source_id STRING, feed_rank INT, online STRING, "
    "target STRING, ip_address STRING, cidr_block STRING, asn BIGINT, rir STRING, "
    "threat STRING, tags STRING, country STRING, feed_domain STRING"
)

# Read schema of the JSON array feed. Flags come as booleans or text and are read as text.
PHISH_FEED_JSON = _struct(
    "phish_id STRING, url STRING, phish_detail_url STRING, submission_time STRING, "
    "verified STRING, verification_time STRING, online STRING, target STRING"
).add(
    "details",
    T.ArrayType(
        _struct(
            "ip_address STRING, cidr_block STRING, announcing_network STRING, rir STRING, "
            "detail_time STRING"
        )
    ),
)

# Read schema of the malware feed. Tags come as a list or as text, comments as text or as
# any JSON value; both are read as raw JSON text.
MALWARE_FEED_JSON = _struct("query_status STRING").add(
    "urls",
    T.ArrayType(
        _struct(
            "url STRING, url_status STRING, date_added STRING, url_dateadded STRING, "
            "lastseen STRING, url_lastseen STRING, reporter STRING, reporter_handle STRING, "
            "threat STRING, tags STRING, file_md5 STRING, file_sha256 STRING, filename STRING, "
            "file_name STRING, file_size STRING, payload_type STRING, distribution STRING, "
            "asn STRING, country STRING, reference STRING, referrer STRING, "
            "response_code STRING, cloaking STRING, comments STRING"
        )
    ),
)
