"""Joins of URLs, domains and IP addresses with snapshot tables.

Snapshots take the place of live DNS, WHOIS, certificate, RDAP, GeoIP and page
requests. Range lookups are equi-joins: every range is cut into aligned blocks
of a power-of-two size, and an address lies in exactly one block per size. Every
range that has a block holds all addresses of it, so only the narrowest range of
a block is kept before the join, and an address meets at most one row per size,
however often a range is repeated. IPv4 blocks are at most a /16, so one join key
never holds more than 65,536 addresses. IPv6 is looked up by CIDR prefix, and ranges whose ends
are address text (of both families) by their sorted segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions import fields
from hooktrace.functions.dates import utc_timestamp
from hooktrace.functions.ipaddr import (
    IPV6_MARK,
    cidr6_prefix,
    cidr_high,
    cidr_low,
    cidr_prefix,
    ip_key,
    ipv6_hex,
    ipv6_network,
)
from hooktrace.functions.urls import base_domain, url_host
from hooktrace.operators.asof import join_as_of
from hooktrace.operators.ranges import range_segments, segment_lookup
from hooktrace.operators.skew import balanced_left_join
from hooktrace.operators.upsert import one_per_key

BLOCK_BITS = 16


def _shift(value: Column, bits: Column | int, function: str = "shiftright") -> Column:
    return F.call_function(function, value, F.lit(bits) if isinstance(bits, int) else bits)


def range_blocks(low: Column, high: Column) -> Column:
    """Array of aligned blocks (bits, block) that together are exactly the range.

    With ``l = ceil(low / 2^b)`` and ``r = floor((high + 1) / 2^b)``, size ``b`` gives a left
    block where ``l`` is odd and a right one where ``r`` is odd, as long as ``l < r``; what is
    left at the largest size is a run of whole blocks.
    """
    end = high + F.lit(1)
    first = lambda b: _shift(low + _shift(F.lit(1).cast("bigint"), b, "shiftleft") - F.lit(1), b)
    last = lambda b: _shift(end, b)
    block = lambda b, n: F.struct(b.cast("int").alias("bits"), n.cast("bigint").alias("block"))
    edges = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)),
            lambda b: F.array(
                F.when((first(b) < last(b)) & (first(b) % 2 == 1), block(b, first(b))),
                F.when((first(b) < last(b)) & (last(b) % 2 == 1), block(b, last(b) - 1)),
            ),
        )
    )
    top = F.lit(BLOCK_BITS)
    whole = F.when(
        first(top) < last(top),
        F.transform(F.sequence(first(top), last(top) - 1), lambda n: block(top, n)),
    ).otherwise(F.array().cast("array<struct<bits:int,block:bigint>>"))
    return F.array_compact(F.concat(edges, whole))


def _narrowest_first(payload: Sequence[str]) -> list[Column]:
    return [F.asc(F.col("hi") - F.col("lo")), F.asc("lo"), *[F.asc_nulls_last(c) for c in payload]]


def narrowest_pieces(ranges: DataFrame, payload: Sequence[str]) -> DataFrame:
    """The narrowest range of every block (bits, block) that ranges are cut into."""
    pieces = ranges.where(F.col("lo") <= F.col("hi")).select(
        F.inline(range_blocks(F.col("lo"), F.col("hi"))), "lo", "hi", *payload
    )
    return one_per_key(pieces, ["bits", "block"], _narrowest_first(payload))


def range_lookup(
    addresses: DataFrame, ranges: DataFrame, payload: Sequence[str], ip: str = "ip"
) -> DataFrame:
    """Payload of the narrowest range that holds each address; addresses in none are left out.

    ``addresses`` has one row per address (BIGINT column ``ip``); ``ranges`` has
    inclusive ``lo`` and ``hi`` and may nest or overlap.
    """
    blocks = range_blocks(F.col("lo"), F.col("hi"))
    pieces = narrowest_pieces(ranges, payload)
    # At most BLOCK_BITS + 1 sizes exist, so this set is tiny whatever the ranges are.
    sizes = (
        ranges.where(F.col("lo") <= F.col("hi"))
        .select(F.explode(F.array_distinct(F.transform(blocks, lambda x: x["bits"]))).alias("bits"))
        .agg(F.collect_set("bits").alias("sizes"))
        .scalar()
    )
    probes = (
        addresses.select(ip)
        .withColumn("bits", F.explode(sizes))
        .withColumn("block", _shift(F.col(ip), F.col("bits")))
    )
    found = probes.join(pieces, ["bits", "block"]).drop("bits", "block")
    return one_per_key(found, ip, _narrowest_first(payload)).drop("lo", "hi")


def cidr_ranges(snapshot: DataFrame, column: str = "cidr_block") -> DataFrame:
    """CIDR snapshot as ranges; a comma list of blocks becomes one range per block."""
    each = snapshot.withColumn("__cidr", F.explode(F.split(column, r"\s*,\s*")))
    cidr = F.col("__cidr")
    return (
        each.where(cidr_prefix(cidr).isNotNull())
        .withColumns({"lo": cidr_low(cidr), "hi": cidr_high(cidr)})
        .where(F.col("lo").isNotNull())
        .drop("__cidr")
    )


def cidr6_lookup(
    addresses: DataFrame, snapshot: DataFrame, payload: Sequence[str], column: str = "cidr_block"
) -> DataFrame:
    """Payload of the longest IPv6 prefix that holds each address (32 digits in ``ip``)."""
    text = F.col("__cidr")
    blocks = snapshot.withColumn("__cidr", F.explode(F.split(column, r"\s*,\s*")))
    blocks = blocks.select(
        cidr6_prefix(text).alias("bits"), ipv6_hex(F.substring_index(text, "/", 1)).alias("digits"), *payload
    ).where(F.col("bits").isNotNull() & F.col("digits").isNotNull())
    blocks = blocks.withColumn("network", ipv6_network(F.col("digits"), F.col("bits"))).drop("digits")
    blocks = one_per_key(blocks, ["bits", "network"], [F.asc_nulls_last(c) for c in payload])
    # At most 129 lengths exist.
    lengths = blocks.agg(F.collect_set("bits").alias("lengths")).scalar()
    probes = addresses.select("ip").withColumn("bits", F.explode(lengths))
    probes = probes.withColumn("network", ipv6_network(F.col("ip"), F.col("bits")))
    found = probes.join(blocks, ["bits", "network"]).drop("network")
    return one_per_key(found, "ip", [F.desc("bits")]).drop("bits")


def address_lookup(
    addresses: DataFrame, table: DataFrame, payload: Sequence[str], ip: str = "ip"
) -> DataFrame:
    """Payload by address key: by range or by CIDR block.

    ``table`` has ``lo`` and ``hi`` as IPv4 numbers, or as address text of either family, or
    ``cidr_block`` as text of either family.
    """
    if "lo" in table.columns and table.schema["lo"].dataType.typeName() == "string":
        return segment_lookup(addresses, range_segments(table, payload), ip)
    ranges = table if "lo" in table.columns else cidr_ranges(table)
    is_six = F.col(ip).startswith(IPV6_MARK)
    four = addresses.where(~is_six).select(F.col(ip).cast("bigint").alias(ip))
    found = range_lookup(four, ranges, payload, ip).withColumn(ip, F.col(ip).cast("string"))
    if "cidr_block" not in table.columns:
        return found
    six = addresses.where(is_six).select(F.substr(F.col(ip), F.lit(2)).alias("ip"))
    longest = cidr6_lookup(six, table, payload).withColumn("ip", F.concat(F.lit(IPV6_MARK), "ip"))
    return found.unionByName(longest.withColumnRenamed("ip", ip))


def distinct_ips(*columns: DataFrame) -> DataFrame:
    """Distinct address keys as ``ip`` of one-column frames: of IP text, or of keys (called ``ip``)."""
    keys = []
    for frame in columns:
        (column,) = frame.columns
        keys.append(frame.select((F.col(column) if column == "ip" else ip_key(F.col(column))).alias("ip")))
    rows = reduce(DataFrame.union, keys)
    return rows.where(F.col("ip").isNotNull()).distinct()


def resolve_ips(
    addresses: DataFrame,
    city: DataFrame | None = None,
    country: DataFrame | None = None,
    asn: DataFrame | None = None,
    rdap: DataFrame | None = None,
) -> DataFrame:
    """One row per address with what the given snapshots know of it.

    Every lookup is by the distinct address, so the work does not grow with the
    number of URLs per address, and all results meet on the same partitioning.
    """
    resolved = addresses
    if city is not None:
        names = ["country", "country_name", "region", "city", "latitude", "longitude"]
        found = address_lookup(addresses, city, names)
        resolved = resolved.join(_prefixed(found, names, "geo_"), "ip", "left")
    if country is not None:
        found = address_lookup(addresses, country, ["country", "country_name"])
        resolved = resolved.join(_prefixed(found, ["country", "country_name"], "fallback_"), "ip", "left")
    if asn is not None:
        found = address_lookup(addresses, asn, ["asn", "asn_name"])
        resolved = resolved.join(_prefixed(found, ["asn", "asn_name"], "geo_"), "ip", "left")
    if rdap is not None:
        names = ["cidr_block", "asn", "asn_name", "isp", "country"]
        found = address_lookup(addresses, rdap, names)
        resolved = resolved.join(_prefixed(found, names, "rdap_"), "ip", "left")
    return _with_country_fallback(_with_all_columns(resolved))


_IP_COLUMNS = {
    "geo_country": "string", "geo_country_name": "string", "geo_region": "string",
    "geo_city": "string", "geo_latitude": "double", "geo_longitude": "double",
    "fallback_country": "string", "fallback_country_name": "string",
    "geo_asn": "bigint", "geo_asn_name": "string",
    "rdap_cidr_block": "string", "rdap_asn": "bigint", "rdap_asn_name": "string",
    "rdap_isp": "string", "rdap_country": "string",
}


def _prefixed(rows: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return rows.withColumnsRenamed({n: prefix + n for n in names})


def _with_all_columns(rows: DataFrame) -> DataFrame:
    present = set(rows.columns)
    missing = {c: F.lit(None).cast(t) for c, t in _IP_COLUMNS.items() if c not in present}
    return rows.withColumns(missing) if missing else rows


def _with_country_fallback(rows: DataFrame) -> DataFrame:
    """The country table speaks only where the city table names no country."""
    no_country = fields.present_text(F.col("geo_country")).isNull()
    use_fallback = no_country & F.col("fallback_country").isNotNull()
    pick = lambda name: F.when(use_fallback, F.col(f"fallback_{name}")).otherwise(F.col(f"geo_{name}"))
    return rows.withColumns(
        {f"geo_{n}": pick(n) for n in ("country", "country_name")}
    ).drop("fallback_country", "fallback_country_name")


def join_dns(rows: DataFrame, dns: DataFrame, spread: Column | None = None) -> DataFrame:
    """Fill a missing IP address from the DNS snapshot (domain, ip_address)."""
    known = one_per_key(dns, "domain", latest_first(dns, "domain")).select(
        "domain", F.col("ip_address").alias("dns_ip")
    )
    joined = balanced_left_join(rows, known, "domain", _spread(spread))
    return joined.withColumn(
        "ip_address", F.coalesce(fields.present_text(F.col("ip_address")), F.col("dns_ip"))
    ).drop("dns_ip")


def join_ip(rows: DataFrame, resolved: DataFrame, spread: Column | None = None) -> DataFrame:
    """Attach resolved addresses to rows by their IP text."""
    keyed = rows.withColumn("ip", ip_key(F.col("ip_address")))
    return balanced_left_join(keyed, resolved, "ip", _spread(spread)).drop("ip")


def whois_columns(snapshot: DataFrame) -> DataFrame:
    """Shape a WHOIS snapshot: list-or-scalar fields hold lists, the first entry counts.

    Dates may be text; what is not ISO text (with or without a time and an offset) becomes NULL.
    """
    shaped = {}
    for name in ("registrar", "creation_date", "expiry_date", "updated_date"):
        if name not in snapshot.columns:
            continue
        kind, value = snapshot.schema[name].dataType, F.col(name)
        if kind.typeName() == "array":
            kind, value = kind.elementType, fields.first_item(value)
        if name != "registrar" and kind.typeName() == "string":
            value = utc_timestamp(F.trim(value))
        shaped[name] = value
    if (
        "name_servers" in snapshot.columns
        and snapshot.schema["name_servers"].dataType.typeName() == "array"
    ):
        servers = F.col("name_servers")
        shaped["name_servers"] = F.when(F.size(servers) > 0, fields.joined_list(servers))
    return snapshot.withColumns(shaped) if shaped else snapshot


def join_whois(
    rows: DataFrame, whois: DataFrame, spread: Column | None = None, at: str | None = None
) -> DataFrame:
    """Registration data by registrable domain; ``whois`` is keyed by ``base_domain``."""
    keyed = rows.withColumn("base_domain", base_domain(F.col("domain")))
    return _join_captures(keyed, whois_columns(whois), "base_domain", _spread(spread), at).drop("base_domain")


def cert_columns(snapshot: DataFrame) -> DataFrame:
    """Shape a certificate snapshot whose issuer and subject are name-to-text maps."""
    shaped = snapshot
    if "issuer" in snapshot.columns:
        shaped = shaped.withColumn("cert_issuer", fields.cert_issuer(F.col("issuer"))).drop("issuer")
    if "subject" in snapshot.columns:
        shaped = shaped.withColumn("cert_subject", fields.cert_subject(F.col("subject"))).drop("subject")
    return shaped


def join_cert(
    rows: DataFrame, certs: DataFrame, spread: Column | None = None, at: str | None = None
) -> DataFrame:
    """Certificate by domain; a domain without one has ``ssl_enabled`` = ``no``."""
    shaped = cert_columns(certs).withColumn("ssl_enabled", F.lit("yes"))
    joined = _join_captures(rows, shaped, "domain", _spread(spread), at)
    return joined.withColumn("ssl_enabled", F.coalesce("ssl_enabled", F.lit("no")))


CAPTURED = "captured_at"


def _captured(snapshot: DataFrame) -> list[str]:
    return [CAPTURED] if CAPTURED in snapshot.columns else []


def _join_captures(rows: DataFrame, captures: DataFrame, key: str, spread: Column, at: str | None) -> DataFrame:
    """Rows with the newest capture of their key or, given a column ``at``, the newest one not after it."""
    order = latest_first(captures, key)
    if at is None or CAPTURED not in captures.columns:
        return balanced_left_join(rows, one_per_key(captures, key, order).drop(CAPTURED), key, spread)
    return join_as_of(rows, captures, key, at, CAPTURED, spread, order)


def latest_first(snapshot: DataFrame, key: str) -> list[Column]:
    """Order of the rows of a key: the newest capture where there is a capture time, then by content."""
    newest = [F.desc_nulls_last(c) for c in _captured(snapshot)]
    return newest + [F.asc_nulls_last(c) for c in snapshot.columns if c not in (key, CAPTURED)]


def page_columns(pages: DataFrame) -> DataFrame:
    """What is kept of a fetched page: status, online flag, title and language.

    Pages are cut down to these short columns before they meet the URL table,
    so page text is never shuffled with it.
    """
    status = F.col("status")
    html = F.col("html")
    # Why there was no answer: a refused connection says offline, a timeout says nothing.
    failure = F.col("failure") if "failure" in pages.columns else None
    return pages.select(
        "url",
        status.cast("int").alias("page_status"),
        fields.online_from_probe(F.lit("GET"), status, failure).alias("page_online"),
        fields.page_title(html).alias("page_title"),
        fields.page_language(html).alias("page_language"),
        *_captured(pages),
    )


def join_page(
    rows: DataFrame, pages: DataFrame, spread: Column | None = None, at: str | None = None
) -> DataFrame:
    """Page facts by URL; ``pages`` has url, status, html or is already cut down."""
    short = page_columns(pages) if "html" in pages.columns else pages
    # Rows of one URL share the join key, so they are told apart by all their columns.
    return _join_captures(rows, short, "url", F.struct(*rows.columns) if spread is None else spread, at)


def probe_columns(probes: DataFrame) -> DataFrame:
    """HEAD probe snapshot (url, status, failure) as online flag and status."""
    return probes.select(
        "url",
        F.col("status").cast("int").alias("probe_status"),
        fields.online_from_probe(F.lit("HEAD"), F.col("status"), F.col("failure")).alias("probe_online"),
    )


def with_hosts(rows: DataFrame, strict: bool = False) -> DataFrame:
    from hooktrace.functions.urls import tld

    return rows.withColumn("domain", url_host(F.col("url"), strict)).withColumn(
        "tld", tld(F.col("domain"))
    )


def _spread(spread: Column | None) -> Column:
    return F.col("url") if spread is None else spread
