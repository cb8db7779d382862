"""Full enrichment of a work list by snapshot tables, and the risk score on top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hooktrace.functions import fields
from hooktrace.functions.dates import as_of_column
from hooktrace.functions.ipaddr import ip_key
from hooktrace.functions.scoring import risk_score
from hooktrace.functions.urls import base_domain
from hooktrace.operators.lookups import (
    CAPTURED,
    cert_columns,
    distinct_ips,
    latest_first,
    page_columns,
    probe_columns,
    resolve_ips,
    whois_columns,
    with_hosts,
)
from hooktrace.operators.skew import balanced_left_join
from hooktrace.operators.upsert import one_per_key
from hooktrace.schemas import ENRICHED
from hooktrace.sinks.shared import staged
from hooktrace.sources.tables import conform


@dataclass(frozen=True)
class Snapshots:
    """Tables that answer what live lookups would; one left out is skipped."""

    dns: DataFrame | None = None
    city: DataFrame | None = None
    country: DataFrame | None = None
    asn: DataFrame | None = None
    rdap: DataFrame | None = None
    whois: DataFrame | None = None
    certs: DataFrame | None = None
    pages: DataFrame | None = None
    probes: DataFrame | None = None


def enrich(
    work: DataFrame,
    snapshots: Snapshots,
    as_of,
    *,
    strict_hosts: bool = False,
    guess_language: bool = True,
    tld_form: str = "as_stored",
    stage: bool = True,
) -> DataFrame:
    """Enriched, scored rows for a work list with one row per URL.

    The work list meets other tables three times only: by URL (pages and
    probes), by domain (DNS, certificate, WHOIS and the resolved address of the
    domain, put together beforehand per distinct domain) and by its own IP
    address (resolved per distinct address). Heavy domains and addresses are cut
    up by URL.

    With ``stage`` the tables that are used more than once are written to the
    shared folder: the work list, its domains with their DNS answer, and the
    resolved addresses. Without it Spark may compute them again for each use.
    """
    hold = staged if stage else lambda rows, purpose: rows
    hosted = with_hosts(work, strict_hosts).withColumn("ip", ip_key(F.col("ip_address")))
    hosted = hold(hosted, "worklist")
    domains = hold(_domains(hosted, snapshots.dns), "domains")
    addresses = hold(
        resolve_ips(
            distinct_ips(hosted.select("ip"), domains.select("ip")),
            snapshots.city,
            snapshots.country,
            snapshots.asn,
            snapshots.rdap,
        ),
        "addresses",
    )
    known = addresses.select(
        "ip", F.struct(*[c for c in addresses.columns if c != "ip"]).alias("found")
    )
    facts = _domain_facts(domains, snapshots, known.withColumnRenamed("found", "dns_address"))

    rows = _join_url_facts(hosted, snapshots)
    rows = balanced_left_join(rows, facts, "domain", F.col("url"), counted_facts=hosted)
    own = known.withColumnRenamed("found", "own_ip")
    rows = balanced_left_join(rows, own, "ip", F.col("url"), counted_facts=hosted)
    return _merged(rows, as_of, guess_language, tld_form)


def _domains(hosted: DataFrame, dns: DataFrame | None) -> DataFrame:
    """Distinct domains of the work list with their address, as text and as key."""
    domains = hosted.where(F.col("domain").isNotNull()).select("domain").distinct()
    if dns is None:
        answered = domains.withColumn("dns_ip", F.lit(None).cast("string"))
    else:
        answer = one_per_key(dns, "domain", latest_first(dns, "domain")).select(
            "domain", F.col("ip_address").alias("dns_ip")
        )
        answered = domains.join(answer, "domain", "left")
    return answered.withColumn("ip", ip_key(F.col("dns_ip")))


_WHOIS_COLUMNS = ("registrar", "creation_date", "expiry_date", "updated_date", "name_servers")
_CERT_COLUMNS = ("cert_issuer", "cert_subject", "cert_valid_from", "cert_valid_to", "cert_serial")


def _domain_facts(domains: DataFrame, snapshots: Snapshots, addresses: DataFrame) -> DataFrame:
    """All that is known by domain, one row per distinct domain of the work list."""
    facts = balanced_left_join(
        domains, addresses, "ip", F.col("domain"), counted_facts=domains
    ).drop("ip")
    if snapshots.certs is not None:
        shaped = cert_columns(snapshots.certs)
        present = [c for c in _CERT_COLUMNS if c in shaped.columns]
        certs = one_per_key(shaped, "domain", latest_first(shaped, "domain"))
        certs = certs.select("domain", *present).withColumn("ssl_enabled", F.lit("yes"))
        facts = facts.join(certs, "domain", "left").withColumn(
            "ssl_enabled", F.coalesce("ssl_enabled", F.lit("no"))
        )
    if snapshots.whois is not None:
        shaped = whois_columns(snapshots.whois)
        present = [c for c in _WHOIS_COLUMNS if c in shaped.columns]
        whois = one_per_key(shaped, "base_domain", latest_first(shaped, "base_domain"))
        facts = balanced_left_join(
            facts.withColumn("base_domain", base_domain(F.col("domain"))),
            whois.select("base_domain", *present),
            "base_domain",
            F.col("domain"),
            counted_facts=domains.select(base_domain(F.col("domain")).alias("base_domain")),
        ).drop("base_domain")
    return facts


def _join_url_facts(rows: DataFrame, snapshots: Snapshots) -> DataFrame:
    """Pages and probes by URL; both sides have one row per URL."""
    if snapshots.pages is not None:
        pages = snapshots.pages
        pages = page_columns(pages) if "html" in pages.columns else pages
        known = one_per_key(pages, "url", latest_first(pages, "url")).drop(CAPTURED)
        rows = rows.join(known, "url", "left")
    if snapshots.probes is not None:
        probes = probe_columns(snapshots.probes)
        order = [F.asc_nulls_last("probe_status"), F.asc_nulls_last("probe_online")]
        rows = rows.join(one_per_key(probes, "url", order), "url", "left")
    return rows


def _merged(rows: DataFrame, as_of, guess_language: bool, tld_form: str) -> DataFrame:
    """Put the sources together: feed value, then geo tables, then RDAP.

    Done in steps: each step's columns are plain references for the next one,
    which keeps the generated code of every projection small.
    """
    rows = _answers(rows)
    c = F.col
    step = rows.select(
        "url", "domain", "tld", "source_feed", "source_id", "own_text", "dns_ip",
        c("target").alias("target_brand"),
        c("tags").alias("threat_tags"),
        fields.threat_type(c("threat"), c("source_feed")).alias("threat_type"),
        fields.first_text(c("online"), c("probe_online"), c("page_online")).alias("online"),
        F.coalesce(fields.present_number(c("probe_status")), c("page_status")).alias(
            "http_status_code"
        ),
        fields.first_text(c("cidr_block"), c("rdap_cidr_block")).alias("cidr_block"),
        fields.first_number(c("asn"), c("geo_asn"), c("rdap_asn")).alias("asn"),
        fields.first_text(c("geo_asn_name"), c("rdap_asn_name")).alias("asn_name"),
        c("rdap_isp"),
        fields.first_text(c("country"), c("geo_country"), c("rdap_country")).alias("country"),
        "geo_country_name",
        *[c(f"geo_{n}").alias(n) for n in ("region", "city", "latitude", "longitude")],
        "ssl_enabled", *_CERT_COLUMNS, *_WHOIS_COLUMNS, "page_title",
        fields.present_text(c("page_language")).alias("page_language"),
    )
    language = c("page_language")
    if guess_language:
        language = F.coalesce(language, fields.title_language(c("page_title")))
    found = {
        "online": c("online"),
        "http_status_code": c("http_status_code"),
        "ip_address": F.coalesce(c("own_text"), c("dns_ip")),
        "isp": fields.isp_name(c("rdap_isp"), c("asn_name")),
        "country_name": fields.country_name(c("geo_country_name"), c("country")),
        "page_language": language,
        "last_seen": as_of_column(as_of),
    }
    plain = (
        "cidr_block", "asn", "asn_name", "country", "region", "city", "latitude", "longitude",
        "ssl_enabled", *_CERT_COLUMNS, *_WHOIS_COLUMNS, "page_title", "threat_type",
        "target_brand", "threat_tags", "tld",
    )
    found.update({n: c(n) for n in plain})
    # A URL without a host is stored with its source only.
    has_host = c("domain").isNotNull()
    enriched = step.select(
        F.xxhash64("url").alias("id"),
        "url",
        "domain",
        *[F.when(has_host, value).alias(column) for column, value in found.items()],
        "source_feed",
        "source_id",
        *[
            as_of_column(as_of).alias(name)
            for name in ("first_seen", "last_checked", "created_at", "updated_at")
        ],
    )
    return conform(with_score(enriched, as_of, tld_form=tld_form), ENRICHED)


def _answers(rows: DataFrame) -> DataFrame:
    """What the snapshots said, as plain columns; NULL where a snapshot was not asked."""
    c = F.col
    own_text = fields.present_text(c("ip_address"))
    # The row's own address counts if it has one, else the address of its domain.
    address = F.when(own_text.isNotNull(), c("own_ip")).otherwise(c("dns_address"))
    # RDAP is asked only where the feed gave no ASN or no CIDR block, and a HEAD
    # probe only where it gave no online flag.
    ask_rdap = (
        fields.present_number(c("asn")).isNull() | fields.present_text(c("cidr_block")).isNull()
    )
    ask_probe = fields.present_text(c("online")).isNull()

    optional = {
        "probe_status": "int", "probe_online": "string", "page_status": "int",
        "page_online": "string", "page_title": "string", "page_language": "string",
        "ssl_enabled": "string", "registrar": "string", "creation_date": "timestamp_ntz",
        "expiry_date": "timestamp_ntz", "updated_date": "timestamp_ntz",
        "name_servers": "string", **dict.fromkeys(_CERT_COLUMNS, "string"),
    }
    present = set(rows.columns)
    absent = {n: F.lit(None).cast(t) for n, t in optional.items() if n not in present}
    asked = rows.withColumns(
        {**absent, "own_text": own_text, "address": address, "ask_rdap": ask_rdap}
    )
    names = asked.schema["address"].dataType.fieldNames()
    answers = {
        n: F.when(c("ask_rdap"), c("address")[n]) if n.startswith("rdap_") else c("address")[n]
        for n in names
    }
    probes = {n: F.when(ask_probe, c(n)) for n in ("probe_status", "probe_online")}
    return asked.withColumns({**answers, **probes})


def with_score(threats: DataFrame, as_of, **options) -> DataFrame:
    """Whole-table rescore: projections only, no shuffle."""
    c = F.col
    score = risk_score(
        c("__url"), c("http_status_code"), c("online"), c("last_seen"), c("creation_date"), c("tld"),
        as_of=as_of, url_is_lower=True, **options,
    )
    return threats.withColumn("__url", F.lower("url")).withColumn("risk_score", score).drop("__url")


def rescore_batch(threats: DataFrame, batch: DataFrame, as_of, **options) -> DataFrame:
    """New scores for the URLs of a batch only."""
    urls = batch.select("url").distinct()
    return with_score(threats.join(urls, "url", "left_semi"), as_of, **options)
