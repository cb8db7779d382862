"""Filters of the threat table, built as one boolean column.

Time filters compare the stored column with a folded literal, so they reach
the Parquet scan as pushed filters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions.dates import as_of_column, cert_timestamp, days_before

TEXT_COLUMNS = ("url", "domain", "ip_address")
SEARCH_ROWS = 10
SEARCH_FIELDS = {"url": "url", "domain": "domain", "ip": "ip_address"}


@dataclass(frozen=True)
class ThreatFilter:
    """Optional conditions; the ones that are set must all hold."""

    text_search: str | None = None
    source_feeds: Sequence[str] = ()
    threat_types: Sequence[str] = ()
    target_brands: Sequence[str] = ()
    countries: Sequence[str] = ()
    online_status: str | None = None
    date_from: date | str | None = None
    date_to: date | str | None = None
    ssl_expiring_soon: bool = False
    domain_age_buckets: Sequence[str] = field(default=())
    unknown_includes_null: bool = False
    cert_dates_as_iso: bool = False

    def condition(self, as_of: str | datetime | Column | None = None) -> Column:
        """All set conditions as one column; ``as_of`` is needed by the day-based ones."""
        parts: list[Column] = []
        if self.text_search:
            parts.append(text_matches(self.text_search))
        for column, allowed in (
            ("source_feed", self.source_feeds),
            ("threat_type", self.threat_types),
            ("target_brand", self.target_brands),
            ("country", self.countries),
        ):
            if allowed:
                parts.append(F.col(column).isin(*allowed))
        if self.online_status and self.online_status != "All":
            parts.append(online_is(self.online_status, self.unknown_includes_null))
        if self.date_from or self.date_to:
            parts.append(first_seen_between(self.date_from, self.date_to))
        if self.ssl_expiring_soon:
            parts.append(cert_expires_soon(_given(as_of), self.cert_dates_as_iso))
        if self.domain_age_buckets:
            parts.append(domain_age_in(self.domain_age_buckets, _given(as_of)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, threats: DataFrame, as_of=None) -> DataFrame:
        return threats.where(self.condition(as_of))


def _given(as_of):
    if as_of is None:
        raise ValueError("this filter compares with a point in time: pass as_of")
    return as_of


def _pattern(text: str) -> str:
    # "%" and "_" act as wildcards; only the escape character itself is neutralised.
    return "%" + text.replace("\\", "\\\\") + "%"


def text_matches(text: str, columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    """Case-insensitive substring in any of the columns."""
    pattern = _pattern(text)
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def online_is(choice: str, unknown_includes_null: bool = False) -> Column:
    """Online flag equals the choice; NULL is not "unknown" unless asked for."""
    flag = choice.lower()
    same = F.col("online") == flag
    if flag == "unknown" and unknown_includes_null:
        return same | F.col("online").isNull()
    return same


def first_seen_between(start: date | str | None, end: date | str | None) -> Column:
    """First seen on or after the start day and on or before the end day."""
    parts = []
    if start:
        parts.append(F.col("first_seen") >= as_of_column(_midnight(start)))
    if end:
        parts.append(F.col("first_seen") < as_of_column(_midnight(end) + timedelta(days=1)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _midnight(day: date | str) -> datetime:
    if isinstance(day, str):
        day = date.fromisoformat(day)
    return datetime(day.year, day.month, day.day)


def cert_expires_soon(as_of, dates_as_iso: bool = False, days: int = 30) -> Column:
    """Certificate runs out within the next days (0 to 30).

    The text form of certificate dates is read by default. ``dates_as_iso``
    reads ISO text only, under which certificate-form dates never match.
    """
    text = F.col("cert_valid_to")
    expiry = text.try_cast("timestamp_ntz") if dates_as_iso else cert_timestamp(text)
    return expiry.between(as_of_column(as_of), as_of_column(as_of) + F.expr(f"INTERVAL '{days}' DAY"))


def domain_age_in(buckets: Sequence[str], as_of) -> Column:
    """Domain age in any of ``new`` (30 days at most), ``medium`` (31 to 180), ``old`` (over 180).

    Ages are fractional, so one strictly between 30 and 31 days is in no bucket.
    """
    created = F.col("creation_date")
    known: dict[str, Callable[[], Column]] = {
        "new": lambda: created >= days_before(as_of, 30),
        "medium": lambda: created.between(days_before(as_of, 180), days_before(as_of, 31)),
        "old": lambda: created < days_before(as_of, 180),
    }
    chosen = [make() for name, make in known.items() if name in buckets]
    return reduce(lambda a, b: a | b, chosen) if chosen else F.lit(True)


def search(threats: DataFrame, kind: str, term: str) -> DataFrame:
    """Lookup by ``url``, ``domain`` or ``ip`` substring (first rows by id), or by exact ``id``."""
    if kind == "id":
        return threats.where(F.col("id") == int(term))
    matched = threats.where(text_matches(term, [SEARCH_FIELDS[kind]]))
    return matched.orderBy("id").limit(SEARCH_ROWS)


def row_details(threats: DataFrame, row_id: int | Column, as_of) -> DataFrame:
    """One threat with its domain age and days to certificate expiry."""
    from hooktrace.functions.dates import cert_days_left, domain_age_days

    return (
        threats.where(F.col("id") == row_id)
        .withColumn("domain_age_days", domain_age_days(F.col("creation_date"), as_of))
        .withColumn("cert_days_to_expiry", cert_days_left(F.col("cert_valid_to"), as_of))
    )


def live_phishing(threats: DataFrame, rows: int = 20) -> DataFrame:
    """Phishing URLs still online, newest first."""
    return (
        threats.where((F.col("online") == "yes") & (F.col("threat_type") == "phishing"))
        .orderBy(F.desc("first_seen"), F.asc("id"))
        .limit(rows)
    )


def with_valid_tls(threats: DataFrame) -> DataFrame:
    """URLs served over TLS, by the stored certificate expiry."""
    return threats.where(F.col("ssl_enabled") == "yes").orderBy(
        F.asc_nulls_first("cert_valid_to"), F.asc("id")
    )
