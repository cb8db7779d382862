"""Additive 0-100 risk score as column expressions.

The day limits are compared as ``date >= as_of - n days``: no division per
row, the bound folds to a literal, and a filter on it reaches the Parquet
footer statistics.

``calendar=True`` counts whole elapsed days (a date 3.9 days back is "3 days")
and gives an unreadable creation date the points of a missing one; the default
compares fractional days and gives it the lowest points.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F

from hooktrace.functions.dates import days_before, utc_timestamp

# Fixed values of the scoring rules.
LIVE_CODES = (200, 301, 302, 307, 308)
GUARDED_CODES = (401, 403, 405, 429, 451)
GONE_CODES = (404, 410)
RECENCY_POINTS = ((3, 25), (7, 20), (14, 15), (30, 10))
AGE_POINTS = ((7, 20), (30, 15), (90, 10))
HIGH_RISK_TLDS = ("zip", "mov", "top", "cc", "icu", "xyz", "click", "info")
COMMON_TLDS = ("com", "net", "org")
HOSTING_PLATFORMS = (
    ".vercel.app", ".web.app", ".github.io", ".cprapid.com",
    ".pages.dev", ".netlify.app", ".render.com", ".fly.dev",
)
KEYWORDS = (
    "login", "verify", "secure", "update", "invoice", "mfa",
    "password", "wallet", "bank", "microsoft", "office365", "att",
)
LEVELS = ((85, "Critical"), (70, "High"), (50, "Medium"))

AsOf = str | datetime | Column


def _mentions(url: Column, words: tuple[str, ...], is_lower: bool) -> Column:
    """Any of the words, in either case: plain substring tests, far faster than one pattern."""
    text = url if is_lower else F.lower(url)
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def liveness_score(http_status_code: Column, online: Column) -> Column:
    code = http_status_code
    return (
        F.when(code.isin(*LIVE_CODES), 35)
        .when(code.isin(*GUARDED_CODES), 28)
        .when((code >= 500) & (code < 600), 20)
        .when(code.isin(*GONE_CODES), 12)
        .when(code.isNotNull(), 10)
        .when(online == "yes", 20)
        .otherwise(10)
    )


def _points_by_age(moment, as_of, ladder, missing, oldest, calendar, text, unreadable) -> Column:
    parsed = utc_timestamp(moment) if text else moment
    absent = moment.isNull()
    if text and calendar:
        absent = absent | (moment == "")
    points = F.when(absent, missing)
    for days, value in ladder:
        recent = (
            parsed > days_before(as_of, days + 1) if calendar else parsed >= days_before(as_of, days)
        )
        points = points.when(recent, value)
    if text and calendar:
        points = points.when(parsed.isNull(), unreadable)
    return points.otherwise(oldest)


def recency_score(
    last_seen: Column, as_of: AsOf, *, calendar: bool = False, text: bool = False
) -> Column:
    """Points for how recently the URL was seen; ``text`` marks a text column."""
    return _points_by_age(last_seen, as_of, RECENCY_POINTS, 5, 5, calendar, text, unreadable=5)


def domain_age_score(
    creation_date: Column, as_of: AsOf, *, calendar: bool = False, text: bool = False
) -> Column:
    """Points for how young the domain is; ``text`` marks a text column."""
    return _points_by_age(creation_date, as_of, AGE_POINTS, 8, 5, calendar, text, unreadable=8)


def tld_platform_score(
    url: Column, tld: Column, *, tld_form: str = "as_stored", url_is_lower: bool = False
) -> Column:
    """Points for the TLD and for free hosting platforms.

    The pipeline stores a TLD with its dot while the lists have none, so with
    ``as_stored`` such rows get the points of an unlisted TLD. ``bare`` drops
    the dot first and gives the points the lists intend.
    """
    if tld_form not in ("as_stored", "bare"):
        raise ValueError(f"tld_form must be 'as_stored' or 'bare', not {tld_form!r}")
    label = F.lower(tld)
    if tld_form == "bare":
        label = F.ltrim(label, F.lit("."))
    by_tld = F.when(label.isin(*COMMON_TLDS), 5).otherwise(7)
    by_platform = F.when(_mentions(url, HOSTING_PLATFORMS, url_is_lower), 3).otherwise(0)
    return F.when(label.isin(*HIGH_RISK_TLDS), 10).otherwise(by_tld + by_platform)


def keyword_score(url: Column, *, url_is_lower: bool = False) -> Column:
    return F.when(_mentions(url, KEYWORDS, url_is_lower), 10).otherwise(0)


def risk_level(score: Column) -> Column:
    level = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for floor, name in LEVELS[1:]:
        level = level.when(score >= floor, name)
    return level.otherwise("Low")


def _parts(url, http_status_code, online, last_seen, creation_date, tld, as_of, options):
    dates = {k: options[k] for k in ("calendar", "text")}
    lower = {"url_is_lower": options["url_is_lower"]}
    return {
        "liveness": liveness_score(http_status_code, online),
        "recency": recency_score(last_seen, as_of, **dates),
        "domain_age": domain_age_score(creation_date, as_of, **dates),
        "tld_platform": tld_platform_score(url, tld, tld_form=options["tld_form"], **lower),
        "keywords": keyword_score(url, **lower),
    }


def _total(parts: dict[str, Column]) -> Column:
    summed = reduce(lambda a, b: a + b, parts.values())
    return F.greatest(F.lit(0), F.least(F.lit(100), summed))


def risk_score(
    url: Column,
    http_status_code: Column,
    online: Column,
    last_seen: Column,
    creation_date: Column,
    tld: Column,
    *,
    as_of: AsOf,
    tld_form: str = "as_stored",
    calendar: bool = False,
    text: bool = False,
    url_is_lower: bool = False,
) -> Column:
    """Total score, 0 to 100.

    Over a whole table put ``lower(url)`` in a column first and say ``url_is_lower``:
    twenty substring tests then share one lowered text.
    """
    options = {
        "tld_form": tld_form, "calendar": calendar, "text": text, "url_is_lower": url_is_lower
    }
    return _total(
        _parts(url, http_status_code, online, last_seen, creation_date, tld, as_of, options)
    )


def risk_breakdown(
    url: Column,
    http_status_code: Column,
    online: Column,
    last_seen: Column,
    creation_date: Column,
    tld: Column,
    *,
    as_of: AsOf,
    tld_form: str = "as_stored",
    calendar: bool = False,
    text: bool = False,
    url_is_lower: bool = False,
) -> Column:
    """Struct of the five parts, their total and the level."""
    options = {
        "tld_form": tld_form, "calendar": calendar, "text": text, "url_is_lower": url_is_lower
    }
    parts = _parts(url, http_status_code, online, last_seen, creation_date, tld, as_of, options)
    total = _total(parts)
    return F.struct(
        *[column.alias(name) for name, column in parts.items()],
        total.alias("total"),
        risk_level(total).alias("risk_level"),
    )
