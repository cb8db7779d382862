"""Cleaning and inference columns used when feeds and snapshots are merged.

"Present" follows the rule of the original data producer: an empty text and
the number 0 count as missing, exactly as NULL does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed patterns for page metadata.
_TITLE_TAG = r"(?is)<title[^>]*>.*?</title>"
_TITLE_TEXT = r"(?is)<title[^>]*>(.*?)</title>"
_HTML_LANG = r"""(?i)<html[^>]+lang=["']([^"']+)["']"""
_TITLE_CHARS = 200
_BLANKS = " \t\n\r\f\v"

# Words in a page title that give its language; the first hit wins.
TITLE_WORDS = {
    "en": ("sign", "login", "account", "verify", "update", "security"),
    "es": ("iniciar", "cuenta", "verificar", "actualizar"),
    "fr": ("connexion", "compte", "vérifier", "mettre"),
    "de": ("anmelden", "konto", "überprüfen", "aktualisieren"),
    "it": ("accesso", "conto", "verificare", "aggiornare"),
}

# Country names by ISO code.
COUNTRY_NAMES = {
    "US": "United States", "CN": "China", "RU": "Russia", "DE": "Germany",
    "GB": "United Kingdom", "FR": "France", "JP": "Japan", "KR": "South Korea",
    "IN": "India", "BR": "Brazil", "CA": "Canada", "AU": "Australia",
    "NL": "Netherlands", "IT": "Italy", "ES": "Spain", "SE": "Sweden",
    "PL": "Poland", "TR": "Turkey", "MX": "Mexico", "ID": "Indonesia",
    "TH": "Thailand", "VN": "Vietnam", "PH": "Philippines", "MY": "Malaysia",
    "SG": "Singapore", "HK": "Hong Kong", "TW": "Taiwan",
}


def present_text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def present_number(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def first_text(*values: Column) -> Column:
    """First non-empty text; the last value is taken as it is."""
    return F.coalesce(*[present_text(v) for v in values[:-1]], values[-1])


def first_number(*values: Column) -> Column:
    """First number that is neither NULL nor 0; the last value is taken as it is."""
    return F.coalesce(*[present_number(v) for v in values[:-1]], values[-1])


def yes_no(value: Column) -> Column:
    """Flag text from JSON booleans or ``yes``/``no``; anything else is NULL."""
    return F.when(value.isin("true", "yes"), "yes").when(value.isin("false", "no"), "no")


def safe_int(value: Column) -> Column:
    """Whole number from text, NULL when it is not one."""
    return F.btrim(value, F.lit(_BLANKS)).try_cast("bigint")


def asn_number(announcing_network: Column) -> Column:
    """ASN from text such as ``AS13335``."""
    return safe_int(F.replace(announcing_network, F.lit("AS"), F.lit("")))


def asn_split(description: Column) -> tuple[Column, Column]:
    """``AS13335 Cloudflare, Inc.`` into number and name."""
    pattern = r"^AS(\d+)\s*(.*)$"
    number = F.regexp_extract(description, pattern, 1).try_cast("bigint")
    name = present_text(F.regexp_extract(description, pattern, 2))
    return number, name


def joined_list(values: Column) -> Column:
    """List to comma text; an empty list gives an empty text, NULL stays NULL."""
    return F.array_join(values, ",")


def split_list(text: Column) -> Column:
    """Comma text back to a list; an empty text gives an empty list."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def first_item(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def page_title(html: Column) -> Column:
    """Trimmed text of the first title element, 200 characters at most; NULL without one."""
    inner = F.regexp_extract(F.regexp_substr(html, F.lit(_TITLE_TAG)), _TITLE_TEXT, 1)
    return F.substring(F.btrim(inner, F.lit(_BLANKS)), 1, _TITLE_CHARS)


def page_language(html: Column) -> Column:
    """``lang`` attribute of the html element."""
    return present_text(F.regexp_extract(html, _HTML_LANG, 1))


def title_language(title: Column) -> Column:
    """Language guessed from well-known words in a page title."""
    lowered = F.lower(title)
    guess = F
    for language, words in TITLE_WORDS.items():
        hit = reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
        guess = guess.when(hit, language)
    return guess


def online_from_probe(method: Column, status: Column, failure: Column | None = None) -> Column:
    """Online flag of a probe.

    A GET counts as online below status 400; a HEAD counts as online on any
    answer. Without an answer the failure decides: ``connection`` and ``tls``
    give ``no``, everything else (``timeout``, unnamed) gives ``unknown``.
    """
    get_flag = F.when(status < 400, "yes").otherwise("no")
    no_answer = F.lit("unknown")
    if failure is not None:
        no_answer = F.when(failure.isin("connection", "tls"), "no").otherwise("unknown")
    return (
        F.when(status.isNull(), no_answer)
        .when(F.upper(method) == "HEAD", "yes")
        .otherwise(get_flag)
    )


def threat_type(stated: Column, source_feed: Column) -> Column:
    """Stated threat type, else the usual one of the feed."""
    usual = F.when(source_feed.isin("phishtank", "openphish"), "phishing").when(
        source_feed == "urlhaus", "malware"
    )
    return F.coalesce(present_text(stated), usual, stated)


def country_name(name: Column, code: Column) -> Column:
    """Stated name, else the name of the code, else the code itself."""
    known = F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair])
    code = present_text(code)
    return F.coalesce(present_text(name), F.try_element_at(known, code), code, name)


def isp_name(isp: Column, asn_name: Column) -> Column:
    """Stated ISP, else the AS name."""
    return F.coalesce(present_text(isp), present_text(asn_name), isp)


def cert_issuer(issuer: Column) -> Column:
    """Organization, else common name of a name-to-text map, else an empty text."""
    return F.coalesce(
        F.try_element_at(issuer, F.lit("organizationName")),
        F.try_element_at(issuer, F.lit("commonName")),
        F.lit(""),
    )


def cert_subject(subject: Column) -> Column:
    return F.coalesce(F.try_element_at(subject, F.lit("commonName")), F.lit(""))


def percentage(part: Column, total: Column) -> Column:
    """``100 * part / total`` with an empty total counted as one."""
    return F.lit(100.0) * part / F.greatest(total, F.lit(1))
