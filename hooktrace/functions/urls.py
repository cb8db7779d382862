"""Host, TLD and registrable-domain columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: everything between "//" and the path, without user info and port;
# of a bracketed IPv6 literal only the inside is captured.
_AUTHORITY = r"(?:[^/?#]*@)?+\[?((?<=\[)[^\]/?#]+|[^/?#:\[\]]+)"
_WITH_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//" + _AUTHORITY
_SCHEME_OPTIONAL = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?+" + _AUTHORITY

# Two-label public suffixes known to the base-domain rule.
TWO_LABEL_SUFFIXES = (
    ".co.uk", ".ac.uk", ".gov.uk", ".org.uk",
    ".co.in", ".ac.in", ".gov.in",
    ".co.jp", ".ac.jp", ".go.jp",
    ".com.au", ".gov.au", ".edu.au",
    ".co.nz", ".govt.nz", ".ac.nz",
)

_BLANKS = " \t\n\r\f\v"

def _capture(text: Column, pattern: str) -> Column:
    """First capture or NULL. The text is referenced once, so a long expression is not repeated."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1))


def _host(url: Column, pattern: str) -> Column:
    return F.lower(_capture(url, pattern))


def feed_host(url: Column) -> Column:
    """Host of a feed URL; NULL when the text has no ``//`` authority part."""
    return _host(F.btrim(url, F.lit(_BLANKS)), _WITH_SCHEME)


def url_host(url: Column, strict: bool = False) -> Column:
    """Host of a URL whose scheme may be missing.

    ``strict`` keeps the older rule: text starting with ``http`` is taken as
    having a scheme, anything else gets ``http://`` put in front. That rule
    finds no host in ``httpbin.org/x`` and the host ``ftp`` in ``ftp://z.com``.
    """
    if strict:
        full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))
        return _host(full, _WITH_SCHEME)
    return _host(F.btrim(url, F.lit(_BLANKS)), _SCHEME_OPTIONAL)


def tld(domain: Column) -> Column:
    """Last label with its leading dot; NULL for a name without a dot."""
    return F.when(
        F.contains(domain, F.lit(".")),
        F.concat(F.lit("."), F.substring_index(domain, ".", -1)),
    )


def base_domain(domain: Column) -> Column:
    """Registrable domain of a lower-case host.

    The label before a known two-label suffix, else the last two labels (an IPv4
    host so gives its last two numbers). A name with fewer labels stays as it is.
    """
    last_two = F.substring_index(domain, ".", -2)
    known = [suffix.removeprefix(".") for suffix in TWO_LABEL_SUFFIXES]
    return F.when(last_two.isin(*known), F.substring_index(domain, ".", -3)).otherwise(last_two)
