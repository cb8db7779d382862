"""IP address and CIDR text to numbers and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: four dotted numbers from 0 to 255.
_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ip_number(ip: Column) -> Column:
    """IPv4 text to BIGINT; anything else gives NULL."""
    octets = F.split(ip, "[.]").try_cast("array<bigint>")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda total, x: total * 256 + x)
    return F.when(ip.rlike(_IPV4), number)


def cidr_prefix(cidr: Column) -> Column:
    """Prefix length of CIDR text; NULL when there is none from 0 to 32."""
    return F.try_element_at(
        F.regexp_extract_all(cidr, F.lit(r"/(3[0-2]|[12]?\d)\s*$"), F.lit(1)), F.lit(1)
    ).cast("int")


def cidr_low(cidr: Column) -> Column:
    """First address of a CIDR block (host bits are cleared)."""
    host_bits = F.lit(32) - cidr_prefix(cidr)
    start = ip_number(F.trim(F.substring_index(cidr, "/", 1)))
    network = F.call_function("shiftright", start, host_bits)
    return F.call_function("shiftleft", network, host_bits)


def cidr_high(cidr: Column) -> Column:
    """Last address of a CIDR block."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - cidr_prefix(cidr))
    return cidr_low(cidr) + size - F.lit(1)


# Fixed value: mark in front of the 32 hexadecimal digits of an IPv6 key.
IPV6_MARK = "x"


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text to 32 lower-case hexadecimal digits; anything else gives NULL.

    Reads "::", an IPv4 tail, brackets, and leaves out a zone.
    """
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def with_hex_tail(text: Column) -> Column:
        tail = F.substring_index(text, ":", -1)
        digits = F.lpad(F.lower(F.hex(ip_number(tail))), 8, "0")
        pair = F.regexp_replace(digits, "^(....)", "$1:")
        return F.when(F.contains(text, F.lit(".")), F.concat(F.left(text, F.length(text) - F.length(tail)), pair)).otherwise(text)

    def eight(sides: Column) -> Column:
        """All groups: the two sides of "::" with zeros between them."""
        return F.when(
            F.size(sides) == 2,
            _let(
                F.array(groups(sides[0]), groups(sides[1])),
                lambda g: F.when(
                    F.size(g[0]) + F.size(g[1]) < 8,
                    F.concat(g[0], F.array_repeat(F.lit("0"), 8 - F.size(g[0]) - F.size(g[1])), g[1]),
                ),
            ),
        ).when(F.size(sides) == 1, groups(sides[0]))

    def digits(full: Column) -> Column:
        good = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    text = F.regexp_replace(F.lower(F.trim(ip)), r"^\[|\]$|%.*$", "")
    full = _let(F.split(_let(text, with_hex_tail), "::"), eight)
    return F.when(F.contains(ip, F.lit(":")), _let(full, digits))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ip_key(ip: Column) -> Column:
    """Text key of an address of either family: the IPv4 number, or a mark and the IPv6 digits."""
    return F.coalesce(ip_number(ip).cast("string"), F.concat(F.lit(IPV6_MARK), ipv6_hex(ip)))


def ipv6_network(digits: Column, prefix: Column) -> Column:
    """The first ``prefix`` bits of 32 hexadecimal digits, the last digit cut to its bits."""
    whole, rest = (prefix / F.lit(4)).cast("int"), prefix % 4
    free = (F.lit(4) - rest).cast("int")
    value = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.call_function("shiftleft", F.call_function("shiftright", value, free), free)
    return F.concat(F.left(digits, whole), F.when(rest > 0, F.lower(F.hex(cut))).otherwise(""))


def cidr6_prefix(cidr: Column) -> Column:
    """Prefix length of IPv6 CIDR text; NULL when there is none from 0 to 128."""
    length = F.try_element_at(F.regexp_extract_all(cidr, F.lit(r"/([0-9]{1,3})\s*$"), F.lit(1)), F.lit(1)).cast("int")
    return F.when(length <= 128, length)
