"""Is an address outside the reserved ranges? IPv4 and IPv6, in native expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that are not globally reachable, and the exceptions inside them.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
]
PUBLIC_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number_v4(text: Column) -> Column:
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"), lambda n, part: n * 256 + part.cast("bigint"))


def _in_v4(number: Column, ranges: list[str]) -> Column:
    out = F.lit(False)
    for text in ranges:
        net = ipaddress.ip_network(text)
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def _external_number(number: Column) -> Column:
    return ~_in_v4(number, PRIVATE_V4) | _in_v4(number, PUBLIC_V4)


def _groups(text: Column) -> Column:
    """The hex groups of one side of ``::``; an empty side has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


_SIDE = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"


def _eight_groups(text: Column) -> Column:
    """The eight groups of an address as numbers; NULL if it is not well formed."""

    def fill(halves: Column) -> Column:
        left, right = _groups(F.get(halves, F.lit(0))), _groups(F.get(halves, F.lit(1)))
        gap = 8 - F.size(left) - F.size(right)
        short = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
        return F.when(F.size(halves) == 2, F.when(gap >= 1, short)).when(F.size(left) == 8, left)

    shape = F.regexp_like(text, F.lit(f"^{_SIDE}(?:::{_SIDE})?$"))
    return F.when(shape, F.transform(let(F.split(text, "::"), fill), lambda g: F.conv(g, 16, 10).cast("bigint")))


def _without_dots(text: Column) -> Column:
    """A dotted tail (``::ffff:1.2.3.4``) as two hex groups."""

    def join(tail: Column) -> Column:
        head = F.left(text, F.char_length(text) - F.char_length(tail))
        groups = let(_number_v4(tail), lambda n: F.lower(F.concat(
            F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(0xFFFF))))))
        return F.when(tail != "", F.concat(head, groups)).otherwise(text)

    return let(F.regexp_extract(text, rf"(?:^|:)({_V4})$", 1), join)


def _in_v6(groups: Column, ranges: list[str]) -> Column:
    out = F.lit(False)
    for text in ranges:
        net = ipaddress.ip_network(text)
        inside = F.lit(True)
        for i in range(8):
            take = min(16, max(0, net.prefixlen - 16 * i))
            if take == 0:
                break
            want = (int(net.network_address) >> (112 - 16 * i)) & 0xFFFF
            inside = inside & F.get(groups, F.lit(i)).between(want, want + (1 << (16 - take)) - 1)
        out = out | inside
    return out


def _external_v6(text: Column) -> Column:
    def judge(groups: Column) -> Column:
        mapped = _in_v6(groups, ["::ffff:0:0/96"])
        number = F.get(groups, F.lit(6)) * 65536 + F.get(groups, F.lit(7))
        return F.when(mapped, _external_number(number)).otherwise(
            ~_in_v6(groups, PRIVATE_V6) | _in_v6(groups, PUBLIC_V6))

    plain = F.regexp_replace(F.lower(text), "%[^%/]+$", "")  # without a scope id
    return let(let(let(plain, _without_dots), _eight_groups), judge)


def is_external(ip: Column) -> Column:
    """1 for a valid address outside the reserved ranges, else 0 (also for NULL and bad text)."""
    hit = F.when(F.contains(ip, F.lit(":")), _external_v6(ip)).when(
        F.regexp_like(ip, F.lit(rf"^{_V4}$")), let(_number_v4(ip), _external_number))
    return F.coalesce(hit, F.lit(False)).cast("int")
