"""IP address literals as column expressions: their numbers, and whether they are publicly routable unicast."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.text import let

# IPv4 blocks that are not publicly routable unicast, and the addresses inside them that are.
NOT_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
# The same for IPv6: special-purpose, reserved and multicast blocks.
NOT_PUBLIC_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9",
    "fe80::/10", "ff00::/8",
]
PUBLIC_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
# Blocks whose addresses carry an IPv4 address in their last 32 bits, which decides.
CARRIES_V4 = ["64:ff9b::/96"]

OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def _among(number: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return _any([number.between(int(n[0]), int(n[-1])) for n in nets])


def is_public_v4(number: Column) -> Column:
    return ~_among(number, NOT_PUBLIC_V4) | _among(number, PUBLIC_V4)


def _dotted_number(text: Column) -> Column:
    octets = lambda p: [F.get(p, F.lit(i)).cast("long") for i in range(4)]
    return let(F.split(text, r"\."), lambda p: reduce(lambda n, o: n * 256 + o, octets(p)))


def v4_number(name: Column) -> Column:
    """The number of a host in dotted, decimal or hexadecimal notation; null for any other host.

    Leading zeros change nothing; a number of any length is compared as a number, one beyond 32 bits is no address.
    """
    hexadecimal = F.regexp_extract(name, "^0x0*([0-9a-f]*)$", 1)
    digits = F.regexp_replace(name, "^0+(?=.)", "")
    sixteen = F.when(F.length(hexadecimal) <= 8, F.conv(F.when(hexadecimal == "", "0").otherwise(hexadecimal), 16, 10).try_cast("long"))
    ten = F.when(F.length(digits) <= 10, digits.try_cast("long"))
    number = (
        F.when(name.rlike(f"^{DOTTED}$"), _dotted_number(name))
        .when(name.rlike("^0x[0-9a-f]+$"), sixteen)
        .when(name.rlike(r"^\d+$"), ten)
    )
    fits = let(number, lambda n: F.when(n < 1 << 32, n))
    return F.when(F.substring(name, 1, 1).between("0", "9"), fits)


def v6_digits(name: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in lower-case text, with or without a scope; null for any other text."""
    bare = F.regexp_extract(name, r"^([0-9a-f:.]+)(?:%[^%]+)?$", 1)
    last = F.regexp_extract(bare, rf":({DOTTED})$", 1)
    half = lambda n: F.lower(F.hex(n))
    pair = let(_dotted_number(last), lambda n: F.concat_ws(":", half(F.shiftright(n, 16)), half(n.bitwiseAND(F.lit(65535)))))
    plain = F.when(last == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"[^:]*$", ""), pair))
    groups = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def digits(parts: Column) -> Column:
        well_formed = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(well_formed, F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ""))

    return let(let(F.split(plain, "::"), filled), digits)


def is_public_v6(name: Column) -> Column:
    """Whether IPv6 text is a public address, also through an IPv4 address it carries; text that is no address is not refused."""
    wide = lambda address: f"{int(address):032x}"

    def among(digits: Column, blocks: list[str]) -> Column:
        nets = [ipaddress.ip_network(b) for b in blocks]
        return _any([digits.between(wide(n[0]), wide(n[-1])) for n in nets])

    def judged(digits: Column) -> Column:
        carried = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
        own = ~among(digits, NOT_PUBLIC_V6) | among(digits, PUBLIC_V6)
        return F.when(digits.isNull(), F.lit(True)).when(among(digits, CARRIES_V4), is_public_v4(carried)).otherwise(own)

    return let(v6_digits(name), judged)
