"""Address literals against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from nearby_engine.functions import addresses
from nearby_engine.functions.urls import is_public_url


def _unicast(address):
    return address.is_global and not (address.is_reserved or address.is_multicast)


def _public(text):
    """Whether IPv6 text is public; None for text that is no address."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if address in ipaddress.ip_network("64:ff9b::/96"):
        return _unicast(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF))
    return _unicast(address) and (address.sixtofour is None or _unicast(address.sixtofour))


def _texts():
    dice = random.Random(4)
    odd = [
        "::", "::1", "1::", ":", ":::", "::1::", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7",
        "1::2:3:4:5:6:7:8", "12345::", "g::", "::1.2.3.4", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:192.0.0.9", "64:ff9b::8.8.8.8", "64:ff9b::7f00:1",
        "64:ff9b:1::1", "::ffff:1.2.3", "::ffff:01.2.3.4", "1.2.3.4::", "fe80::1%eth0", "fe80::1%", "2606:4700::1111%a%b", "2606:4700::1111%1", "2002:808:808::1",
        "fec0::1", "2001:db8::1", "2001:3::1", "2001:1::1", "2001:1::3", "2001:20::9", "2001:2::1", "ff02::1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
        "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:5", "abcd:ef01:2345:6789:abcd:ef01:2345:6789", "::ffff:0:8.8.8.8", "100::1", "100:0:0:1::",
    ]
    for block in [*addresses.NOT_PUBLIC_V6, *addresses.PUBLIC_V6, *addresses.CARRIES_V4]:
        net = ipaddress.ip_network(block)
        for number in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= number < 1 << 128:
                odd.append(str(ipaddress.IPv6Address(number)))
    return odd + [str(ipaddress.IPv6Address(dice.getrandbits(128) >> dice.choice([0, 0, 3, 16, 90]))) for _ in range(300)]


def test_ipv6_text_is_judged_as_the_library_does(spark):
    texts = sorted({t for t in _texts() if ":" in t})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.d, r.ok) for r in df.select("t", addresses.v6_digits(F.col("t")).alias("d"), addresses.is_public_v6(F.col("t")).alias("ok")).collect()}
    for text in texts:
        wanted = _public(text)
        assert (got[text][0] is None) == (wanted is None), text
        assert got[text][1] == (True if wanted is None else wanted), text
        if wanted is not None:
            assert int(got[text][0], 16) == int(ipaddress.IPv6Address(text.split("%")[0])), text


def test_ipv4_numbers_are_judged_as_the_library_does(spark):
    dice = random.Random(5)
    numbers = {0, (1 << 32) - 1, *(dice.getrandbits(32) for _ in range(300))}
    for block in [*addresses.NOT_PUBLIC_V4, *addresses.PUBLIC_V4]:
        net = ipaddress.ip_network(block)
        numbers |= {n for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1) if 0 <= n < 1 << 32}
    forms = [lambda n: str(ipaddress.IPv4Address(n)), str, hex, lambda n: f"0x000000000{n:x}", lambda n: f"0000000000000{n}"]
    rows = [(form(n), n) for n in sorted(numbers) for form in forms]
    df = spark.createDataFrame(rows, "t string, n long")
    for r in df.select("t", "n", addresses.v4_number(F.col("t")).alias("got"), is_public_url(F.concat(F.lit("http://"), "t", F.lit("/"))).alias("ok")).collect():
        assert r.got == r.n and r.ok == _unicast(ipaddress.IPv4Address(r.n)), r
    others = ["4294967296", "0x100000000", "99999999999999999999", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1a", "0xg", "example.org", ""]
    df = spark.createDataFrame([(t,) for t in others], "t string")
    assert df.filter(addresses.v4_number(F.col("t")).isNotNull()).count() == 0


def test_no_python_in_the_plan(spark):
    plan = spark.createDataFrame([("http://x",)], "u string").select(is_public_url(F.col("u")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
