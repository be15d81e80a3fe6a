"""Places of addresses of both families against plain Python."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import geo

RANGE = "first_ip string, last_ip string, country_code string, country_name string, continent_name string"


def spelled(rng, address):
    """One of the texts of an address."""
    return rng.choice([address.compressed, address.exploded, address.compressed.upper(), address.exploded.upper()])


def brute(address, ranges):
    """Country of the innermost range: the latest start, then the earliest end."""
    held = [(a, -b, c) for f, a, b, c in ranges if f == address.version and a <= int(address) <= b]
    return max(held)[2] if held else "XX"


@pytest.mark.parametrize("seed", [1, 2])
def test_lookup_over_blocks_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges, ips = [], {}
    for k in range(120):
        base = (0x20010DB8 + rng.randrange(3)) << 96
        start = base + (rng.randrange(4) << 80) + (rng.randrange(3) << 64) + rng.randrange(1 << rng.choice([4, 64]))
        ranges.append((6, start, start + rng.randrange(1 << rng.choice([1, 5, 60, 64, 66, 80, 90])), f"S{k}"))
        start = (11 << 24) + (rng.randrange(3) << 16) + rng.randrange(1 << 16)
        ranges.append((4, start, min(start + rng.randrange(1 << rng.choice([1, 4, 9, 17, 22])), 2 ** 32 - 1), f"F{k}"))
    ranges += [(6, 1 << 125, (1 << 126) - 1, "WIDE"), (6, 0, 1, "ZERO"), (6, (1 << 128) - 5, (1 << 128) - 1, "END"), (4, 0, 255, "F-0"), (4, (1 << 32) - 2, (1 << 32) - 1, "F-END")]
    for f, a, b, _ in ranges:
        kind = ipaddress.IPv6Address if f == 6 else ipaddress.IPv4Address
        for n in {a, b, max(0, a - 1), min(b + 1, 2 ** (128 if f == 6 else 32) - 1), rng.randint(a, b)}:
            address = kind(n)
            ips[spelled(rng, address) if f == 6 else str(address)] = address
            if f == 4:
                ips[f"::ffff:{address}"] = address
    kinds = {4: ipaddress.IPv4Address, 6: ipaddress.IPv6Address}
    table = spark.createDataFrame([(str(kinds[f](a)), str(kinds[f](b)), c, c, c) for f, a, b, c in ranges], RANGE)
    asked = spark.createDataFrame([(ip,) for ip in [*ips, *ips]], "ip string")
    got = {r["ip"]: r["country_code"] for r in geo.geo_lookup(asked, table).collect()}
    private = ("127.", "10.", "172.16.", "192.168.", "::1", "fe80:", "fc00:")
    assert got == {ip: "LAN" if ip.startswith(private) else brute(address, ranges) for ip, address in ips.items()}


def test_text_that_is_no_address_has_no_key(spark):
    bad = ["", "x", ":", ":::", "1:2", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", "::g", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1.2.3", "1.2.3.4.5"]
    good = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "ABCD:0:0::1"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "ip string").select("ip", geo.ip_key(F.col("ip")).alias("k")).collect()
    assert {r["ip"] for r in rows if r["k"] is not None} == set(good)
    assert geo.geo_lookup(spark.createDataFrame([("x",), (None,)], "ip string"), spark.createDataFrame([], RANGE)).collect()[0]["country_code"] == "XX"
