"""Address lookups in overlapping ranges of both families, against the ipaddress module."""

import ipaddress as ip
import random

from pyspark.sql import functions as F

from threatframe.operators import indicators, joins
from threatframe.sources import reference


def test_one_row_per_event_innermost_range(spark, tmp_path):
    rng = random.Random(3)
    four, six = lambda n: ip.IPv4Address(n), lambda n: ip.IPv6Address(n)
    ranges = [(four(0), four(2**32 - 1), "all", "x"), (six(0x2000 << 112), six((0x4000 << 112) - 1), "unicast", "x")]
    points = [rng.randrange(2**24) * 256 for _ in range(30)]
    for k, p in enumerate(points):
        ranges.append((four(p), four(min(2**32 - 1, p + rng.choice([0, 255, 70_000, 2**25]))), f"v4-{k}", "x"))
        base = (0x2001 << 112) + (rng.randrange(2**20) << 90)
        ranges.append((six(base), six(base + rng.choice([0, 2**64, 2**97, 2**111])), f"v6-{k}", "x"))
    path = str(tmp_path / "ranges")
    spark.createDataFrame([(str(a), str(b), c, d) for a, b, c, d in ranges] + [("10.0.0.9", "10.0.0.1", "backwards", "x"), ("x", "::1", "bad", "x")], "first string, last string, country string, kind string").write.option("header", True).csv(path)
    ends = [e for a, b, *_ in ranges for e in (a, b)]
    asked = [str(e + d) for e in ends for d in (-1, 0, 1) if 0 <= int(e) + d < 2**e.max_prefixlen] + ["nonsense", None, "::", "fe80::1"]
    events = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id long, address string")
    got = {r.id: r for r in joins.geo_lookup(events, reference.load_ranges(spark, path), "address").collect()}
    assert len(got) == len(asked) == joins.geo_lookup(events, reference.load_ranges(spark, path), "address").count()
    for i, a in enumerate(asked):
        try:
            n = ip.ip_address(a)
        except ValueError:
            assert got[i].country is None and got[i].kind is None
            continue
        hold = [r for r in ranges if r[0].version == n.version and r[0] <= n <= r[1]]
        want = max(hold, key=lambda r: (int(r[0]), -int(r[1]), r[2]), default=None)
        assert got[i].country == (want[2] if want else None), a


def test_names_end_where_any_script_ends(spark):
    texts = ["see évil.com now", "evilé.com", "пример.com or good.com", "naïve.org", "ok.example.net"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(indicators.iocs(F.col("t")), lambda i: i.value).alias("v")).collect()
    assert [r.v for r in rows] == [[], [], ["good.com"], [], ["ok.example.net"]]
