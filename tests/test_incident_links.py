"""Signals of incidents and their links, against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from threatframe.operators import correlate

ENTRY = "cluster string, rule_id string, entity array<string>, event_id long, ts timestamp, src_ip string, dst_ip string, message string"


def entries(spark, rows):
    df = spark.createDataFrame([(c, "BRUTE_FORCE_001", [c], k, t, src, dst, m) for k, (c, t, src, dst, m) in enumerate(rows)], ENTRY.replace("ts timestamp", "ts long"))
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def test_signals_hold_all_indicators_feed_weight_and_geo(spark):
    text = "-" * 200 + f" evil.example.org {'ab' * 16} https://bad.example.net/x 2001:db8::1 8.8.8.50"
    rows = [("a", 0, "10.0.0.1", "8.8.8.8", text), ("a", 60, "10.0.0.1", None, ""), ("a", 130, "10.0.0.1", None, ""), ("8.8.8.9", 0, None, None, ""), ("b", 0, "10.0.0.1", "9.9.9.9", "")]
    got = {(r.cluster, r.signal, r.value): r.weight for r in correlate.signals(entries(spark, rows)).collect()}
    iocs = {"evil.example.org": 2.0, "ab" * 16: 2.0, "https://bad.example.net/x": 2.0, "bad.example.net": 2.0, "2001:db8::1": 2.0, "8.8.8.50": 4.0}
    want = {("a", "ioc", v): w for v, w in iocs.items()} | {("a", "geo", "US"): 0.5, ("a", "cadence", "65.0"): 1.0, ("8.8.8.9", "geo", "US"): 0.5}
    assert got == want | {(c, "technique", "T1110.001"): 1.5 for c in ("a", "b", "8.8.8.9")}


def mass(signals):
    return sum(w for s, _, w in signals if s != "geo") + max([w for s, _, w in signals if s == "geo"], default=0)


def common(a, b):
    def same(x, y):
        if x[0] != "cadence":
            return x[:2] == y[:2]
        lo, hi = sorted((float(x[1]), float(y[1])))
        return hi <= max(3.0, 1.25 * lo)

    return mass({x for x in a for y in b if x[0] == y[0] and same(x, y)})


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    incidents = {}
    for k in range(90):
        s = {("technique", "T%d" % rng.choice([1, 1, 1, 2, 3]), 1.5) for _ in range(rng.randint(0, 2))} | {("geo", rng.choice("UVW"), 0.5) for _ in range(rng.randint(0, 2))}
        s |= {("ioc", str(v), 4.0 if v % 5 == 0 else 2.0) for v in rng.sample(range(40), rng.randint(0, 4))}
        s |= {("cadence", str(rng.choice([0.5, 1.0, 2.4, 2.9, 3.0, 3.7, 3.75, 44.0, 45.0, 46.0, 55.0, 56.25, 57.0, 90.0])), 1.0)} if rng.random() < 0.7 else set()
        incidents[f"i{k:02d}"] = s or {("technique", "T9", 1.5)}
    want = {}
    for a, b in combinations(sorted(incidents), 2):
        shared = common(incidents[a], incidents[b])
        if shared > 0 and (sure := min(1.0, shared / max(1.0, min(mass(incidents[a]), mass(incidents[b]))))) >= 0.5:
            want[a, b] = (shared, round(sure, 4))
    rows = [(c, *x) for c, xs in incidents.items() for x in xs]
    got = correlate.linked_pairs(spark.createDataFrame(rows, "cluster string, signal string, value string, weight double")).collect()
    assert {(r.left, r.right): (r.shared, r.confidence) for r in got} == want and len(got) == len(want) > 100


def test_a_common_technique_makes_no_candidates_where_it_cannot_decide(spark):
    rows = [(f"i{k}", "technique", "T1", 1.5) for k in range(60)] + [(f"i{k}", "ioc", f"v{k}-{j}", 2.0) for k in range(60) for j in range(3)]
    assert correlate.shared_signals(spark.createDataFrame(rows, "cluster string, signal string, value string, weight double")).count() == 0
