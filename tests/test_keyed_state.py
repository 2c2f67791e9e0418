"""Keyed tables and what is kept up to date with them equal the batch operators on all rows so far."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedLog, KeyedTable
from threatframe.operators import alerts, correlate, indicators, joins, reports, rules, scoring
from threatframe.operators.rules import Rule
from threatframe.streaming.refresh import Refresh

SCHEMA = "k string, v long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_write_only_their_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), None, 8)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    t.replace(0, make(*((f"k{i}", i) for i in range(40))))
    assert t.replace(1, make(("k3", 33), ("k3", 34))) == t.replace(1, make(("k3", 33), ("k3", 34)))
    written = glob.glob(str(tmp_path / "t/data/change=1/bucket=*"))
    assert len(written) == 1  # of eight buckets
    t.replace(2, make(("new", 1)), keys("k4", "absent"))
    assert rows(t.read(0)) == sorted((f"k{i}", i) for i in range(40))
    want = sorted([(f"k{i}", i) for i in range(40) if i not in (3, 4)] + [("k3", 33), ("k3", 34), ("new", 1)])
    assert rows(t.read(2)) == rows(t.read(9)) == want
    assert rows(t.of(keys("k3", "k4", "k5"), 2)) == [("k3", 33), ("k3", 34), ("k5", 5)]
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), None, 8)  # another session finds the same
    assert rows(again.read(2)) == want
    t.replace(3, make(*((f"k{i}", 0) for i in range(40))))
    assert 0 in t.vacuum(3) and rows(t.read(3)) == sorted([(f"k{i}", 0) for i in range(40)] + [("new", 1)])


def test_table_of_no_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",))
    none = spark.createDataFrame([], SCHEMA)
    assert t.read(0).count() == 0 and t.replace(0, none) == [] and t.read(0).count() == 0
    log = KeyedLog(spark, str(tmp_path / "l"), SCHEMA, ("k",))
    log.append(0, none)
    assert log.of(spark.createDataFrame([("a",)], "k string"), 0).count() == 0


def test_upsert_keeps_the_newest(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "value string, seen_at long, note string", ("value",), None, 4)
    make = lambda *r: spark.createDataFrame(list(r), "value string, seen_at long, note string")
    indicators.upsert_into(t, 0, make(("a", 5, "x"), ("b", 1, "y")))
    indicators.upsert_into(t, 1, make(("a", 3, "old"), ("b", 2, "z"), ("c", 1, "n")))
    assert rows(t.read(1)) == [("a", 5, "x"), ("b", 2, "z"), ("c", 1, "n")]


def test_a_job_is_folded_once(spark, tmp_path):
    rng = random.Random(1)
    w = [(j, "ip", f"e{rng.randrange(6)}", "events", float(rng.randrange(100))) for j in range(30)]
    df = spark.createDataFrame(w, "job long, entity_type string, entity string, attribute string, value double")
    base = reports.Baselines(spark, str(tmp_path), 4)
    base.fold(0, df.filter("job < 20"))
    assert sorted(r.job for r in base.fold(1, df.filter("job >= 10")).collect()) == list(range(20, 30))
    assert base.fold(2, df).count() == 0
    short = lambda d: sorted((r.entity, r.n, round(r.mean, 9), round(r.m2, 6)) for r in d.collect())
    assert short(base.read(2)) == short(reports.baseline(df))


RULES = [
    Rule("FAILS", "Failures", "Brute Force", "HIGH", {"event_type": "auth_failure"}, threshold=3, window="10m", then_success=True),
    Rule("PORTS", "Ports", "Port Scanning", "MEDIUM", {"event_type": "firewall_event"}, metric="distinct", distinct_field="dst_port", threshold=3, window="5m", group_by=("src_ip", "username")),
]
ALERTS = [alerts.AlertRule("A_DET", "detection", min_risk=20), alerts.AlertRule("A_INC", "incident", min_risk=30), alerts.AlertRule("A_CRIT", "incident", min_risk=1, min_criticality="CRITICAL"), alerts.AlertRule("A_IOC", "ioc", min_confidence=0.5)]
EVENT = "event_id long, ts timestamp, event_type string, src_ip string, dst_ip string, dst_port int, username string, hostname string, status string, risk int, message string"


def at_random(rng, n, first):
    start = dt.datetime(2024, 1, 1)
    for i in range(n):
        ts = None if rng.random() < 0.02 else start + dt.timedelta(seconds=rng.randrange(3 * 3600))
        kind = rng.choice(["auth_failure", "auth_failure", "auth_success", "firewall_event", "http_request"])
        user = rng.choice(["u1", "u2", "u3", "u4", None])
        yield first + i, ts, kind, f"10.0.0.{rng.randrange(7)}", f"192.168.0.{rng.randrange(4)}", rng.choice([22, 80, 443, 3306, 5555]), user, rng.choice(["h1", "H1", ""]), "deny", rng.randrange(100), f"see {rng.randrange(3)}.1.1.9"


def batch_form(spark, events):
    found = scoring.score_detections(rules.evaluate(events, RULES))
    members = correlate.cluster(found)
    inc = correlate.incidents(members)
    entries = correlate.entries(members, rules.window_events(members, events, RULES))
    touched = joins.incident_assets(entries, reports.assets(events))
    seen = alerts.found_indicators(events, joins.feed_table(spark))
    return {"detections": found, "incidents": inc, "assets": reports.assets(events), "indicators": seen, "alerts": alerts.candidates(ALERTS, found, inc, seen, touched)}


@pytest.mark.parametrize("seed", [1])
def test_refresh_equals_batch_operators(spark, tmp_path, seed):
    """Events in no order, late ones, ones without a time, a batch that is applied twice, and logins that move a bridge."""
    rng = random.Random(seed)
    data = [list(at_random(rng, n, first)) for n, first in ((60, 0), (40, 100), (25, 200))]
    day = dt.datetime(2024, 2, 1)
    fail = lambda i, m: (i, day + dt.timedelta(minutes=m), "auth_failure", "10.9.0.1", "192.168.0.1", 22, "u9", "h9", "deny", 10, "x")
    login = lambda i, m, who: (i, day + dt.timedelta(minutes=m), "auth_success", "10.9.0.1", "192.168.0.1", 22, who, "h9", "allow", 10, "x")
    data[0] += [fail(900, 0), fail(901, 1), fail(902, 2), login(903, 60, "10.0.0.1")]  # bridged to the others' component
    data[1] += [login(904, 30, "elsewhere")]  # an earlier login: the bridge moves
    frames = [spark.createDataFrame(d, EVENT) for d in data]
    state = Refresh(spark, str(tmp_path), RULES, ALERTS, joins.feed_table(spark), buckets=4)
    for number, k in enumerate((0, 1, 2)):
        state.apply(frames[k], number)
        if k == 1:
            bridge = [r.followed_by for r in state.detections(number).collect() if r.entity == ["10.9.0.1"]]
            assert bridge == ["elsewhere"]
            assert [r.cluster for r in state.incidents(number).collect() if "10.9.0.1" in r.cluster] == ["10.9.0.1"]
    state.apply(frames[2], 2)
    every = frames[0].union(frames[1]).union(frames[2])
    for name, want in batch_form(spark, every).items():
        got = getattr(state, name)(2)
        cols = [c for c in got.columns if c in want.columns]
        a, b = (sorted(map(str, d.select(*cols).collect())) for d in (got, want))
        assert a == b and a, name
