"""The twenty shipped rules against brute force: on a fixture in which each fires, and in SQL on the sf0.1 events."""

import os
import re
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from threatframe import catalog
from threatframe.operators import rules
from threatframe.plans.rulesets import RULES
from threatframe.sources.security import SEC

START = datetime(2024, 1, 1)
COLUMNS = "event_id long, ts timestamp, event_type string, src_ip string, dst_ip string, dst_port int, username string, hostname string, status string, message string, win_event_id int, source string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
TEXTS = {
    "WEB_SQLI_001": "GET /p?id=1 UNION SELECT a", "WEB_TRAVERSAL_001": "GET /../x", "WEB_XSS_001": "GET /?q=<script>", "WEB_CMD_INJ_001": "GET /?q=;cat x", "MAL_POWERSHELL_001": "powershell -enc AA",
    "MAL_DOWNLOAD_EXEC_001": "curl http://a.b/x.sh", "MAL_PERSISTENCE_001": "echo > /etc/cron.d/x", "DNS_TUNNEL_001": f"query {'a' * 32}.example.com",
}


def fixture_rows():
    """Per rule and key: threshold events within the window; one window later threshold - 1; then threshold that span a microsecond more than the window."""
    rows = []
    for k, r in enumerate(RULES):
        for key in range(2):
            one = {"event_type": (r.event_types or ("other",))[0], "src_ip": f"10.{k}.0.{key}", "username": f"u{k}-{key}", "hostname": f"h{k}-{key}", "status": (r.statuses or ("allow",))[0], "message": TEXTS.get(r.rule_id, "m"), "source": "app"} | dict(r.match)
            w, t = timedelta(seconds=r.seconds), r.threshold
            at = [START + w * j / max(1, t - 1) for j in range(t)] if key == 0 else []
            at += [START + 5 * w + w * j / max(1, t) for j in range(t - 1)]
            at += [START + 9 * w, *(START + 10 * w + timedelta(microseconds=1 + j) for j in range(t - 2)), START + 10 * w + timedelta(microseconds=t)] if t > 1 else []
            rows += [one | {"ts": x, "dst_ip": f"192.168.0.{n}", "dst_port": 1000 + n} for n, x in enumerate(at)]
    return [r | {"event_id": n, "win_event_id": r.get("win_event_id")} for n, r in enumerate(rows)]


def brute(rows, r):
    groups = defaultdict(list)
    for e in rows:
        hit = all(e[c] == v for c, v in r.match.items()) and (not r.statuses or e["status"] in r.statuses) and (not r.event_types or e["event_type"] in r.event_types)
        if hit and (not r.regex or re.search(r.regex, e["message"], re.I)):
            groups[tuple(e[c] for c in r.group_by)].append(e)
    for key, es in groups.items():
        best = None
        for e in es:
            inside = [x for x in es if e["ts"] - timedelta(seconds=r.seconds) <= x["ts"] <= e["ts"]]
            n = len({x[r.distinct_field] for x in inside}) if r.metric == "distinct" else len(inside)
            best = max(best or (0,), (n, START - e["ts"], min(x["ts"] for x in inside), e["ts"]))
        if best[0] >= r.threshold:
            yield r.rule_id, r.severity, r.category, key, best[0], *best[2:]


def test_shipped_rules_equal_brute_force(spark):
    rows = fixture_rows()
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], COLUMNS)
    want = {x for r in RULES for x in brute(rows, r)}
    assert {x[0] for x in want} == {r.rule_id for r in RULES}
    got = [(x.rule_id, x.severity, x.category, tuple(x.entity), x.value, x.started, x.ended) for x in rules.evaluate(df, RULES).select("rule_id", "severity", "category", "entity", "value", "started", "ended").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def look_back(r):
    """Firing groups of a rule over sec, with DuckDB's own windows."""
    parts = [f"{c} = {v!r}" for c, v in r.match.items()]
    parts += [f"lower({c}) IN ({', '.join(map(repr, vs))})" for c, vs in (("status", r.statuses), ("event_type", r.event_types)) if vs]
    parts += ["regexp_matches(message, '{}', 'i')".format(r.regex.replace("'", "''"))] if r.regex else []
    n = f"count(DISTINCT {r.distinct_field})" if r.metric == "distinct" else "count(*)"
    return f"SELECT '{r.rule_id}' AS rule_id, {', '.join(r.group_by)}, {n} OVER (PARTITION BY {', '.join(r.group_by)} ORDER BY ts RANGE BETWEEN INTERVAL {r.seconds} SECOND PRECEDING AND CURRENT ROW) AS n FROM sec WHERE {' AND '.join(parts)} QUALIFY n >= {r.threshold}"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_shipped_rules_equal_look_back_sql(spark, sf):
    if not os.path.exists(sf):
        pytest.skip(sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    con.execute(f"CREATE TABLE sec AS SELECT *, CAST(NULL AS INT) AS win_event_id, 'app' AS source FROM ({SEC})")
    want = {r.rule_id: n for r in RULES if (n := con.sql(f"SELECT count(*) FROM (SELECT DISTINCT {', '.join(r.group_by)} FROM ({look_back(r)}))").fetchall()[0][0])}
    got = [x.rule_id for x in catalog.queries()["g01_shipped_rules"](spark, sf).collect()]
    assert {r: got.count(r) for r in got} == want
    if sf.endswith("sf0.1"):
        assert want["BRUTE_FORCE_001"] > 0
