"""Stored models, isolation-forest scores and what is derived from them, and actor narratives, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_operators import events
from threatframe import catalog
from threatframe.operators import alerts, anomaly, correlate, joins, rules, scoring
from threatframe.queries import detection
from threatframe.sources.security import security_events


def plain_scores(rows, forest):
    """2 ** -(mean path / normal path), walking every tree for every row."""
    out = {}
    for r in rows:
        x, total = [r[f] for f in anomaly.FEATURES], 0.0
        for t in forest:
            at = 0
            while t[at][0] >= 0:
                at = int(t[at][2] if x[int(t[at][0])] <= t[at][1] else t[at][3])
            total += t[at][4]
        out[r.event_id] = 2 ** (-total / len(forest) / anomaly._normal(anomaly.SAMPLE))
    return out


def test_forest_scores_equal_a_walk_of_every_tree(spark, sf, tmp_path):
    e = security_events(spark, sf)
    model = anomaly.fit_model(e)
    assert len(model.forest) == anomaly.TREES
    vectors = anomaly.vectors(e, model.codes).collect()
    raw = plain_scores(vectors, model.forest)
    low, high = min(raw.values()), max(raw.values())
    want = {k: (v - low) / (high - low) for k, v in raw.items()}
    model.save(spark, str(tmp_path / "model"))
    for got in (model.score_events(e), anomaly.Model.load(spark, str(tmp_path / "model")).score_events(e), catalog.queries()["h02_isolation_forest"](spark, sf)):
        got = {r.event_id: (r.score, r.anomalous) for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - v) < 1e-9 and got[k][1] == (got[k][0] >= anomaly.FLAG) for k, v in want.items())
    odd = events(spark, [{"ts": "2030-06-01 03:00:00", "event_type": "never seen", "severity": "CRITICAL", "risk": 100, "dst_port": 60000, "message": "x" * 400, "status": "odd"}])
    assert model.score_events(odd).first().score > np.quantile(list(want.values()), 0.95)

    # What rests on the scores.
    cited = {(r.cluster, r.event_id) for r in detection.entries(spark, sf).select("cluster", "event_id").collect()}
    flagged = {k for k, v in want.items() if v >= anomaly.FLAG}
    for r in catalog.queries()["d08_evidence_scores"](spark, sf).collect():
        own = [want[i] for c, i in cited if c == r.cluster]
        hits = sum(x >= 0.7 for x in own)
        assert abs(r.peak - max(own)) < 1e-9 and r.flagged == hits and r.bump == min(30, int(max(own) * 20 + 0.5) + min(10, 2 * hits))
    ids = {i for _, i in cited}
    r = catalog.queries()["e25_rules_and_model"](spark, sf).first()
    assert (r.rules_only, r.model_only, r.both) == (len(ids - flagged), len(flagged - ids), len(ids & flagged))
    top = catalog.queries()["e31_anomaly_summary"](spark, sf).collect()
    assert [x.score for x in top if x.fact == "anomalous"] == [len(flagged)]
    assert [int(x.key) for x in top if x.fact == "top"] == sorted(want, key=lambda k: (-want[k], k))[:20]


def test_samples_of_large_tables_stay_bounded(spark):
    n = 120_000
    features = spark.range(n).select(F.col("id").alias("event_id"), *(F.rand(k).alias(f) for k, f in enumerate(anomaly.FEATURES)))
    forest = anomaly.fit(features, trees=20)
    assert len(forest) == 20 and all(2 <= len(t) <= 2 * anomaly.SAMPLE for t in forest)


def test_actor_narratives_say_what_the_groups_share(spark):
    login = rules.Rule("BRUTE_FORCE_001", "Logins", "Brute Force", "HIGH", {"event_type": "auth_failure"}, threshold=3, window="1h")
    rows = [{"ts": f"2024-01-01 00:{m:02d}:00", "src_ip": f"10.0.0.{s}", "dst_ip": "10.1.1.1", "username": f"u{s}", "message": "to evil.example.org"} for m in range(0, 12, 3) for s in range(3)]
    df = events(spark, rows)
    members = correlate.cluster(scoring.score_detections(rules.evaluate(df, [login])))
    inc, found = correlate.incidents(members), correlate.entries(members, rules.window_events(members, df, [login]))
    groups, named = alerts.actor_groups(inc, found), alerts.actors(inc, found)[2]
    got = {r.actor: r.text for r in alerts.actor_narratives(groups, inc, named).collect()}
    g, worst = groups.first(), inc.first().severity
    assert got == {"actor-1": f"actor-1: 3 incidents, confidence 1.00, posture {g.posture} of 100. They share {g.iocs} indicators. They share 1 techniques. Their events keep the same beat, as a schedule would. Worst severity: {worst}."}
    assert g.iocs > 0


def test_assets_gate_alerts(spark):
    inc = spark.createDataFrame([("a", 60, "Web Attack"), ("b", 60, "Brute Force"), ("c", 20, "Web Attack")], "cluster string, risk_score int, category string")
    entries = spark.createDataFrame([("a", "10.0.0.1", "WEB1", None), ("b", None, "db", "h"), ("c", None, "web1", None)], "cluster string, src_ip string, dst_ip string, hostname string")
    assets = spark.createDataFrame([("web1", "web", "HIGH"), ("DB", "database", "CRITICAL"), ("other", "web", "CRITICAL")], "name string, asset_type string, criticality string")
    touched = joins.incident_assets(entries, assets)
    assert {(r.cluster, r.name) for r in touched.collect()} == {("a", "web1"), ("b", "DB"), ("c", "web1")}
    none = spark.createDataFrame([], "entity array<string>, risk_score int, rule_id string, category string, value string, confidence double, threat_type string")
    gated = [r for r in alerts.RULES if r.asset_type or r.min_criticality]
    got = alerts.candidates(gated, none, inc, none, touched).collect()
    assert {(r.alert_rule, r.entity) for r in got} == {("ALERT_ASSET_WEB_ATTACK", "a"), ("ALERT_CRITICAL_ASSET_INCIDENT", "b")}
