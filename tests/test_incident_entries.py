"""Facts of incidents come from every event in the windows of their detections, not from the part that is shown."""

from pyspark.sql import functions as F

from tests.test_operators import events
from threatframe.operators import alerts, correlate, joins, rules, scoring
from threatframe.operators.rules import Rule

LOGINS = Rule("BRUTE_FORCE_001", "Logins", "Brute Force", "HIGH", {"event_type": "auth_failure"}, threshold=3, window="1h")
COMMANDS = Rule("PRIV_ESC_001", "Commands", "Privilege Escalation", "MEDIUM", {"event_type": "privilege_escalation"}, window="1h")


def case(spark):
    """240 failed logins of four sources and, after them all, one command; one user binds the sources together."""
    rows = [{"ts": f"2024-01-01 00:{m:02d}:{s:02d}", "src_ip": f"10.0.0.{s}"} for m in range(60) for s in range(4)]
    rows[-1] |= {"message": "x" * 200 + " seen at 203.0.113.9"}
    rows += [{"ts": "2024-01-01 02:00:00", "event_type": "privilege_escalation", "src_ip": "10.0.0.1"}]
    rows += [{"ts": "2024-01-01 01:30:00", "event_type": "auth_success", "src_ip": f"10.0.0.{s}", "username": "root"} for s in range(4)]
    df = events(spark, rows)
    logins = Rule(**{**LOGINS.__dict__, "then_success": True})
    members = correlate.cluster(scoring.score_detections(rules.evaluate(df, [logins, COMMANDS])))
    return df, members, correlate.incidents(members), correlate.entries(members, rules.window_events(members, df, [logins, COMMANDS]))


def test_incident_facts_cover_all_events(spark):
    df, members, inc, found = case(spark)
    assert inc.count() == 1 and found.count() == 241
    assert inc.first().timeline == sorted(inc.first().timeline, key=lambda t: (t.ts, t.rule_id, t.event_id)) and len(inc.first().timeline) == 200
    chain = correlate.kill_chain(found).first()
    assert (chain.weight, chain.tactics) == (241, "privilege-escalation > credential-access")
    assert {(r.tactic, r.events) for r in correlate.phases(found).collect()} == {("credential-access", 240), ("privilege-escalation", 1)}
    assert correlate.annotate(df.withColumn("threat_type", F.lit(None).cast("string")), inc, found).filter("threat_type IS NOT NULL").count() == 241
    scores = df.select("event_id", F.lit(0.9).alias("score"))
    assert joins.scores_of_evidence(found, scores).first().flagged == 241
    assert "241 events in 120 minutes" in alerts.narratives(inc, found).first().text


def test_addresses_are_found_in_whole_messages_of_all_events(spark):
    _, members, _, found = case(spark)
    points = {(r.rule_id, r.entity[0]) for r in members.collect() if any("IOC" in x for x in r.reasons)}
    assert points == {("BRUTE_FORCE_001", "10.0.0.3")}
    assert correlate.signals(found).filter("value = '203.0.113.9'").count() == 1


def test_cadence_equals_gaps_of_all_stamps(spark):
    stamps = [0, 10, 3599, 3600, 7300, 20000, 20000]
    df = spark.createDataFrame([("a", t) for t in stamps] + [("b", 5), ("b", 9)], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.gaps, r.cadence_s) for r in correlate.cadence(df, "k").collect()] == [(5, 3589.0)]
