"""Indicator alerts come from the indicators that the events hold."""

from pyspark.sql import functions as F

from tests.test_operators import events
from threatframe.operators import alerts, joins


def test_indicator_alerts_follow_the_events(spark):
    df = events(spark, [{"ts": "2024-01-01 00:00:00", "src_ip": "8.8.8.50", "dst_ip": None, "message": "from evil.example.org"}, {"ts": "2024-01-01 00:00:01", "src_ip": "8.8.8.50", "dst_ip": "10.0.0.9", "message": "ab" * 16}])
    found = alerts.found_indicators(df, joins.feed_table(spark))
    assert {(r.value, r.related_events, r.threat_type) for r in found.collect()} == {("8.8.8.50", 2, "command_and_control"), ("10.0.0.9", 1, None), ("evil.example.org", 1, None), ("ab" * 16, 1, None)}
    none = spark.createDataFrame([], "entity array<string>, risk_score int, rule_id string, category string, cluster string")
    got = alerts.candidates([r for r in alerts.RULES if r.source == "ioc"], none, none, found).filter(F.col("alert_rule") == "ALERT_HIGH_CONF_IOC")
    assert {r.entity for r in got.collect()} == {"8.8.8.50", "10.0.0.9", "ab" * 16}
