"""Queries of incidents, their signals, links, actors and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import spread, staged
from threatframe.operators import alerts, correlate, joins, reports, scoring
from threatframe.queries import case_sql, query
from threatframe.queries.detection import SCORED, cases, detections, entries, incidents
from threatframe.sources.security import security_events


@query("f04_incident_timeline", case_sql.TIMELINE)
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).select("cluster", F.posexplode("timeline").alias("place", "t")).select("cluster", "place", "t.rule_id", "t.event_id", F.unix_micros("t.ts").alias("ts_us"))


@query("g07_kill_chain", case_sql.KILL_CHAIN)
def g07(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.kill_chain(entries(spark, sf))


@query("f05_investigation_phases", case_sql.PHASES)
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.phases(entries(spark, sf)).select("cluster", "tactic", "stage", "events", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


@query("d17_annotate_events", case_sql.ANNOTATED)
def d17(spark: SparkSession, sf: str) -> DataFrame:
    out = correlate.annotate(security_events(spark, sf).withColumn("threat_type", F.lit(None).cast("string")), *cases(spark, sf))
    return out.filter("threat_type IS NOT NULL").select("event_id", "threat_type", "risk")


@query("e32_incident_reports", case_sql.REPORTS)
def e32(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.incident_reports(incidents(spark, sf)).select("cluster", "title", "severity", "confidence", F.size("evidence").alias("evidence"), "recommendation")


@query("g11_incident_narrative", case_sql.NARRATIVE)
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.narratives(*cases(spark, sf))


@query("d09_incident_assets", case_sql.INCIDENT_ASSETS)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    return joins.incident_assets(entries(spark, sf), reports.assets(security_events(spark, sf)))


@query("d18_evidence_map", case_sql.EVIDENCE_MAP)
def d18(spark: SparkSession, sf: str) -> DataFrame:
    return joins.evidence_map(entries(spark, sf), joins.range_table(spark)).withColumn("iocs", F.size("iocs"))


@query("g09_alert_candidates", case_sql.ALERTS)
def g09(spark: SparkSession, sf: str) -> DataFrame:
    events = security_events(spark, sf)
    inc, rows = cases(spark, sf)
    touched = staged(joins.incident_assets(rows, reports.assets(events)), "touched")
    found = alerts.found_indicators(spread(events), joins.feed_table(spark))
    return alerts.candidates(alerts.RULES, scoring.score_detections(detections(spark, sf)), inc, found, touched).select("alert_rule", "severity", "entity", "risk_score", "facts")


@query("g10_alert_list", "SELECT src_ip AS entity, 'ALERT_USER' AS alert_rule, epoch_us(max(ts)) AS created_us FROM sec GROUP BY src_ip HAVING avg(risk) >= 28 AND avg(risk) < 50 ORDER BY created_us DESC, entity LIMIT 500")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    g = security_events(spark, sf).groupBy(F.col("src_ip").alias("entity")).agg(F.avg("risk").alias("risk"), F.max("ts").alias("created_at"))
    made = g.select("entity", F.when(F.col("risk") >= 10, "ALERT_USER").otherwise("ALERT_OTHER").alias("alert_rule"), F.when(F.col("risk") >= 28, "HIGH").otherwise("LOW").alias("severity"), F.when(F.col("risk") >= 50, "RESOLVED").otherwise("OPEN").alias("status"), "created_at")
    return alerts.listing(made, "OPEN", "high", "ALERT_USER", 500).select("entity", "alert_rule", F.unix_micros("created_at").alias("created_us"))


@query("n03_alert_rule_as_data", SCORED + """ SELECT 'USER_ALERT' AS alert_rule, 'CRITICAL' AS severity, entity, max(score)::INT AS risk_score FROM scored WHERE rule_id = 'PORT_SCAN_001' AND score >= 30 GROUP BY entity
 UNION ALL SELECT 'ALERT_BRUTE_FORCE', 'HIGH', entity, max(score)::INT FROM scored WHERE rule_id = 'BRUTE_FORCE_001' AND score >= 50 GROUP BY entity""")  # fmt: skip
def n03(spark: SparkSession, sf: str) -> DataFrame:
    """A rule added, one changed, and two that cannot be read."""
    raw = [{"rule_id": "USER_ALERT", "source": "detection", "severity": "CRITICAL", "match_rule": "PORT_SCAN_001", "min_risk": "30"}, {"rule_id": "ALERT_BRUTE_FORCE", "min_risk": 50}, {"source": "detection"}, {"rule_id": "BAD", "source": "nowhere"}]
    rules = alerts.parse_alert_rules(raw, [r for r in alerts.RULES if r.rule_id == "ALERT_BRUTE_FORCE"])
    scored = scoring.score_detections(detections(spark, sf))
    none = spark.createDataFrame([], "cluster string, risk_score int, category string, value string, type string, confidence double, threat_type string")
    return alerts.candidates(rules, scored, none, none).select("alert_rule", "severity", "entity", "risk_score")


@query("i02_incident_signals", case_sql.SIGNALS)
def i02(spark: SparkSession, sf: str) -> DataFrame:
    v = correlate.signals(entries(spark, sf))
    beat = F.col("signal") == "cadence"
    return v.select("cluster", "signal", F.when(beat, "").otherwise(F.col("value")).alias("value"), "weight", F.when(beat, F.round(F.col("value").cast("double"), 3)).otherwise(-1.0).alias("seconds"))


@query("d12_incident_links", case_sql.LINKS)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.linked_pairs(correlate.signals(entries(spark, sf))).drop("signals")


@query("i05_knowledge_graph", case_sql.GRAPH)
def i05(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = alerts.knowledge_graph(*cases(spark, sf))
    a = nodes.groupBy(F.lit("node").alias("part"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("part"), "kind").agg(F.count(F.lit(1)).alias("n")))


@query("i06_actor_groups", case_sql.POSTURE)
def i06(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.actor_groups(*cases(spark, sf)).select("actor", "incidents", "confidence", "top_risk", "posture", "breakdown")


@query("g12_actor_narrative")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    """Held against brute force in the tests."""
    inc, rows = cases(spark, sf)
    groups, named = alerts.actor_groups(inc, rows), alerts.actors(inc, rows)[2]
    return alerts.actor_narratives(groups, inc, named)
