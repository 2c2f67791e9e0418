"""Queries of compliance: metrics over events, detections, incidents and their triage, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import staged
from threatframe.operators import correlate, indicators, reports
from threatframe.queries import case_sql, query
from threatframe.queries.detection import cases, detections
from threatframe.queries.ingest import told
from threatframe.sources.security import security_events

#: Messages name a person where the risk is below 60; incidents below 55 have been closed as false positives.
METRICS = case_sql.CASES + """, fc AS (SELECT cluster, split_part(categories, ', ', 1) AS cat, risk // 2 AS half FROM inc), typed AS (SELECT event_id, arg_max(cat, (half, cat)) AS cat FROM ent JOIN fc USING (cluster) GROUP BY event_id),
 m AS (SELECT 'event_count' AS metric, count(*) AS value FROM sec UNION ALL SELECT 'auth_failures', count(*) FROM sec WHERE event_type = 'auth_failure' UNION ALL SELECT 'deny_events', count(*) FROM sec WHERE status = 'deny'
 UNION ALL SELECT 'timed_events', count(ts) FROM sec UNION ALL SELECT 'risk_surface', count(DISTINCT CASE WHEN risk >= 60 THEN src_ip END) FROM (SELECT src_ip, greatest(risk, coalesce(half, 0)) AS risk FROM sec LEFT JOIN (SELECT event_id, max(half) AS half FROM ent JOIN fc USING (cluster) GROUP BY event_id) USING (event_id))
 UNION ALL SELECT 'pii_count', count(*) FROM sec WHERE risk < 60 UNION ALL SELECT 'web_attacks', count(*) FROM typed WHERE cat = 'Web Attack' UNION ALL SELECT 'detection_count', count(*) FROM det
 UNION ALL SELECT 'incident_count', count(*) FROM inc UNION ALL SELECT 'port_scans', count(*) FROM inc WHERE categories LIKE '%Port Scanning%' UNION ALL SELECT 'untriaged_incidents', count(*) FROM inc WHERE risk >= 55)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    inc, rows = cases(spark, sf)
    events = correlate.annotate(security_events(spark, sf).withColumn("threat_type", F.lit(None).cast("string")), inc, rows)
    texts = told(spark, sf).select("event_id", F.transform(indicators.personal(F.col("message")), lambda h: h.type).alias("pii_detected"))
    closed = inc.filter("risk_score < 55").select("cluster", F.lit("FALSE_POSITIVE").alias("status"))
    return staged(reports.compliance_metrics(events.join(texts, "event_id"), detections(spark, sf), inc, closed), "metrics")


@query("e20_compliance_metrics", METRICS + " SELECT * FROM m")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf)


_CONTROLS = ", ".join(str(c) for c in reports.CONTROLS)
AUDIT = METRICS + f""", c(framework, control, severity, metric, operator, bound) AS (VALUES {_CONTROLS}), r AS (SELECT c.*, m.value FROM c LEFT JOIN m USING (metric)),
 a AS (SELECT *, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN (operator = 'le' AND value <= bound) OR (operator = 'ge' AND value >= bound) THEN 'PASS' WHEN severity = 'high' THEN 'FAIL' ELSE 'WARN' END AS result FROM r)"""


@query("e21_compliance_audit", AUDIT + " SELECT framework, control, value, result FROM a")
def e21(spark: SparkSession, sf: str) -> DataFrame:
    return reports.audit(metrics(spark, sf)).select("framework", "control", "value", "result")


@query("e22_compliance_report", AUDIT + " SELECT framework, round(100.0 * count(*) FILTER (result = 'PASS') / count(*), 1) AS score, string_agg(concat('[', result, '] ', control, ' = ', CAST(value AS STRING)), '\n' ORDER BY control) AS body FROM a GROUP BY framework")
def e22(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct("control", F.concat(F.lit("["), "result", F.lit("] "), "control", F.lit(" = "), F.coalesce(F.col("value").cast("string"), F.lit("?"))).alias("l"))
    g = reports.audit(metrics(spark, sf)).groupBy("framework").agg(F.round(100.0 * F.count_if(F.col("result") == "PASS") / F.count(F.lit(1)), 1).alias("score"), F.array_sort(F.collect_list(line)).alias("ls"))
    return g.select("framework", "score", F.array_join(F.transform("ls", lambda x: x.l), "\n").alias("body"))
