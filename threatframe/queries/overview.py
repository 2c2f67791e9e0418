"""Queries of dashboards, counters, indicator lists and reputations over enriched events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import staged
from threatframe.operators import correlate, joins, overview, reports
from threatframe.queries import case_sql, query
from threatframe.queries.detection import _all_best, cases, detections
from threatframe.queries.ingest import rendered, told
from threatframe.queries.reports import ASSETS, EDGES, RANK, day_us
from threatframe.sources import formats
from threatframe.sources.security import security_events

#: Messages end in the source's address where the risk is 60 or more, and in a mail address elsewhere. typed: threat types.
TOLD = "WITH i AS (SELECT *, src_ip AS value, epoch_us(date_trunc('day', ts)) AS job FROM sec WHERE risk >= 60)"
TYPED = case_sql.CASES + ", fc AS (SELECT cluster, split_part(categories, ', ', 1) AS cat, risk // 2 AS half FROM inc), typed AS (SELECT event_id, arg_max(cat, (half, cat)) AS cat, max(half) AS half FROM ent JOIN fc USING (cluster) GROUP BY event_id)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return staged(overview.enriched(told(spark, sf)), "enriched")


def typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(enriched events with the threat types that incidents give them, incidents)."""
    inc, rows = cases(spark, sf)
    return staged(correlate.annotate(events(spark, sf).withColumn("threat_type", F.lit(None).cast("string")), inc, rows), "typed"), inc


@query("e06_dashboard_all", TYPED + """ SELECT count(*) AS events, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (status = 'failure') AS failures, count(*) FILTER (status = 'deny') AS denied, count(DISTINCT src_ip) AS sources, count(DISTINCT username) AS users,
 count(*) FILTER (greatest(risk, coalesce(half, 0)) >= 60) AS risky, count(DISTINCT CASE WHEN risk >= 60 THEN src_ip END) AS indicators, count(*) FILTER (risk < 60) AS personal, (SELECT count(*) FROM inc) AS incidents, (SELECT count(*) FROM inc) AS new_incidents FROM sec LEFT JOIN typed USING (event_id)""")  # fmt: skip
def e06(spark: SparkSession, sf: str) -> DataFrame:
    return overview.cards(*typed(spark, sf))


@query("e07_dashboard_facets", TYPED + """ SELECT facet, key, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS p FROM (SELECT 'severity' AS facet, severity AS key, count(*) AS n FROM sec GROUP BY severity
 UNION ALL SELECT 'src_ip', src_ip, count(*) FROM sec GROUP BY src_ip UNION ALL SELECT 'threat_type', cat, count(*) FROM typed GROUP BY cat UNION ALL SELECT 'ioc_type', 'ipv4', count(*) FROM sec WHERE risk >= 60)) WHERE facet <> 'src_ip' OR p <= 8""")  # fmt: skip
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return overview.facets(typed(spark, sf)[0], {"severity": None, "src_ip": 8})


@query("c08_job_counters", TOLD + """ SELECT 'events' AS fact, '' AS key, count(*) AS value FROM sec UNION ALL SELECT 'parsed', '', count(*) FROM sec WHERE event_type <> 'dns_query' UNION ALL SELECT 'unparsed', '', count(*) FROM sec WHERE event_type = 'dns_query' UNION ALL SELECT 'personal', '', count(*) FROM sec WHERE risk < 60
 UNION ALL SELECT 'ioc_type', 'ipv4', count(*) FROM i UNION ALL SELECT 'different_iocs', '', count(DISTINCT value) FROM i UNION ALL SELECT 'personal_type', 'EMAIL', count(*) FROM sec WHERE risk < 60
 UNION ALL SELECT 'event_type', CASE event_type WHEN 'dns_query' THEN 'generic_event' ELSE event_type END, count(*) FROM sec GROUP BY event_type""")  # fmt: skip
def c08(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a job in which no format knew the name lookups."""
    return overview.counters(events(spark, sf).withColumn("event_type", F.when(F.col("event_type") != "dns_query", F.col("event_type")).otherwise("generic_event")))


@query("e05_ioc_span", TOLD + " SELECT job, value, 'ipv4' AS type, count(*) AS occurrences, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY job, value")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    out = overview.ioc_list(events(spark, sf), day_us())
    return out.select("job", "value", "type", "occurrences", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


_FEED = ", ".join(str(r) for r in joins.FEED)


@query("d15_reputation_verdicts", TOLD + f""", f(value, threat_type, confidence) AS (VALUES {_FEED}), s AS (SELECT job, value, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY job, value),
 g AS (SELECT value, CAST(sum(n) AS BIGINT) AS related_events, count(*) AS jobs, epoch_us(min(first)) AS first_us, epoch_us(max(last)) AS last_us, array_to_string(list(concat(job, ':', n) ORDER BY last DESC)[1:5], ' ') AS newest FROM s GROUP BY value)
 SELECT value, CASE WHEN coalesce(confidence, 0.99) >= 0.9 THEN 'malicious' WHEN coalesce(confidence, 0.99) >= 0.7 THEN 'suspicious' ELSE 'informational' END AS verdict, threat_type, coalesce(related_events, 0) AS related_events, coalesce(jobs, 0) AS jobs, coalesce(first_us, -1) AS first_us, coalesce(last_us, -1) AS last_us, coalesce(newest, '') AS newest FROM f FULL JOIN g USING (value)""")  # fmt: skip
def d15(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the feed and of the events' days, with their verdict and their five newest sightings."""
    out = overview.reputations(joins.feed_table(spark), overview.ioc_list(events(spark, sf), day_us()), 5)
    newest = F.array_join(F.transform("sightings", lambda s: F.concat_ws(":", s.job.cast("string"), s.occurrences.cast("string"))), " ")
    us = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1))
    return out.select("value", "verdict", "threat_type", "related_events", "jobs", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), F.coalesce(newest, F.lit("")).alias("newest"))


@query("e14_asset_cases", case_sql.CASES + ", " + ASSETS.removeprefix("WITH ") + """, x AS (SELECT cluster, rule_id, det, src_ip, unnest(list_distinct([src_ip, dst_ip, hostname])) AS name FROM ent)
 SELECT a.name, a.asset_type, a.events, count(DISTINCT x.src_ip) AS sources, count(DISTINCT x.rule_id || '|' || x.det) AS detections, count(DISTINCT x.cluster) AS incidents FROM a LEFT JOIN x ON lower(x.name) = lower(a.name) GROUP BY ALL""")  # fmt: skip
def e14(spark: SparkSession, sf: str) -> DataFrame:
    out = overview.asset_cases(reports.assets(security_events(spark, sf)), cases(spark, sf)[1])
    return out.select("name", "asset_type", "events", "sources", "detections", "incidents")


_STATUS = "CASE WHEN risk >= 90 THEN '503' WHEN risk >= 60 THEN '404' ELSE '200' END"


@query("e16_web_response_edges", f"SELECT CASE WHEN risk >= 90 THEN 'web_fault' WHEN risk >= 60 THEN 'web_error' ELSE 'web' END AS kind, src_ip AS source, hostname AS target, count(*) AS weight, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({RANK}) + 1] AS severity FROM sec WHERE event_type = 'http_request' GROUP BY ALL")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    return overview.response_edges(security_events(spark, sf).withColumn("status", F.expr(_STATUS)))


@query("e17_typed_nodes", _all_best() + ", " + EDGES.removeprefix("WITH ") + """, n AS (SELECT node, min(r) AS r FROM (SELECT source AS node, 0 AS r FROM e UNION ALL SELECT target, CASE kind WHEN 'traffic' THEN 0 WHEN 'login' THEN 1 ELSE 2 END FROM e) GROUP BY node), k AS (SELECT src_ip AS node, max(risk) AS risk FROM sec GROUP BY src_ip),
 t AS (SELECT node, r, coalesce(risk, 0) AS risk FROM n LEFT JOIN k USING (node) ORDER BY risk DESC, node LIMIT 230), d AS (SELECT p AS node, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM (SELECT rule_id, unnest(string_split(entity, ':')) AS p FROM det) GROUP BY p)
 SELECT 'node' AS part, node AS name, ['ip', 'user', 'host'][r + 1] AS type, CAST(risk AS BIGINT) AS n, coalesce(rules, '') AS detail FROM t LEFT JOIN d USING (node)
 UNION ALL SELECT 'edge', concat(source, '>', target), kind, weight, '' FROM e WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)""")  # fmt: skip
def e17(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    nodes, edges = overview.typed_nodes(staged(reports.graph_edges(e), "edges"), e, detections(spark, sf), 230)
    nodes = nodes.select(F.lit("node").alias("part"), F.col("node").alias("name"), "type", F.col("risk").cast("long").alias("n"), F.array_join("rules", ",").alias("detail"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("part"), F.concat_ws(">", "source", "target").alias("name"), F.col("kind").alias("type"), F.col("weight").alias("n"), F.lit("").alias("detail")))


@query("b10_parsed_coverage", """WITH l AS (SELECT event_type AS file, CASE WHEN event_id % 7 = 0 THEN 'generic' ELSE CASE event_type WHEN 'http_request' THEN 'apache' WHEN 'dns_query' THEN 'dns' WHEN 'firewall_event' THEN 'firewall' ELSE 'syslog' END END AS format FROM sec)
 SELECT coalesce(file, 'all') AS file, count(*) AS lines, round(100 * avg(CASE WHEN format <> 'generic' THEN 1 ELSE 0 END), 2) AS named, round(100 * avg(CASE WHEN format = 'generic' THEN 1 ELSE 0 END), 2) AS fallback, count(DISTINCT format) AS formats FROM l GROUP BY ROLLUP (file)""")  # fmt: skip
def b10(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through the parser, every seventh of which is noise."""
    raw = rendered(spark, sf).withColumn("line", F.when(F.col("event_id") % 7 == 0, "some noise").otherwise(F.col("line")))
    return overview.parse_coverage(formats.parsed(raw, "line")).withColumn("file", F.coalesce("file", F.lit("all")))
