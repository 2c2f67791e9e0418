"""Queries of readers, reference data from files, stream sources, export checks and rules as data: each writes what it then
reads from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import shared_dir
from threatframe.operators import indicators, joins, reports
from threatframe.queries import query
from threatframe.queries.compliance import METRICS, metrics
from threatframe.queries.text import _without_mails, documents
from threatframe.sinks import writers
from threatframe.sources import formats, readers, reference
from threatframe.sources.security import security_events
from threatframe.streaming import jobs


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_numbered_lines", "SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, concat(CAST(event_id AS STRING), ' ', message) AS line FROM sec")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per event type, its lines in the order of events."""
    path = _path(spark, "lines")
    e = security_events(spark, sf).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    e.select("event_type", F.concat_ws(" ", F.col("event_id").cast("string"), "message").alias("value")).write.partitionBy("event_type").text(path)
    return readers.read_lines(spark, path).select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("file"), "line_no", "line")


@query("a02_read_json", "SELECT event_id AS id, src_ip AS source_ip, dst_port AS source_port, concat('[\"', username, '\"]') AS users, message FROM sec")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    """Nested objects become dotted columns, arrays JSON text."""
    path = _path(spark, "json")
    e = security_events(spark, sf)
    e.select(F.col("event_id").alias("id"), F.struct(F.col("src_ip").alias("ip"), F.struct(F.col("dst_port").alias("n")).alias("port")).alias("source"), F.array("username").alias("users"), "message").write.json(path)
    return readers.read_json(spark, path).select("id", F.col("`source.ip`").alias("source_ip"), F.col("`source.port.n`").alias("source_port"), "users", "message")


@query("a03_read_csv", "SELECT CAST(event_id AS STRING) AS event_id, CASE WHEN status <> 'allow' THEN status END AS status, concat(message, ', \"', username, '\"') AS message FROM sec")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    """Empty cells are null; quotes and commas survive."""
    path = _path(spark, "csv")
    status = F.when(F.col("status") == "allow", "  ").otherwise(F.col("status"))
    security_events(spark, sf).select("event_id", status.alias("status"), F.concat("message", F.lit(', "'), "username", F.lit('"')).alias("message")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path)


@query("a04_read_xml", "SELECT event_id AS id, src_ip AS ip, dst_port AS port, message FROM sec")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes and nested elements become columns."""
    path = _path(spark, "xml")
    e = security_events(spark, sf).select(F.col("event_id").alias("_id"), F.struct(F.col("src_ip").alias("ip"), F.col("dst_port").alias("_port")).alias("source"), "message")
    e.write.format("xml").option("rowTag", "event").option("rootTag", "events").save(path)
    return readers.read_xml(spark, path, "event").select(F.col("`@id`").alias("id"), F.col("`source.ip`").alias("ip"), F.col("`source.@port`").cast("int").alias("port"), "message")


_CODE = "CASE WHEN status = 'failure' THEN 4625 ELSE 4624 END"


@query("a05_windows_events", f"SELECT CAST({_CODE} AS INT) AS win_event_id, severity, hostname, username, CASE WHEN risk >= 10 THEN src_ip END AS src_ip, CAST(event_id AS STRING) AS record FROM sec")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    """Event fragments without a root element."""
    path = _path(spark, "windows")
    level = F.element_at(F.create_map(*(F.lit(x) for x in ("CRITICAL", "1", "HIGH", "2", "MEDIUM", "3", "LOW", "4"))), F.col("severity"))
    data = lambda name, c: F.concat(F.lit(f'<Data Name="{name}">'), c, F.lit("</Data>"))
    e = security_events(spark, sf)
    line = F.concat(
        F.lit("<Event><System><EventID>"), F.expr(_CODE).cast("string"), F.lit("</EventID><Level>"), level, F.lit("</Level><Computer>"), "hostname", F.lit('</Computer><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData>'),
        data("TargetUserName", F.col("username")), data("IpAddress", F.when(F.col("risk") >= 10, F.col("src_ip")).otherwise("-")), data("Record", F.col("event_id").cast("string")), F.lit("</EventData></Event>"),
    )
    e.select(line.alias("value")).write.text(path)
    return readers.read_windows_events(spark, path).select("win_event_id", "severity", "hostname", "username", "src_ip", F.col("mappings")["Record"].alias("record"))


@query("a05_windows_text", f"SELECT CAST({_CODE} AS INT) AS win_event_id, hostname, username, src_ip FROM sec")
def a05b(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of `Name: value` lines."""
    path = _path(spark, "windows-text")
    e = security_events(spark, sf)
    block = F.concat(F.lit("Event ID: "), F.expr(_CODE).cast("string"), F.lit("\nComputer:  "), "hostname", F.lit("\n  Account Name: "), "username", F.lit("\nAccount Name: second\nSource Network Address: "), "src_ip", F.lit("\n"))
    e.select(block.alias("value")).write.text(path)
    return readers.read_windows_text(spark, path).select("win_event_id", "hostname", "username", "src_ip")


@query("a06_vendor_json", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'edr_event' ELSE 'cloud_event' END AS event_type, src_ip, username, CASE WHEN event_id % 3 = 2 THEN NULL WHEN risk >= 60 THEN 'failure' WHEN event_id % 3 = 1 THEN 'success' END AS status,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN risk >= 60 THEN 'HIGH' END WHEN 2 THEN severity END AS severity FROM sec""")  # fmt: skip
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the events as each of three vendors writes them."""
    bad = F.col("risk") >= 60
    trail = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("eventTime"), F.lit("iam.amazonaws.com").alias("eventSource"), F.lit("CreateUser").alias("eventName"), F.col("src_ip").alias("sourceIPAddress"), F.struct(F.col("username").alias("arn")).alias("userIdentity"), F.when(bad, "AccessDenied").alias("errorCode")))
    okta = F.to_json(F.struct(F.lit("user.session.start").alias("eventType"), F.lit("2024-01-01T00:00:00Z").alias("published"), F.struct(F.when(bad, "FAILURE").otherwise("SUCCESS").alias("result")).alias("outcome"), F.struct(F.col("username").alias("alternateId")).alias("actor"), F.struct(F.col("src_ip").alias("ipAddress")).alias("client")))
    level = F.array_position(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("severity")) + 1
    falcon = F.to_json(F.struct(F.lit("DetectionSummary").alias("event_type"), F.lit("c").alias("cid"), F.col("event_id").cast("string").alias("detection_id"), F.col("src_ip").alias("local_ip"), F.col("username").alias("user_name"), level.alias("severity")))
    e = security_events(spark, sf)
    raw = e.select("event_id", F.when(F.col("event_id") % 3 == 0, trail).when(F.col("event_id") % 3 == 1, okta).otherwise(falcon).alias("line"))
    return formats.parsed(raw, "line").select("event_id", "event_type", "src_ip", "username", "status", "severity")


@query("a07_reference_files", """WITH f AS (SELECT src_ip AS value, 'seen' AS threat_type, max(risk) / 200.0 AS confidence FROM sec GROUP BY src_ip HAVING max(risk) >= 90), r AS (SELECT DISTINCT CAST(split_part(src_ip, '.', 1) AS INT) AS a, CAST(split_part(src_ip, '.', 2) AS INT) AS b FROM sec)
 SELECT event_id, f.threat_type, concat('net-', a, '-', b) AS country FROM sec LEFT JOIN f ON f.value = src_ip JOIN r ON starts_with(src_ip, concat(a, '.', b, '.'))""")  # fmt: skip
def a07(spark: SparkSession, sf: str) -> DataFrame:
    """A feed and address ranges, written as CSV from the events, loaded and applied to them."""
    e = security_events(spark, sf)
    feed, ranges = _path(spark, "feed"), _path(spark, "ranges")
    e.groupBy(F.upper("src_ip").alias("value")).agg(F.max("risk").alias("r")).filter("r >= 90").select("value", F.lit("seen").alias("threat_type"), (F.col("r") / 200).alias("confidence")).write.option("header", True).csv(feed)
    net = F.split("src_ip", r"\.")
    e.select(net[0].alias("a"), net[1].alias("b")).distinct().select(
        F.concat_ws(".", "a", "b", F.lit("0.0")).alias("first"), F.concat_ws(".", "a", "b", F.lit("255.255")).alias("last"), F.concat_ws("-", F.lit("net"), "a", "b").alias("country"), F.lit("private").alias("kind")
    ).write.option("header", True).csv(ranges)
    out = joins.geo_lookup(joins.intel_match(e, reference.load_feed(spark, feed), ["src_ip"], "event_id"), reference.load_ranges(spark, ranges), "src_ip")
    return out.select("event_id", "threat_type", "country")


@query("a08_stream_source", "SELECT event_type, count(*) AS n, max(event_id) AS latest FROM sec GROUP BY event_type")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that a folder holds now, read as a stream."""
    out = jobs.run_to_table(jobs.events_stream(spark, sf).select("event_id", "event_type"), "source")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


_KINDS = ("cef", "leef", "syslog", "ecs", "ocsf", "json", "csv", "stix")


@query("k10_export_validation", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS lines, count(*) FILTER (event_id % 10 = 3) AS faults FROM sec" for k in _KINDS))
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """Every format of every event, with each tenth line damaged before the check."""
    e = security_events(spark, sf)
    plain = {"json": F.to_json(F.struct("event_id", "message")), "csv": F.concat_ws(",", F.col("event_id").cast("string"), F.concat(F.lit('"'), "message", F.lit('"'))), "stix": writers.stix(e.withColumns({"value": F.col("src_ip"), "type": F.lit("ipv4")}))}
    damage = {"json": F.lit("{"), "csv": F.lit('a,"b'), "stix": F.lit('{"id":"indicator--1","pattern":"[a=b]"}')}
    out = None
    for k in _KINDS:
        line = plain[k] if k in plain else writers.LINES[k](e)
        rows = e.withColumns({"value": F.col("src_ip"), "type": F.lit("ipv4")}).select(F.when(F.col("event_id") % 10 == 3, damage.get(k, F.lit("no header"))).otherwise(line).alias("value"))
        part = writers.invalid(rows, k).withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query("n04_control_as_data", METRICS + ", c(control, metric, op, bound) AS (VALUES ('A', 'auth_failures', 'gt', 10), ('B', 'deny_events', 'eq', -1), ('C', 'unknown_metric', 'le', 0)) SELECT control, coalesce(value, -1) AS value, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN (op = 'gt' AND value > bound) OR (op = 'eq' AND value = bound) THEN 'PASS' WHEN control = 'B' THEN 'FAIL' ELSE 'WARN' END AS result FROM c LEFT JOIN m USING (metric)")
def n04(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own controls from a file."""
    path = _path(spark, "controls")
    rows = [("Own", "A", "LOW", "auth_failures", "gt", "10"), ("Own", "B", "High", "deny_events", "eq", "-1"), ("Own", "C", "low", "unknown_metric", "le", "0"), ("Own", "D", "low", "event_count", "about", "5")]
    spark.createDataFrame(rows, "framework string, control string, severity string, metric string, operator string, bound string").write.option("header", True).csv(path)
    return reports.audit(metrics(spark, sf), reference.load_controls(spark, path)).select("control", F.coalesce("value", F.lit(-1)).alias("value"), "result")


@query("n05_policy_as_data", _without_mails("[EMAIL]"), sec=False)
def n05(spark: SparkSession, sf: str) -> DataFrame:
    """A user's policy over the default one."""
    hits = F.filter(indicators.personal(F.col("text")), lambda h: h.type == "EMAIL")
    return documents(spark, sf).select("doc_id", indicators.redacted(F.col("text"), {"email": "type"}, hits).alias("text"))
