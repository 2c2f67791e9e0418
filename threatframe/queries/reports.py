"""Queries of aggregates, joins to reference data, search and listings on the security view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import shared_dir
from threatframe.operators import joins, reports, search
from threatframe.queries import query
from threatframe.sources import reference
from threatframe.sources.security import COLUMNS, security_events, severity_rank

DAY = "date_trunc('day', ts)"
RANK = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"


def day_us():
    """The day of an event, in microseconds."""
    return F.unix_micros(F.date_trunc("day", "ts"))


@query("e06_dashboard_cards", """SELECT count(*) AS events, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (status = 'failure') AS failures, count(*) FILTER (status = 'deny') AS denied,
 count(DISTINCT src_ip) AS sources, count(DISTINCT username) AS users, count(*) FILTER (risk >= 60) AS risky FROM sec""")  # fmt: skip
def e06(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cards(security_events(spark, sf))


@query("e07_dashboard_breakdowns", """SELECT facet, key, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS p FROM (
 SELECT 'severity' AS facet, severity AS key, count(*) AS n FROM sec GROUP BY severity UNION ALL SELECT 'event_type', event_type, count(*) FROM sec GROUP BY event_type
 UNION ALL SELECT 'src_ip', src_ip, count(*) FROM sec GROUP BY src_ip)) WHERE facet = 'severity' OR p <= 8""")  # fmt: skip
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return reports.breakdowns(security_events(spark, sf), {"severity": None, "event_type": 8, "src_ip": 8})


@query("e08_minute_of_day", "SELECT strftime(ts, '%H:%M') AS minute, count(*) AS n FROM sec GROUP BY 1")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).groupBy(F.date_format("ts", "HH:mm").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("e08_minute_timeline", "SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM sec GROUP BY 1")
def e08b(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).groupBy(F.unix_micros(F.date_trunc("minute", "ts")).alias("minute_us")).agg(F.count(F.lit(1)).alias("n"))


WINDOWS = f"""WITH v AS (
 SELECT {DAY} AS job, 'ip' AS entity_type, src_ip AS entity, ['events', 'risk_sum', 'dst_ips', 'dst_ports'] AS names, [CAST(count(*) AS DOUBLE), CAST(sum(risk) AS DOUBLE), CAST(count(DISTINCT dst_ip) AS DOUBLE), CAST(count(DISTINCT dst_port) AS DOUBLE)] AS vals FROM sec GROUP BY ALL
 UNION ALL SELECT {DAY}, 'host', hostname, ['events'], [CAST(count(*) AS DOUBLE)] FROM sec GROUP BY ALL
 UNION ALL SELECT {DAY}, 'user', username, ['events', 'failed_logins'], [CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (event_type = 'auth_failure') AS DOUBLE)] FROM sec GROUP BY ALL
 UNION ALL SELECT {DAY}, 'port', CAST(dst_port AS STRING), ['events'], [CAST(count(*) AS DOUBLE)] FROM sec GROUP BY ALL),
 w AS (SELECT job, entity_type, entity, unnest(names) AS attribute, unnest(vals) AS value FROM v)"""  # fmt: skip


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entity_windows(security_events(spark, sf), day_us())


@query("e09_entity_windows", WINDOWS + " SELECT epoch_us(job) AS job, entity_type, entity, attribute, value FROM w")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf)


BASE = WINDOWS + ", b AS (SELECT entity_type, entity, attribute, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM w GROUP BY ALL)"


@query("e11_baseline_rebuild", BASE + " SELECT entity_type, entity, attribute, n, round(mean, 6) AS mean, round(std, 5) AS std FROM b")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    return reports.listing(reports.baseline(windows(spark, sf))).select(*reports.BASE_KEYS, "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("e10_baseline_fold", BASE + " SELECT entity_type, entity, attribute, n, round(mean, 6) AS mean, round(std, 5) AS std FROM b")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    """Even and odd days as two baselines, folded to one."""
    w = windows(spark, sf).withColumn("_half", F.pmod(F.floor(F.col("job") / 86_400_000_000), F.lit(2)))
    both = reports.fold(reports.baseline(w.filter("_half = 0")), reports.baseline(w.filter("_half = 1")))
    return reports.listing(both).select(*reports.BASE_KEYS, "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("e12_baseline_listing", BASE + " SELECT entity_type, entity, attribute, n, round(mean, 6) AS mean, round(CASE WHEN mean <> 0 THEN std / abs(mean) END, 5) AS cv FROM b ORDER BY n DESC, mean DESC, entity_type, entity, attribute LIMIT 50 OFFSET 10")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.listing(reports.baseline(windows(spark, sf))).orderBy(F.desc("n"), F.desc("mean"), *reports.BASE_KEYS)
    return rows.offset(10).limit(50).select(*reports.BASE_KEYS, "n", F.round("mean", 6).alias("mean"), F.round("cv", 5).alias("cv"))


@query("e13_baseline_anomalies", BASE + " SELECT epoch_us(job) AS job, entity_type, entity, attribute, value, round((value - mean) / std, 4) AS z FROM w JOIN b USING (entity_type, entity, attribute) WHERE n >= 2 AND std > 1e-9 AND round((value - mean) / std, 4) >= 3.0")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    w = windows(spark, sf)
    found = reports.anomalies(w, reports.baseline(w), 2.99).withColumn("z", F.round("z", 4))
    return found.filter("z >= 3.0").select("job", *reports.BASE_KEYS, "value", "z")


@query("d11_baseline_join", BASE + " SELECT entity_type, attribute, count(*) AS windows, round(max((value - mean) / std), 4) AS top_z FROM w JOIN b USING (entity_type, entity, attribute) WHERE n >= 2 AND std > 1e-9 GROUP BY ALL")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    w = windows(spark, sf)
    z = reports.anomalies(w, reports.baseline(w), float("-inf"))
    return z.groupBy("entity_type", "attribute").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("z"), 4).alias("top_z"))


ASSETS = """WITH s AS (SELECT *, CASE WHEN dst_port IN (80, 443, 8080, 8443) THEN 'web' WHEN dst_port IN (3306) THEN 'mysql' WHEN dst_port = 21 THEN 'ftp' WHEN dst_port = 22 THEN 'ssh' WHEN dst_port = 23 THEN 'telnet' WHEN dst_port = 25 THEN 'smtp' WHEN dst_port = 53 THEN 'dns'
  WHEN dst_port = 110 THEN 'pop3' WHEN dst_port = 143 THEN 'imap' WHEN dst_port = 161 THEN 'snmp' WHEN dst_port = 445 THEN 'smb' END AS service FROM sec),
 r AS (SELECT hostname AS name, CAST(NULL AS STRING) AS service, CAST(NULL AS INT) AS port, ts, risk, true AS named FROM s UNION ALL SELECT dst_ip, service, dst_port, ts, risk, false FROM s WHERE service IS NOT NULL),
 g AS (SELECT name, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(DISTINCT port) AS ports, min(ts) AS first_seen, max(ts) AS last_seen, max(risk) AS max_risk, count(*) AS events, bool_or(named) AS named FROM r GROUP BY name),
 t AS (SELECT *, CASE WHEN contains(coalesce(services, ''), 'web') THEN 'web' ELSE 'server' END AS asset_type FROM g),
 a AS (SELECT *, CASE WHEN max_risk >= 75 THEN 'CRITICAL' WHEN max_risk >= 50 THEN CASE asset_type WHEN 'web' THEN 'CRITICAL' ELSE 'HIGH' END ELSE CASE asset_type WHEN 'web' THEN 'HIGH' ELSE 'MEDIUM' END END AS criticality FROM t)"""  # fmt: skip


@query("e14_asset_inventory", ASSETS + " SELECT name, coalesce(services, '') AS services, ports, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, max_risk, events, asset_type, criticality FROM a")
def e14(spark: SparkSession, sf: str) -> DataFrame:
    a = reports.assets(security_events(spark, sf))
    return a.select("name", F.array_join("services", ",").alias("services"), F.size("ports").cast("long").alias("ports"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "max_risk", "events", "asset_type", "criticality")


@query("e15_asset_summary", ASSETS + " SELECT asset_type, criticality, count(*) AS n FROM a GROUP BY ALL")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return reports.assets(security_events(spark, sf)).groupBy("asset_type", "criticality").agg(F.count(F.lit(1)).alias("n"))


EDGES = f"""WITH e AS (SELECT 'traffic' AS kind, src_ip AS source, dst_ip AS target, count(*) AS weight, max({RANK}) AS r FROM sec GROUP BY ALL
 UNION ALL SELECT 'login', src_ip, username, count(*), max({RANK}) FROM sec WHERE event_type IN ('auth_failure', 'auth_success') GROUP BY ALL
 UNION ALL SELECT 'web', src_ip, hostname, count(*), max({RANK}) FROM sec WHERE event_type = 'http_request' GROUP BY ALL)"""  # fmt: skip


@query("e16_attack_graph_edges", EDGES + " SELECT kind, source, target, weight, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1] AS severity FROM e")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    return reports.graph_edges(security_events(spark, sf))


@query("e17_attack_graph_nodes", EDGES + ", n AS (SELECT source AS node FROM e UNION SELECT target FROM e) SELECT node, coalesce(max(s.risk), 0) AS risk FROM n LEFT JOIN sec s ON s.src_ip = n.node GROUP BY node ORDER BY risk DESC, node LIMIT 150")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    events = security_events(spark, sf)
    return reports.graph_nodes(reports.graph_edges(events), events, 150)


@query("e19_field_coverage", "SELECT field, count(v) AS filled, round(100.0 * count(v) / (SELECT count(*) FROM sec), 2) AS share FROM (SELECT unnest(['message', 'severity', 'src_ip', 'status', 'username']) AS field, unnest([message, severity, src_ip, status, username]) AS v FROM sec) GROUP BY field")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage(security_events(spark, sf), ["message", "severity", "src_ip", "status", "username"])


@query("e24_health_facts", f"""WITH f AS (SELECT 'failed' AS fact, '' AS key, count(*) AS value FROM sec WHERE status = 'failure' UNION ALL SELECT 'severity', severity, count(*) FROM sec GROUP BY severity
 UNION ALL SELECT 'first_us', '', min(epoch_us(ts)) FROM sec UNION ALL SELECT 'last_us', '', max(epoch_us(ts)) FROM sec
 UNION ALL (SELECT 'message', message, count(*) AS n FROM sec GROUP BY message ORDER BY n DESC, message LIMIT 5)) SELECT * FROM f""")  # fmt: skip
def e24(spark: SparkSession, sf: str) -> DataFrame:
    return search.health_facts(security_events(spark, sf))


@query("e29_feature_statistics", "SELECT event_type, round(avg(risk), 6) AS mean, round(stddev_pop(risk), 6) AS std, count(DISTINCT dst_port) AS ports FROM sec GROUP BY event_type")
def e29(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).groupBy("event_type").agg(F.round(F.avg("risk"), 6).alias("mean"), F.round(F.stddev_pop("risk"), 6).alias("std"), F.count_distinct("dst_port").alias("ports"))


DIGEST = f"""WITH o AS (SELECT epoch_us({DAY}) AS job, sha256(concat(CAST(event_id AS STRING), '|', message)) AS h, row_number() OVER (PARTITION BY epoch_us({DAY}) ORDER BY event_id) - 1 AS n FROM sec),
 k AS (SELECT job, n // {reports.CHUNK} AS chunk, count(*) AS events, sha256(string_agg(h, '' ORDER BY n)) AS h FROM o GROUP BY ALL), d AS (SELECT job, CAST(sum(events) AS BIGINT) AS events, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM k GROUP BY job)"""


def digests(spark: SparkSession, sf: str) -> DataFrame:
    return reports.batch_digests(security_events(spark, sf), day_us(), "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "message"))


@query("e30_batch_digests", DIGEST + " SELECT * FROM d")
def e30(spark: SparkSession, sf: str) -> DataFrame:
    return digests(spark, sf)


@query("f07_chain_links", DIGEST + ", p AS (SELECT *, coalesce(lag(digest) OVER (ORDER BY job), repeat('0', 64)) AS prev_hash FROM d) SELECT job, events, digest, prev_hash, sha256(concat(prev_hash, digest)) AS chain_hash FROM p")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return reports.chained(digests(spark, sf))


@query("f07_verify_chain", DIGEST + " SELECT job, 'changed' AS fault FROM d WHERE (job // 86400000000) % 7 = 0 UNION ALL SELECT p.job, 'relinked' FROM (SELECT job, lag(job) OVER (ORDER BY job) AS before FROM d) p WHERE (p.before // 86400000000) % 7 = 0 AND (p.job // 86400000000) % 7 <> 0")
def f07b(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh day's stored digest is altered before the check."""
    d = digests(spark, sf)
    altered = d.withColumn("digest", F.when(F.floor(F.col("job") / 86_400_000_000) % 7 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    return reports.broken_links(reports.chained(altered), d)


@query("e23_triage_summary", "WITH s AS (SELECT src_ip, CASE WHEN max(risk) >= 90 THEN 'NEW' WHEN max(risk) >= 60 THEN 'ACK' ELSE 'RESOLVED' END AS status, min(ts) AS created FROM sec GROUP BY src_ip) SELECT status, count(*) AS n, min(epoch_us(created)) AS oldest_us FROM s GROUP BY status")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.max("risk") >= 90, "NEW").when(F.max("risk") >= 60, "ACK").otherwise("RESOLVED")
    cases = security_events(spark, sf).groupBy("src_ip").agg(status.alias("status"), F.min("ts").alias("created"))
    return search.triage(cases)


@query("f09_latest_status", "WITH l AS (SELECT username, ts, CASE event_type WHEN 'auth_failure' THEN 'OPEN' WHEN 'http_request' THEN 'ACK' WHEN 'auth_success' THEN 'RESOLVED' END AS status, event_id FROM sec) SELECT username, arg_max(status, (ts, event_id)) AS status, epoch_us(min(ts) FILTER (status = 'ACK')) AS acked_us, epoch_us(max(ts) FILTER (status = 'RESOLVED')) AS resolved_us FROM l WHERE status IS NOT NULL GROUP BY username")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "auth_failure", "OPEN").when(F.col("event_type") == "http_request", "ACK").when(F.col("event_type") == "auth_success", "RESOLVED")
    log = security_events(spark, sf).withColumn("status", status).filter("status IS NOT NULL")
    out = search.latest_status(log, "username", F.struct("ts", "event_id"))
    return out.select("username", "status", F.unix_micros("acked").alias("acked_us"), F.unix_micros("resolved").alias("resolved_us"))


# Joins to reference data

_GEO = ", ".join(str(r) for r in joins.RANGES)
NUMBER = "CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT)"
GEO = f"WITH r(lo, hi, country, kind) AS (VALUES {_GEO}), g AS (SELECT event_id, src_ip, r.country, coalesce(r.kind, 'public') AS kind FROM sec LEFT JOIN r ON {NUMBER} BETWEEN r.lo AND r.hi)"


@query("d01_geo_lookup", GEO + " SELECT * FROM g")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return joins.geo_lookup(security_events(spark, sf), joins.range_table(spark), "src_ip").select("event_id", "src_ip", "country", "kind")


#: Ranges that nest and overlap, of both families; an address takes the innermost.
NESTED = [("10.0.0.0", "10.255.255.255", "A", "private"), ("10.1.0.0", "10.1.255.255", "B", "private"), ("10.1.0.0", "10.1.0.63", "C", "lab"), ("10.1.0.40", "10.2.0.20", "D", "lab"), ("8.0.0.0", "8.255.255.255", "E", "public"),
          ("2001:db8::", "2001:dbf:ffff:ffff:ffff:ffff:ffff:ffff", "F", "six"), ("2001:db8:0:2::", "2001:db8:0:2:ffff:ffff:ffff:ffff", "G", "six"), ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "H", "public")]
#: An address of the events as IPv6: the network from its first octets, the host from its last.
SIX = "concat(CASE WHEN src_ip LIKE '8.%' THEN '2a00:1::' ELSE concat('2001:db8:0:', split_part(src_ip, '.', 2), '::') END, split_part(src_ip, '.', 4))"


@query("d01_nested_ranges", f"""WITH n AS (SELECT event_id, src_ip, {NUMBER} AS x, CAST(split_part(src_ip, '.', 2) AS INT) AS net FROM sec)
 SELECT event_id, src_ip AS address, CASE WHEN starts_with(src_ip, '8.') THEN 'E' WHEN x BETWEEN 167837736 AND 167903252 THEN 'D' WHEN x BETWEEN 167837696 AND 167837759 THEN 'C' WHEN x BETWEEN 167837696 AND 167903231 THEN 'B' ELSE 'A' END AS country FROM n
 UNION ALL SELECT event_id, {SIX}, CASE WHEN starts_with(src_ip, '8.') THEN 'H' WHEN split_part(src_ip, '.', 2) = '2' THEN 'G' ELSE 'F' END FROM sec""")  # fmt: skip
def d01_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Both forms of every source address in a file of ranges that overlap: one row for each event and form."""
    path = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    spark.createDataFrame(NESTED, "first string, last string, country string, kind string").write.option("header", True).csv(path)
    e = security_events(spark, sf).select("event_id", F.explode(F.array(F.col("src_ip"), F.expr(SIX))).alias("address"))
    return joins.geo_lookup(e, reference.load_ranges(spark, path), "address").select("event_id", "address", "country")


@query("e18_geo_summary", GEO + " SELECT coalesce(country, '-') AS country, kind, count(*) AS events, count(DISTINCT src_ip) AS sources FROM g GROUP BY ALL")
def e18(spark: SparkSession, sf: str) -> DataFrame:
    g = joins.geo_lookup(security_events(spark, sf), joins.range_table(spark), "src_ip")
    return g.groupBy(F.coalesce("country", F.lit("-")).alias("country"), "kind").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("src_ip").alias("sources"))


_FEED = ", ".join(str(r) for r in joins.FEED)
INTEL = f"""WITH f(value, threat_type, confidence) AS (VALUES {_FEED}), c AS (SELECT event_id, risk, src_ip AS value, 0 AS pos FROM sec UNION ALL SELECT event_id, risk, dst_ip, 1 FROM sec),
 m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS k FROM c JOIN f USING (value))"""


@query("d02_threat_intel", INTEL + " SELECT event_id, value AS matched, threat_type, CASE WHEN confidence >= 0.9 THEN 'malicious' ELSE 'suspicious' END AS verdict, least(100, risk + CASE WHEN confidence >= 0.9 THEN 45 WHEN confidence >= 0.7 THEN 30 ELSE 15 END) AS risk FROM m WHERE k = 1")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.intel_match(security_events(spark, sf), joins.feed_table(spark), ["src_ip", "dst_ip"], "event_id")
    return out.filter("matched IS NOT NULL").select("event_id", "matched", "threat_type", "verdict", "risk")


@query("d15_reputation", INTEL + " SELECT f.value, f.threat_type, f.confidence, count(c.event_id) AS sightings FROM f LEFT JOIN c USING (value) GROUP BY ALL")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    return joins.reputation(joins.feed_table(spark), security_events(spark, sf), ["src_ip", "dst_ip"], "event_id").filter("confidence IS NOT NULL").select("value", "threat_type", "confidence", "sightings")


@query("d10_latest_name", "SELECT lower(hostname) AS name, max(event_id) AS latest FROM sec GROUP BY 1")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_by_name(security_events(spark, sf), "hostname", "event_id").select("name", F.col("event_id").alias("latest"))


@query("d14_alert_suppression", """WITH a AS (SELECT event_id, src_ip, ts FROM sec WHERE risk >= 90 AND event_type = 'http_request'), o AS (SELECT src_ip, ts, risk >= 97 AS open FROM sec WHERE event_type = 'dns_query' AND risk >= 90)
 SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.src_ip = a.src_ip AND (o.open OR (o.ts <= a.ts AND o.ts >= a.ts - INTERVAL 1 DAY)))""")  # fmt: skip
def d14(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    new = e.filter("risk >= 90 AND event_type = 'http_request'").select("event_id", F.col("src_ip").alias("dedup_key"), F.col("ts").alias("created_at"))
    old = e.filter("event_type = 'dns_query' AND risk >= 90").select(F.col("src_ip").alias("dedup_key"), F.col("ts").alias("created_at"), F.when(F.col("risk") >= 97, "OPEN").otherwise("RESOLVED").alias("status"))
    return joins.unsuppressed(new, old, 86_400).select("event_id")


@query("d16_recommended_actions", "SELECT event_type, CASE event_type WHEN 'auth_failure' THEN 'BLOCK_SRC_1H,ENFORCE_LOCKOUT_MFA,RESET_TARGET_CREDS' WHEN 'firewall_event' THEN 'BLOCK_SCANNER,REVIEW_OPEN_PORTS,ISOLATE_HOST,CAPTURE_FORENSICS,ROTATE_HOST_CREDS' ELSE 'MANUAL_TRIAGE' END AS actions FROM sec GROUP BY event_type")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    kinds = security_events(spark, sf).select("event_type").distinct()
    cat = F.when(F.col("event_type") == "auth_failure", "Brute Force").when(F.col("event_type") == "firewall_event", "Port Scanning, Malware").otherwise("Other")
    return joins.recommended_actions(kinds.withColumn("category", cat), "event_type").select("event_type", F.array_join("actions", ",").alias("actions"))


@query("d05_severity_by_evidence", "SELECT event_id FROM sec s WHERE severity = 'CRITICAL' OR EXISTS (SELECT 1 FROM sec d WHERE d.event_id = s.event_id AND d.status = 'deny' AND d.risk >= 50)")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    return search.by_severity(e, e.filter("status = 'deny' AND risk >= 50").select("event_id"), "CRITICAL").select("event_id")


# Search and listings


@query("a09_scan_events", "SELECT event_id, severity, message FROM sec WHERE severity = 'HIGH' AND (contains(lower(message), 'user1') OR contains(lower(username), 'user1')) ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    f = search.EventFilter(severity="HIGH", text="user1")
    return search.page(search.find(security_events(spark, sf), f), 20, 50).select("event_id", "severity", "message")


@query("j01_substring_search", "SELECT event_id FROM sec WHERE contains(lower(message), 'user14') OR contains(lower(src_ip), 'user14') OR contains(lower(username), 'user14')")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).filter(search.contains("USER14", ["message", "src_ip", "username"])).select("event_id")


@query("j02_phrase_search", "SELECT event_id FROM sec WHERE regexp_matches(lower(message), '(^|[^a-z0-9])from user14([^a-z0-9]|$)')")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).filter(search.phrase("From User14", "message")).select("event_id")


@query("j03_structured_search", "SELECT event_id, epoch_us(ts) AS ts_us, message FROM sec WHERE severity IN ('HIGH', 'CRITICAL') AND event_type IN ('auth_failure', 'auth_success') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 25")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    f = search.EventFilter(severities=("HIGH", "CRITICAL"), auth=True, since="2024-01-10")
    return search.page(search.find(security_events(spark, sf), f), 0, 25).select("event_id", F.unix_micros("ts").alias("ts_us"), "message")


@query("j04_recent_events", "SELECT event_id FROM sec WHERE severity = 'CRITICAL' ORDER BY ts DESC, event_id LIMIT 500")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(search.find(security_events(spark, sf), search.EventFilter(severity="CRITICAL")), 0, 500).select("event_id")


@query("j05_ordered_listing", f"SELECT src_ip, max(risk) AS risk, max({RANK}) AS worst FROM sec GROUP BY src_ip ORDER BY worst DESC, risk DESC, src_ip LIMIT 100")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    g = security_events(spark, sf).groupBy("src_ip").agg(F.max("risk").alias("risk"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    return g.orderBy(F.desc("worst"), F.desc("risk"), "src_ip").limit(100)


@query("j06_top_per_category", "SELECT event_type, src_ip, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, src_ip) AS p FROM (SELECT event_type, src_ip, count(*) AS n FROM sec GROUP BY ALL)) WHERE p <= 5")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    g = security_events(spark, sf).groupBy("event_type", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return reports.top_per_group(g, "event_type", [F.desc("n"), F.col("src_ip")], 5).select("event_type", "src_ip", "n")


@query("j07_union", "SELECT 'auth' AS branch, event_id FROM sec WHERE event_type LIKE 'auth%' UNION ALL SELECT 'web', event_id FROM sec WHERE event_type = 'http_request'")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    a, b = (e.filter(c).select(F.lit(n).alias("branch"), "event_id") for n, c in (("auth", "event_type LIKE 'auth%'"), ("web", "event_type = 'http_request'")))
    return a.unionByName(b)


@query("j08_intersect_except", "SELECT 'both' AS part, u FROM (SELECT username AS u FROM sec WHERE status = 'failure' AND risk > 95 INTERSECT SELECT username FROM sec WHERE status = 'deny' AND risk > 95) UNION ALL SELECT 'first', u FROM (SELECT username AS u FROM sec WHERE status = 'failure' AND risk > 95 EXCEPT SELECT username FROM sec WHERE status = 'deny' AND risk > 95)")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    a, b = (e.filter(f"status = '{s}' AND risk > 95").select(F.col("username").alias("u")) for s in ("failure", "deny"))
    return a.intersect(b).select(F.lit("both").alias("part"), "u").unionByName(a.subtract(b).select(F.lit("first").alias("part"), "u"))


@query("j09_distinct", "SELECT DISTINCT src_ip, username FROM sec")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf).select("src_ip", "username").distinct()


@query("b05_event_ids", "SELECT event_id, substr(sha256(concat(CAST(epoch_us(ts) AS STRING), '|', hostname, '|', event_type, '|', message)), 1, 32) AS dedup_event_id FROM sec")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf)
    return e.select("event_id", search.deterministic_id(F.unix_micros("ts").cast("string"), F.col("hostname"), F.col("event_type"), F.col("message")).alias("dedup_event_id"))


@query("b07_drop_repeats", "SELECT message, hostname, min(event_id) AS event_id FROM sec GROUP BY ALL")
def b07(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf).withColumn("dedup_event_id", search.deterministic_id(F.lit(None).cast("string"), F.col("hostname"), F.lit(""), F.col("message")))
    return search.first_by_id(e, "dedup_event_id", "event_id").select("message", "hostname", "event_id")


@query("b10_parse_coverage", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM sec), 3) AS share FROM sec GROUP BY event_type ORDER BY n DESC, event_type LIMIT 15")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return search.type_shares(security_events(spark, sf), "event_type", 15)


assert COLUMNS
