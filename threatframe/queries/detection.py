"""Queries of rules, windows, scoring, correlation and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import spread, staged
from threatframe.operators import correlate, rules, scoring
from threatframe.operators.rules import Rule
from threatframe.plans import rulesets
from threatframe.queries import query
from threatframe.sources.security import security_events

BRUTE = Rule("BRUTE_FORCE_001", "Failed logins", "Brute Force", "HIGH", {"event_type": "auth_failure"}, threshold=3, window="1d", then_success=True)
SCAN = Rule("PORT_SCAN_001", "Many ports denied", "Port Scanning", "HIGH", {"event_type": "firewall_event"}, ("deny",), metric="distinct", distinct_field="dst_port", threshold=3, window="3d")
HOSTS = Rule("HOST_SCAN_001", "Many hosts", "Reconnaissance", "MEDIUM", {"event_type": "firewall_event"}, group_by=("username",), metric="distinct", distinct_field="dst_ip", threshold=5, window="5d")
VALUE = Rule("WEB_SQLI_001", "Message pattern", "Web Attack", "CRITICAL", event_types=("http_request",), regex=r"value=1[0-9]{2}$", threshold=2, window="10d", group_by=("src_ip", "username"))
DAYS = [BRUTE, SCAN, HOSTS, VALUE]

_BEST = """, best AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, ts) AS k FROM win WHERE n >= {t})"""
BRUTE_WIN = """WITH win AS (SELECT src_ip AS entity, event_id, ts, count(*) OVER w AS n, min(ts) OVER w AS started FROM sec
 WHERE event_type = 'auth_failure' WINDOW w AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))"""
SCAN_WIN = """WITH win AS (SELECT src_ip AS entity, event_id, ts, count(DISTINCT dst_port) OVER w AS n, min(ts) OVER w AS started FROM sec
 WHERE event_type = 'firewall_event' AND status = 'deny' WINDOW w AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW))"""
HOSTS_WIN = """WITH win AS (SELECT username AS entity, event_id, ts, count(DISTINCT dst_ip) OVER w AS n, min(ts) OVER w AS started FROM sec
 WHERE event_type = 'firewall_event' WINDOW w AS (PARTITION BY username ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW))"""
VALUE_WIN = """WITH win AS (SELECT concat(src_ip, ':', username) AS entity, event_id, ts, count(*) OVER w AS n, min(ts) OVER w AS started FROM sec
 WHERE event_type = 'http_request' AND regexp_matches(message, 'value=1[0-9][0-9]$') WINDOW w AS (PARTITION BY src_ip, username ORDER BY ts RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW))"""
WINS = [(BRUTE, BRUTE_WIN), (SCAN, SCAN_WIN), (HOSTS, HOSTS_WIN), (VALUE, VALUE_WIN)]


def _all_best() -> str:
    """Best windows of all four rules, in SQL."""
    parts = []
    for r, win in WINS:
        body = win.split(" AS (", 1)[1][:-1]
        parts.append(
            f"(SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category, {r.threshold} AS threshold, entity, n, started, ts AS ended "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, ts) AS k FROM ({body}) WHERE n >= {r.threshold}) WHERE k = 1)"
        )
    return "WITH det AS (" + " UNION ALL ".join(parts) + ")"


def shown(df: DataFrame) -> DataFrame:
    """Keys and times as plain columns."""
    return df.select(F.array_join("entity", ":").alias("entity"), F.col("value").alias("n"), F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


@query("e01_rule_groups", "SELECT src_ip AS entity, count(*) AS n FROM sec WHERE event_type = 'firewall_event' AND status IN ('deny', 'blocked', 'block') GROUP BY src_ip")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    groups = rules.grouped(security_events(spark, sf), rulesets.RULES[3])
    return groups.groupBy(F.array_join("entity", ":").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("e02_timeless_rule", "SELECT src_ip AS entity, count(DISTINCT dst_port) AS n FROM sec WHERE event_type = 'firewall_event' AND status = 'deny' GROUP BY src_ip HAVING count(*) >= 3 AND count(DISTINCT dst_port) >= 3")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    events = security_events(spark, sf).withColumn("ts", F.lit(None).cast("timestamp"))
    return shown(rules.timeless(rules.grouped(events, SCAN), SCAN)).select("entity", "n")


@query("f01_sliding_count", BRUTE_WIN + " SELECT entity, event_id, n, epoch_us(started) AS started_us, epoch_us(ts) AS ended_us FROM win WHERE n >= 3")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    rows = rules.sliding(rules.grouped(security_events(spark, sf), BRUTE), BRUTE).filter("value >= 3")
    return rows.select(F.array_join("entity", ":").alias("entity"), "event_id", F.col("value").alias("n"), F.unix_micros("started").alias("started_us"), F.unix_micros("ts").alias("ended_us"))


@query("f02_sliding_distinct", SCAN_WIN + " SELECT entity, event_id, n FROM win WHERE n >= 3")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    rows = rules.sliding(rules.grouped(security_events(spark, sf), SCAN), SCAN).filter("value >= 3")
    return rows.select(F.array_join("entity", ":").alias("entity"), "event_id", F.col("value").alias("n"))


@query("f03_best_window", BRUTE_WIN + _BEST.format(t=3) + """ SELECT b.entity, b.n, epoch_us(b.started) AS started_us, epoch_us(b.ts) AS ended_us, least(50, count(*)) AS evidence, min(e.event_id) AS least_event
 FROM best b JOIN sec e ON e.event_type = 'auth_failure' AND e.src_ip = b.entity AND e.ts BETWEEN b.started AND b.ts WHERE k = 1 GROUP BY ALL""")  # fmt: skip
def f03(spark: SparkSession, sf: str) -> DataFrame:
    df = rules.grouped(security_events(spark, sf), BRUTE)
    hits = rules.with_evidence(rules.best_windows(df, BRUTE), df)
    facts = [F.size("evidence").cast("long").alias("evidence"), F.array_min(F.transform("evidence", lambda e: e.event_id)).alias("least_event")]
    return shown(hits.select("*")).withColumn("_j", F.lit(0)).drop("_j").join(hits.select(F.array_join("entity", ":").alias("entity"), *facts), "entity")


@query("d03_success_followup", BRUTE_WIN + _BEST.format(t=3) + """, f AS (SELECT b.entity, b.n, b.ts, min(s.ts) AS at FROM best b LEFT JOIN sec s ON s.event_type = 'auth_success' AND s.src_ip = b.entity AND s.ts >= b.ts WHERE k = 1 GROUP BY ALL)
 SELECT f.entity, f.n, min(s.username) AS followed_by, coalesce(epoch_us(f.at), -1) AS followed_us FROM f LEFT JOIN sec s ON s.event_type = 'auth_success' AND s.src_ip = f.entity AND s.ts = f.at GROUP BY ALL""")  # fmt: skip
def d03(spark: SparkSession, sf: str) -> DataFrame:
    events = security_events(spark, sf)
    hits = rules.success_followup(rules.best_windows(rules.grouped(events, BRUTE), BRUTE), events)
    return hits.select(F.array_join("entity", ":").alias("entity"), F.col("value").alias("n"), "followed_by", F.coalesce(F.unix_micros("followed_at"), F.lit(-1)).alias("followed_us"))


@query("g01_evaluate_rules", _all_best() + " SELECT rule_id, severity, category, entity, n, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us FROM det")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.evaluate(security_events(spark, sf), DAYS)
    return found.select("rule_id", "severity", "category", F.array_join("entity", ":").alias("entity"), F.col("value").alias("n"), F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


def _look_back(r: Rule) -> str:
    """Firing groups of a rule, with DuckDB's own windows."""
    parts = [f"{c} = {v!r}" for c, v in r.match.items()]
    parts += [f"lower({c}) IN ({', '.join(map(repr, vs))})" for c, vs in (("status", r.statuses), ("event_type", r.event_types)) if vs]
    parts += ["regexp_matches(message, '{}', 'i')".format(r.regex.replace("'", "''"))] if r.regex else []
    n = f"count(DISTINCT {r.distinct_field})" if r.metric == "distinct" else "count(*)"
    keys = ", ".join(r.group_by)
    entity = f"concat_ws(':', {keys})"
    return f"""SELECT '{r.rule_id}' AS rule_id, entity, CAST(max(n) AS BIGINT) AS n FROM (SELECT {entity} AS entity, {n} OVER (PARTITION BY {keys} ORDER BY ts
 RANGE BETWEEN INTERVAL {r.seconds} SECOND PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CAST(NULL AS INT) AS win_event_id, 'app' AS source FROM sec) WHERE {" AND ".join(parts)}) GROUP BY entity HAVING max(n) >= {r.threshold}"""


_NOISE = "concat(message, CASE WHEN event_type = 'http_request' AND risk >= 99 THEN ' GET /?q=1 UNION SELECT x' WHEN event_type = 'http_request' AND risk >= 95 THEN ' GET /../a' WHEN event_type = 'dns_query' AND risk >= 40 THEN concat(' query ', repeat('a', 32), '.example.com') ELSE '' END)"
_BUSY = f"(SELECT * REPLACE (make_timestamp(epoch_us(ts) // 400) AS ts, {_NOISE} AS message) FROM sec)"


@query("g01_shipped_on_busy_events", " UNION ALL ".join(_look_back(r).replace(" FROM sec)", f" FROM {_BUSY})") for r in rulesets.RULES))
def g01_busy(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty shipped rules on the same events in a four-hundredth of the time, some with telling messages."""
    events = security_events(spark, sf).withColumns({"ts": F.expr("timestamp_micros(unix_micros(ts) div 400)"), "message": F.expr(_NOISE), "win_event_id": F.lit(None).cast("int"), "source": F.lit("app")})
    return rules.evaluate(spread(events), rulesets.RULES).select("rule_id", F.array_join("entity", ":").alias("entity"), F.col("value").alias("n"))


@query("g01_shipped_rules", " UNION ALL ".join(_look_back(r) for r in rulesets.RULES))
def g01_shipped(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty shipped rules at their own thresholds and windows, with the largest count of each firing group."""
    events = spread(security_events(spark, sf).withColumns({"win_event_id": F.lit(None).cast("int"), "source": F.lit("app")}))
    return rules.evaluate(events, rulesets.RULES).select("rule_id", F.array_join("entity", ":").alias("entity"), F.col("value").alias("n"))


@query("d13_new_detections", _all_best() + " SELECT rule_id, entity FROM det WHERE NOT (rule_id = 'BRUTE_FORCE_001' AND n >= 4)")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    found = detections(spark, sf)
    known = found.filter("rule_id = 'BRUTE_FORCE_001' AND value >= 4")
    return rules.new_detections(found, known).select("rule_id", F.array_join("entity", ":").alias("entity"))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """The detections of the day-sized rules, written once: later operators read them several times."""
    return staged(rules.evaluate(security_events(spark, sf), DAYS), "detections")


#: The events that a detection d looks at.
MATCH = """((rule_id = 'BRUTE_FORCE_001' AND e.event_type = 'auth_failure' AND e.src_ip = d.entity) OR
   (rule_id = 'PORT_SCAN_001' AND e.event_type = 'firewall_event' AND e.status = 'deny' AND e.src_ip = d.entity) OR
   (rule_id = 'HOST_SCAN_001' AND e.event_type = 'firewall_event' AND e.username = d.entity) OR
   (rule_id = 'WEB_SQLI_001' AND e.event_type = 'http_request' AND regexp_matches(e.message, 'value=1[0-9][0-9]$') AND concat(e.src_ip, ':', e.username) = d.entity))"""
SCORED = _all_best() + f""", sized AS (SELECT d.*, least(50, count(*)) AS evidence, count(DISTINCT e.dst_ip) AS targets FROM det d JOIN sec e ON {MATCH} AND e.ts BETWEEN d.started AND d.ended GROUP BY ALL),
 followed AS (SELECT s.*, s.rule_id = 'BRUTE_FORCE_001' AND EXISTS (SELECT 1 FROM sec e WHERE e.event_type = 'auth_success' AND e.src_ip = s.entity AND e.ts >= s.ended) AS success FROM sized s),
 scored AS (SELECT *, least(100, CASE severity WHEN 'LOW' THEN 5 WHEN 'MEDIUM' THEN 12 WHEN 'HIGH' THEN 20 WHEN 'CRITICAL' THEN 30 ELSE 10 END
   + least(20, (n - threshold) * 3 + 5) + CASE WHEN success THEN 15 ELSE 0 END + least(10, 2 * targets) + least(5, evidence // 5)) AS score FROM followed)"""  # fmt: skip


@query("g02_detection_score", SCORED + " SELECT rule_id, entity, CAST(score AS INT) AS risk_score FROM scored")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_detections(detections(spark, sf)).select("rule_id", F.array_join("entity", ":").alias("entity"), "risk_score")


@query("g06_detection_class", SCORED + """ SELECT rule_id, entity, CASE WHEN severity = 'CRITICAL' OR lower(category) IN ('command execution', 'malware') OR score >= 51 OR severity = 'HIGH' THEN 'MALICIOUS'
  WHEN score >= 21 OR severity = 'MEDIUM' THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS class FROM scored""")  # fmt: skip
def g06(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.classify_detections(scoring.score_detections(detections(spark, sf))).select("rule_id", F.array_join("entity", ":").alias("entity"), F.col("classification").alias("class"))


_PARTS = """, part AS (SELECT rule_id, entity, unnest(string_split(entity, ':')) AS p FROM det),
 link AS (SELECT DISTINCT a.p AS a, b.p AS b FROM part a JOIN part b USING (rule_id, entity)),
 reach AS (SELECT a AS root, a AS node FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node),
 comp AS (SELECT root AS p, min(node) AS cluster FROM reach GROUP BY root)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH det", "WITH RECURSIVE det", 1)


@query("i01_connected_components", "WITH RECURSIVE edge AS (SELECT DISTINCT src_ip AS a, username AS b FROM sec WHERE event_type = 'auth_success' AND risk >= 60), "
 "link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach AS (SELECT a AS root, a AS node FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node) "
 "SELECT root AS node, min(node) AS component FROM reach GROUP BY root")  # fmt: skip
def i01(spark: SparkSession, sf: str) -> DataFrame:
    edges = security_events(spark, sf).filter("event_type = 'auth_success' AND risk >= 60").select(F.col("src_ip").alias("a"), F.col("username").alias("b"))
    return correlate.components(edges).select("node", F.col("label").alias("component"))


@query("i04_communities", "WITH RECURSIVE edge AS (SELECT DISTINCT src_ip AS a, username AS b FROM sec WHERE event_type = 'auth_success' AND risk >= 60), "
 "link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach AS (SELECT a AS root, a AS node FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node), "
 "c AS (SELECT root AS node, min(node) AS label FROM reach GROUP BY root), s AS (SELECT label, count(*) AS size FROM c GROUP BY label) "
 "SELECT label, size, concat('actor-', CAST(row_number() OVER (ORDER BY size DESC, label) AS STRING)) AS name FROM s")  # fmt: skip
def i04(spark: SparkSession, sf: str) -> DataFrame:
    edges = security_events(spark, sf).filter("event_type = 'auth_success' AND risk >= 60").select(F.col("src_ip").alias("a"), F.col("username").alias("b"))
    return correlate.communities(correlate.components(edges))


@query("g04_entity_clusters", _recursive(_all_best() + _PARTS + " SELECT DISTINCT rule_id, entity, cluster FROM part JOIN comp USING (p)"))
def g04(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by shared key parts alone (no login bridges), as the SQL has them."""
    found = correlate.cluster(detections(spark, sf).withColumn("followed_by", F.lit(None).cast("string")))
    return found.select("rule_id", F.array_join("entity", ":").alias("entity"), "cluster")


INCIDENTS = SCORED.replace("WITH det", "WITH RECURSIVE det", 1) + _PARTS + """, bridged AS (SELECT * FROM link),
 member AS (SELECT DISTINCT s.rule_id, s.entity, s.score, s.category, s.success, c.cluster FROM scored s JOIN part USING (rule_id, entity) JOIN comp c USING (p)),
 inc AS (SELECT cluster, least(100, max(score) + CASE WHEN count(DISTINCT category) >= 2 THEN 10 ELSE 0 END + CASE WHEN bool_or(success) THEN 10 ELSE 0 END + CASE WHEN count(*) >= 3 THEN 5 ELSE 0 END) AS risk,
  count(*) AS members, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories, bool_or(success) AS success FROM member GROUP BY cluster)"""  # fmt: skip


@query("g05_build_incidents", INCIDENTS + """ SELECT cluster AS entity, CAST(risk AS INT) AS risk_score, CAST(members AS BIGINT) AS members, categories AS category,
 CASE WHEN risk > 80 THEN 'CRITICAL' WHEN risk > 50 THEN 'HIGH' WHEN risk > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE WHEN categories LIKE '%Brute Force%' THEN 'Brute Force Attack' WHEN categories LIKE '%Port Scanning%' THEN 'Reconnaissance / Port Scan Activity' WHEN categories LIKE '%Reconnaissance%' THEN 'Network Reconnaissance'
  WHEN categories LIKE '%Web Attack%' THEN 'Web Application Attack' ELSE 'Suspicious Activity Cluster' END AS title,
 CASE WHEN (success AND categories LIKE '%Brute Force%') OR risk >= 81 THEN 'MALICIOUS' WHEN risk >= 31 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS class FROM inc""")  # fmt: skip
def g05(spark: SparkSession, sf: str) -> DataFrame:
    inc = correlate.incidents(correlate.cluster(scoring.score_detections(detections(spark, sf)), bridges=False))
    return inc.select(F.col("cluster").alias("entity"), "risk_score", "members", "category", "severity", "title", F.col("classification").alias("class"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf)[0]


def cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(incidents; their entries: all events in the windows of their detections)."""
    members = staged(correlate.cluster(scoring.score_detections(detections(spark, sf))), "members")
    rows = correlate.entries(members, rules.window_events(members, security_events(spark, sf), DAYS))
    return staged(correlate.incidents(members), "incidents"), staged(rows, "entries")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf)[1]


@query("d07_attack_techniques", _all_best() + """ SELECT rule_id, entity, CASE rule_id WHEN 'BRUTE_FORCE_001' THEN 'T1110.001' WHEN 'PORT_SCAN_001' THEN 'T1046' WHEN 'HOST_SCAN_001' THEN 'T1018' ELSE 'T1190' END AS techniques FROM det""")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    out = correlate.with_techniques(detections(spark, sf))
    return out.select("rule_id", F.array_join("entity", ":").alias("entity"), F.array_join(F.transform("techniques", lambda t: t.technique), ",").alias("techniques"))


@query("f06_beacon_cadence", """WITH s AS (SELECT DISTINCT src_ip, epoch_us(ts) AS t FROM sec WHERE event_type = 'dns_query'), g AS (SELECT src_ip, t - lag(t) OVER (PARTITION BY src_ip ORDER BY t) AS gap FROM s)
 SELECT src_ip, count(gap) AS gaps, round(median(gap) / 1000000.0, 3) AS cadence_s FROM g GROUP BY src_ip HAVING count(gap) >= 2""")  # fmt: skip
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.cadence(security_events(spark, sf).filter("event_type = 'dns_query'"), "src_ip").select("src_ip", "gaps", F.round("cadence_s", 3).alias("cadence_s"))
