"""DuckDB SQL of incidents and what is derived from them, as common table expressions that build on one another."""

from __future__ import annotations

from threatframe.operators.alerts import ADVICE
from threatframe.plans.rulesets import TACTICS, TECHNIQUES
from threatframe.queries.detection import DAYS, MATCH, SCORED
from threatframe.queries.reports import ASSETS

_TECH = ", ".join(f"('{r.rule_id}', '{t}', '{tactic}', {TACTICS.index(tactic) + 1})" for r in DAYS for t, tactic in TECHNIQUES[r.rule_id])

#: member: detections with their cluster, login bridges included; inc: incidents; ent: their events, one row each.
CASES = SCORED.replace("WITH det", "WITH RECURSIVE det", 1) + f""",
 bridge AS (SELECT s.entity AS a, arg_min(e.username, (e.ts, e.username)) AS b FROM scored s JOIN sec e ON e.event_type = 'auth_success' AND e.src_ip = s.entity AND e.ts >= s.ended WHERE s.success GROUP BY ALL),
 part AS (SELECT rule_id, entity, unnest(string_split(entity, ':')) AS p FROM det),
 link AS (SELECT a.p AS a, b.p AS b FROM part a JOIN part b USING (rule_id, entity) UNION SELECT a, b FROM bridge UNION SELECT b, a FROM bridge),
 reach AS (SELECT a AS root, a AS node FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node),
 comp AS (SELECT root AS p, min(node) AS cluster FROM reach GROUP BY root),
 member AS (SELECT DISTINCT s.*, c.cluster FROM scored s JOIN part USING (rule_id, entity) JOIN comp c USING (p)),
 base AS (SELECT cluster, CAST(least(100, max(score) + CASE WHEN count(DISTINCT category) >= 2 THEN 10 ELSE 0 END + CASE WHEN bool_or(success) THEN 10 ELSE 0 END + CASE WHEN count(*) >= 3 THEN 5 ELSE 0 END) AS INT) AS risk,
  string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM member GROUP BY cluster),
 inc AS (SELECT *, CASE WHEN risk > 80 THEN 'CRITICAL' WHEN risk > 50 THEN 'HIGH' WHEN risk > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN categories LIKE '%Brute Force%' THEN 'Brute Force Attack' WHEN categories LIKE '%Port Scanning%' THEN 'Reconnaissance / Port Scan Activity' WHEN categories LIKE '%Reconnaissance%' THEN 'Network Reconnaissance'
   WHEN categories LIKE '%Web Attack%' THEN 'Web Application Attack' ELSE 'Suspicious Activity Cluster' END AS title FROM base),
 ent AS (SELECT d.cluster, d.rule_id, d.entity AS det, e.event_id, e.ts, e.src_ip, e.dst_ip, e.hostname FROM member d JOIN sec e ON {MATCH} AND e.ts BETWEEN d.started AND d.ended),
 tech(rule_id, technique, tactic, stage) AS (VALUES {_TECH}),
 tac AS (SELECT * FROM ent JOIN tech USING (rule_id)),
 chain AS (SELECT cluster, string_agg(tactic, ' > ' ORDER BY stage) AS tactics, max(stage) AS stage FROM (SELECT DISTINCT cluster, tactic, stage FROM tac) GROUP BY cluster)"""  # fmt: skip

_ADVICE = "CASE title " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items()) + " ELSE 'Review the evidence.' END"

KILL_CHAIN = CASES + " SELECT cluster, tactics, count(DISTINCT technique) AS techniques, count(*) AS weight, c.stage, round(100.0 * c.stage / 14, 1) AS progress FROM tac JOIN chain c USING (cluster) GROUP BY ALL"
PHASES = CASES + " SELECT cluster, tactic, stage, count(*) AS events, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us FROM tac GROUP BY ALL"
ANNOTATED = CASES + """, f AS (SELECT cluster, split_part(categories, ', ', 1) AS cat, risk // 2 AS half FROM inc), c AS (SELECT event_id, arg_max(cat, (half, cat)) AS cat, max(half) AS half FROM ent JOIN f USING (cluster) GROUP BY event_id)
 SELECT event_id, cat AS threat_type, greatest(risk, half) AS risk FROM c JOIN sec USING (event_id)"""
_SHOWN = """, ev AS (SELECT cluster, rule_id, event_id, ts, row_number() OVER (PARTITION BY rule_id, det ORDER BY ts, event_id) AS k FROM ent),
 tl AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ts, rule_id, event_id) AS p FROM ev WHERE k <= 50)"""
TIMELINE = CASES + _SHOWN + " SELECT cluster, CAST(p - 1 AS INT) AS place, rule_id, event_id, epoch_us(ts) AS ts_us FROM tl WHERE p <= 200"
REPORTS = CASES + _SHOWN + f" SELECT cluster, title, severity, round(least(0.99, 0.5 + risk / 200.0), 4) AS confidence, CAST(least(10, (SELECT count(*) FROM tl WHERE tl.cluster = inc.cluster)) AS INT) AS evidence, {_ADVICE} AS recommendation FROM inc"
NARRATIVE = CASES + f""", n AS (SELECT cluster, count(*) AS n, (max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000)) // 60 AS span FROM ent GROUP BY cluster)
 SELECT cluster, printf('%s around %s: %d events in %d minutes, risk %d (%s). It reached: %s. %s', title, cluster, n, span, risk, severity, tactics, {_ADVICE}) AS text FROM inc JOIN n USING (cluster) JOIN chain USING (cluster)"""

_TOUCHED = ", " + ASSETS.removeprefix("WITH ") + """, touched AS (SELECT DISTINCT x.cluster, a.name, a.asset_type, a.criticality FROM (SELECT cluster, unnest([src_ip, dst_ip, hostname]) AS n FROM ent UNION SELECT cluster, cluster FROM ent) x JOIN a ON lower(a.name) = lower(x.n))"""
INCIDENT_ASSETS = CASES + _TOUCHED + " SELECT * FROM touched"
EVIDENCE_MAP = CASES + " SELECT DISTINCT event_id, src_ip, dst_ip, CASE WHEN starts_with(src_ip, '8.8.8.') THEN 'US' END AS country, 0 AS iocs FROM ent"
_RAISED = """SELECT 'ALERT_BRUTE_FORCE' AS alert_rule, 'HIGH' AS severity, entity, max(score)::INT AS risk_score, count(*) AS facts FROM scored WHERE rule_id = 'BRUTE_FORCE_001' GROUP BY entity
 UNION ALL SELECT 'ALERT_SQL_INJECTION', 'HIGH', entity, max(score)::INT, count(*) FROM scored WHERE rule_id = 'WEB_SQLI_001' GROUP BY entity
 UNION ALL SELECT 'ALERT_CRITICAL_INCIDENT', 'CRITICAL', cluster, risk, 1 FROM inc WHERE risk >= 80 UNION ALL SELECT 'ALERT_HIGH_INCIDENT', 'HIGH', cluster, risk, 1 FROM inc WHERE risk >= 51
 UNION ALL SELECT 'ALERT_ASSET_WEB_ATTACK', 'HIGH', cluster, risk, 1 FROM inc WHERE risk >= 40 AND cluster IN (SELECT cluster FROM touched WHERE asset_type = 'web')
 UNION ALL SELECT 'ALERT_CRITICAL_ASSET_INCIDENT', 'HIGH', cluster, risk, 1 FROM inc WHERE risk >= 45 AND cluster IN (SELECT cluster FROM touched WHERE criticality = 'CRITICAL')
 UNION ALL SELECT 'ALERT_HIGH_CONF_IOC', 'HIGH', v, 0, 1 FROM (SELECT src_ip AS v FROM sec UNION SELECT dst_ip FROM sec)"""
ALERTS = CASES + _TOUCHED + f" {_RAISED}"

#: All that a refresh keeps, as (facet, key, detail).
REFRESHED = CASES + _TOUCHED + f""", raised AS ({_RAISED}), members AS (SELECT cluster, count(*) AS n FROM member GROUP BY cluster), seen AS (SELECT v, count(*) AS n, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM (SELECT src_ip AS v, ts FROM sec UNION ALL SELECT dst_ip, ts FROM sec) GROUP BY v)
 SELECT 'detection' AS facet, concat_ws('|', rule_id, entity) AS key, concat_ws('|', n, epoch_us(started), epoch_us(ended), score) AS detail FROM scored
 UNION ALL SELECT 'incident', cluster, concat_ws('|', risk, n, severity, title) FROM inc JOIN members USING (cluster)
 UNION ALL SELECT 'asset', name, concat_ws('|', coalesce(services, ''), ports, epoch_us(first_seen), epoch_us(last_seen), max_risk, events, asset_type, criticality) FROM a
 UNION ALL SELECT 'indicator', concat(v, '|ipv4'), concat_ws('|', n, f, l) FROM seen
 UNION ALL SELECT 'alert', concat_ws('|', alert_rule, entity), concat_ws('|', severity, risk_score, facts) FROM raised"""

#: vec: signals of incidents; the messages of the view hold no indicators. lk: linked pairs. act: actors.
_VECTORS = """, vec AS (SELECT DISTINCT cluster, 'technique' AS signal, technique AS value, CAST(1.5 AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS seconds FROM tac
 UNION SELECT cluster, 'geo', 'US', 0.5, NULL FROM (SELECT cluster, src_ip AS v FROM ent UNION SELECT cluster, dst_ip FROM ent UNION SELECT cluster, cluster FROM ent) WHERE starts_with(v, '8.8.8.')
 UNION SELECT cluster, 'cadence', '', 1.0, median(gap) / 1000000.0 FROM (SELECT cluster, t - lag(t) OVER (PARTITION BY cluster ORDER BY t) AS gap FROM (SELECT DISTINCT cluster, epoch_us(ts) AS t FROM ent)) GROUP BY cluster HAVING count(gap) >= 2)"""
SIGNALS = CASES + _VECTORS + " SELECT cluster, signal, value, weight, round(coalesce(seconds, -1), 3) AS seconds FROM vec"
_LINKS = _VECTORS + """, same AS (SELECT a.cluster AS l, b.cluster AS r, a.signal, a.value, a.weight FROM vec a JOIN vec b ON a.signal = b.signal AND a.cluster < b.cluster AND CASE WHEN a.signal = 'cadence' THEN greatest(a.seconds, b.seconds) <= greatest(3.0, 1.25 * least(a.seconds, b.seconds)) ELSE a.value = b.value END),
 tot AS (SELECT cluster, sum(weight) AS total FROM vec GROUP BY cluster), sh AS (SELECT l, r, sum(weight) AS shared FROM same GROUP BY ALL),
 lk AS (SELECT l, r, shared, least(1.0, shared / greatest(1.0, least(x.total, y.total))) AS sure FROM sh JOIN tot x ON x.cluster = l JOIN tot y ON y.cluster = r WHERE sure >= 0.5)"""
LINKS = CASES + _LINKS + ' SELECT l AS "left", r AS "right", shared, round(sure, 4) AS confidence FROM lk'
_ACTORS = _LINKS + """, near AS (SELECT l AS a, r AS b FROM lk UNION SELECT r, l FROM lk UNION SELECT cluster, cluster FROM inc),
 far AS (SELECT a AS root, a AS node FROM near UNION SELECT f.root, n.b FROM far f JOIN near n ON n.a = f.node), com AS (SELECT root AS cluster, min(node) AS label FROM far GROUP BY root),
 act AS (SELECT cluster, actor FROM com JOIN (SELECT label, concat('actor-', CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS STRING)) AS actor FROM com GROUP BY label) USING (label))"""
GRAPH = CASES + _ACTORS + """ SELECT 'node' AS part, 'incident' AS kind, count(*) AS n FROM inc UNION ALL SELECT 'node', signal, count(DISTINCT concat(value, coalesce(CAST(seconds AS STRING), ''))) FROM vec GROUP BY signal
 UNION ALL SELECT 'node', 'actor', count(DISTINCT actor) FROM act UNION ALL SELECT 'edge', concat('has_', signal), count(*) FROM vec GROUP BY signal UNION ALL SELECT 'edge', 'member', count(*) FROM act"""
POSTURE = CASES + _ACTORS + """, own AS (SELECT actor, avg(round(sure, 4)) AS sure FROM lk JOIN act ON act.cluster = l GROUP BY actor),
 re AS (SELECT actor, count(DISTINCT CASE WHEN signal = 'technique' THEN value END) AS techs, count(*) FILTER (signal = 'geo') AS geo, count(*) FILTER (signal = 'cadence') AS beats FROM same JOIN lk USING (l, r) JOIN act ON act.cluster = l GROUP BY actor),
 gr AS (SELECT actor, count(*) AS incidents, 6 * count(*) FILTER (severity = 'CRITICAL') + 3 * count(*) FILTER (severity = 'HIGH') AS sev, sum(least(20, 2 * coalesce(c.stage, 0))) AS stage, max(risk) AS top_risk FROM inc JOIN act USING (cluster) LEFT JOIN chain c USING (cluster) GROUP BY actor),
 po AS (SELECT actor, incidents, round(coalesce(sure, 0), 3) AS confidence, top_risk, 3 * coalesce(techs, 0) AS t, CASE WHEN geo > 0 THEN 4 ELSE 0 END AS g, CASE WHEN beats > 0 THEN 4 ELSE 0 END AS b, sev, stage FROM gr LEFT JOIN own USING (actor) LEFT JOIN re USING (actor))
 SELECT actor, incidents, confidence, top_risk, CAST(least(100, 15 + t + g + b + sev + stage) AS INT) AS posture, concat('base +15, reuse +0, feed +0, technique +', t, ', geo +', g, ', cadence +', b, ', severity +', sev, ', stage +', stage) AS breakdown FROM po"""
