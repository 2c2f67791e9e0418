"""Queries of the ingest job, sinks, anomaly scores and streams; log lines are rendered from the security view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import shared_dir, spread, staged
from threatframe.operators import anomaly, indicators, joins, normalize, quality, reports, rules, scoring
from threatframe.operators.rules import Rule
from threatframe.queries import query
from threatframe.queries.detection import BRUTE, entries
from threatframe.sinks import writers
from threatframe.sources import formats
from threatframe.sources.security import security_events
from threatframe.streaming import jobs

REFERENCE = "2024-03-01"


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """One log line per event: ssh logins as syslog, traffic as key=value, requests as combined, lookups as DNS lines."""
    e = security_events(spark, sf)
    stamp = F.date_format("ts", "MMM dd HH:mm:ss")
    login = lambda verb: F.concat(stamp, F.lit(" "), "hostname", F.lit(f" sshd[7]: {verb} password for "), "username", F.lit(" from "), "src_ip", F.lit(" port 2200 ssh2"))
    kv = F.concat(F.lit("SRC="), "src_ip", F.lit(" DST="), "dst_ip", F.lit(" PROTO=TCP DPT="), F.col("dst_port").cast("string"), F.lit(" ACTION="), "status")
    web = F.concat("src_ip", F.lit(" - "), "username", F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p'), F.col("dst_port").cast("string"), F.lit(' HTTP/1.1" '), F.when(F.col("risk") >= 60, "404").otherwise("200"), F.lit(' 512 "-" "agent"'))
    dns = F.concat(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" client "), "src_ip", F.lit("#5353: query: "), "username", F.lit(".example.com IN A"))
    line = F.when(F.col("event_type") == "auth_failure", login("Failed")).when(F.col("event_type") == "auth_success", login("Accepted")).when(F.col("event_type") == "http_request", web).when(F.col("event_type") == "dns_query", dns).otherwise(kv)
    return spread(e.select("event_id", F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("b01_detect_formats", "SELECT event_type AS file, CASE event_type WHEN 'http_request' THEN 'apache' WHEN 'dns_query' THEN 'dns' WHEN 'firewall_event' THEN 'firewall' ELSE 'syslog' END AS format, CAST(1.0 AS DOUBLE) AS confidence, least(300, count(*)) AS lines FROM sec GROUP BY event_type")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    return formats.detect_formats(rendered(spark, sf))


PARSED = """SELECT event_id, event_type, src_ip, CASE WHEN event_type = 'firewall_event' THEN dst_ip END AS dst_ip, CASE WHEN event_type = 'firewall_event' THEN dst_port ELSE -1 END AS dst_port,
 CASE WHEN event_type IN ('auth_failure', 'auth_success', 'http_request') THEN username END AS username,
 CASE event_type WHEN 'auth_failure' THEN 'failure' WHEN 'auth_success' THEN 'success' WHEN 'http_request' THEN CASE WHEN risk >= 60 THEN '404' ELSE '200' END WHEN 'firewall_event' THEN status END AS status"""  # fmt: skip


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    raw = rendered(spark, sf)
    return formats.parsed(raw, "line")


@query("b02_parse_normalize", PARSED + ", CASE WHEN event_type IN ('auth_failure', 'auth_success', 'http_request') THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS ts_us FROM sec")
def b02(spark: SparkSession, sf: str) -> DataFrame:
    out = normalize.normalize(parsed(spark, sf), F.lit(REFERENCE).cast("timestamp"))
    us = F.when(F.col("event_type").isin("auth_failure", "auth_success", "http_request"), F.unix_micros("ts")).otherwise(-1)
    return out.select("event_id", "event_type", "src_ip", "dst_ip", F.coalesce("dst_port", F.lit(-1)).alias("dst_port"), "username", "status", us.alias("ts_us"))


@query("b03_mapped_fields", "SELECT event_type, count(*) AS n, count(*) FILTER (event_type IN ('auth_failure', 'auth_success')) AS with_host FROM sec GROUP BY event_type")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    out = normalize.normalize(parsed(spark, sf), F.lit(REFERENCE).cast("timestamp"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.map_contains_key("mappings", "hostname")).alias("with_host"))


@query("b04_timestamps", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS iso_us, epoch_us(date_trunc('second', ts)) AS epoch_us, epoch_us(date_trunc('second', ts)) AS clf_us, epoch_us(date_trunc('second', ts)) AS yearless_us FROM sec")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.lit(REFERENCE).cast("timestamp")
    at = lambda c: F.unix_micros(normalize.parse_timestamp(c, ref))
    forms = {
        "iso_us": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "epoch_us": F.unix_seconds("ts").cast("string"),
        "clf_us": F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"), "yearless_us": F.date_format("ts", "MMM d HH:mm:ss"),
    }
    forms["clf_us"] = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    return security_events(spark, sf).select("event_id", *(at(c).alias(k) for k, c in forms.items()))


@query("b06_backfill_ids", "SELECT count(*) AS n, count(*) AS filled, count(*) AS same FROM sec")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    raw = rendered(spark, sf)
    full = normalize.normalize(formats.parsed(raw, "line"), F.lit(REFERENCE).cast("timestamp"))
    full = full.withColumn("_want", F.col("dedup_event_id")).withColumn("dedup_event_id", F.when(F.col("event_id") % 2 == 0, F.col("dedup_event_id")))
    out = normalize.backfilled_ids(full.drop("line"), raw.select("file", "line_no", "line"), ["file", "line_no"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("dedup_event_id").alias("filled"), F.count_if(F.col("dedup_event_id") == F.col("_want")).alias("same"))


@query("b11_trial_parse", "SELECT format, count(*) AS n FROM (SELECT CASE event_type WHEN 'http_request' THEN 'apache' WHEN 'dns_query' THEN 'dns' WHEN 'firewall_event' THEN 'firewall' ELSE 'syslog' END AS format FROM sec) GROUP BY format")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is offered to a wrong format first and falls through to its own."""
    raw = rendered(spark, sf).withColumn("wrong", F.lit("suricata"))
    return formats.parsed(raw, "line", "wrong").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("e28_format_accuracy", "SELECT event_type AS label, count(*) AS n, CAST(1.0 AS DOUBLE) AS \"right\" FROM sec GROUP BY event_type")
def e28(spark: SparkSession, sf: str) -> DataFrame:
    truth = security_events(spark, sf).select("event_id", "event_type")
    return quality.agreement(parsed(spark, sf).select("event_id", "event_type"), truth, "event_id", "event_type")


@query("n01_user_format", "SELECT count(*) AS n, count(DISTINCT username) AS users FROM sec")
def n01(spark: SparkSession, sf: str) -> DataFrame:
    formats.register_format("arrows", lambda line: line.rlike("^>> [^ ]+ @ [^ ]+$"), lambda line: {"event_type": F.lit("arrow_event"), "username": formats.group(line, "^>> ([^ ]+) @", 1), "src_ip": formats.group(line, "@ (.+)$", 1)})
    try:
        raw = security_events(spark, sf).select(F.concat(F.lit(">> "), "username", F.lit(" @ "), "src_ip").alias("line"))
        out = formats.parsed(raw, "line").filter("format = 'arrows'")
        return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("username").alias("users"))
    finally:
        formats.unregister_format("arrows")


@query("n02_rule_as_data", "SELECT src_ip AS entity, count(*) AS n FROM sec WHERE status = 'deny' AND lower(event_type) IN ('firewall_event') GROUP BY src_ip HAVING count(*) >= 1")
def n02(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.parse_rules([{"rule_id": "USER_1", "match": {"status": "deny"}, "event_types": ["Firewall_Event"], "group_by": ["source_ip"], "threshold": 1, "window": "400d"}, {"rule_id": "BAD", "window": "soon"}])
    (rule,) = found
    return rules.best_windows(rules.grouped(security_events(spark, sf), rule), rule).select(F.element_at("entity", 1).alias("entity"), F.col("value").alias("n"))


@query("d04_raw_and_normalized", """SELECT event_id, event_type, src_ip, CASE event_type WHEN 'auth_failure' THEN 'Failed' WHEN 'auth_success' THEN 'Accepted' WHEN 'http_request' THEN 'GET' WHEN 'dns_query' THEN 'query:' ELSE 'SRC=' END AS word, true AS named FROM sec""")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized events with the raw lines that they were read from."""
    raw = rendered(spark, sf)
    events = normalize.normalize(formats.parsed(raw, "line"), F.lit(REFERENCE).cast("timestamp")).select("event_id", "file", "line_no", "event_type", "src_ip")
    j = normalize.with_raw(events, raw, ["file", "line_no"])
    return j.select("event_id", "event_type", "src_ip", F.regexp_extract("raw", "(Failed|Accepted|GET|query:|SRC=)", 1).alias("word"), F.contains("raw", "src_ip").alias("named"))


@query("g03_normalize_category", "SELECT event_type, CASE event_type WHEN 'auth_failure' THEN 'Brute Force' WHEN 'firewall_event' THEN 'Port Scanning' ELSE 'Unknown' END AS category, count(*) AS n FROM sec GROUP BY event_type")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "auth_failure", " brute FORCE ").when(F.col("event_type") == "firewall_event", "port scanning").otherwise(F.col("event_type"))
    return security_events(spark, sf).groupBy("event_type", scoring.normalize_category(raw).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("g08_false_positive_feedback", "SELECT src_ip, least(100, max(risk)) AS before, CASE WHEN max(event_id) % 2 = 0 THEN greatest(1, CAST(floor(max(risk) / 2) AS INT)) ELSE max(risk) END AS risk_score FROM sec GROUP BY src_ip")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    g = security_events(spark, sf).groupBy("src_ip").agg(F.max("risk").alias("risk_score"), F.max("event_id").alias("m")).withColumns({"before": F.col("risk_score"), "reasons": F.array().cast("array<string>")})
    status = g.filter("m % 2 = 0").select("src_ip", F.lit("FALSE_POSITIVE").alias("status"))
    return scoring.halve_false_positives(g, status, "src_ip").select("src_ip", "before", "risk_score")


_TEXT = "concat(message, ' at ', CASE WHEN risk >= 60 THEN src_ip ELSE 'user@example.com' END)"
_KIND = "CASE WHEN starts_with({0}, '10.') OR starts_with({0}, '192.168.') THEN 2.0 ELSE 3.0 END"
_CODES = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}_code" for c in anomaly.CATEGORIES)
VECTORS = f"""SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS weekday, CAST(length({_TEXT}) AS DOUBLE) AS msg_len, CAST(src_port AS DOUBLE) AS src_port, CAST(dst_port AS DOUBLE) AS dst_port,
 CASE WHEN risk >= 60 THEN 1.0::DOUBLE ELSE 0.0 END AS ioc_count, CASE WHEN risk >= 60 THEN 0.0::DOUBLE ELSE 1.0 END AS pii_count, CAST(risk AS DOUBLE) AS risk, CAST(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) AS DOUBLE) AS severity, 0.0::DOUBLE AS suspicious,
 CASE WHEN src_ip IN ({", ".join(repr(v) for v, *_ in joins.FEED)}) OR dst_ip IN ({", ".join(repr(v) for v, *_ in joins.FEED)}) THEN 1.0::DOUBLE ELSE 0.0 END AS intel_match, CAST({_KIND.format("src_ip")} AS DOUBLE) AS geo_src_kind, CAST({_KIND.format("dst_ip")} AS DOUBLE) AS geo_dst_kind, {_CODES} FROM sec"""


def told(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose messages also name their source, or a person."""
    return spread(security_events(spark, sf).withColumn("message", F.expr(_TEXT)))


@query("h01_feature_vectors", VECTORS)
def h01(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.vectors(told(spark, sf))


@query("h03_score_new_events")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted once, stored, loaded and applied to events; in the tests its scores equal those of the batch."""
    import uuid

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    anomaly.fit_model(security_events(spark, sf)).save(spark, path)
    return anomaly.Model.load(spark, path).score_events(security_events(spark, sf))


_Z = ", ".join(f"CASE WHEN stddev_pop({f}) OVER () > 1e-9 THEN round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 6) ELSE 0 END AS {f}" for f in anomaly.FEATURES)
REASONS = f"""WITH v AS MATERIALIZED ({VECTORS}), z AS (SELECT event_id, {_Z} FROM v), l AS (SELECT event_id, unnest([{", ".join(map(repr, anomaly.FEATURES))}]) AS f, unnest([{", ".join(anomaly.FEATURES)}]) AS z, unnest(range({len(anomaly.FEATURES)})) AS k FROM z),
 p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -abs(z), k) AS place FROM l) SELECT event_id, coalesce(string_agg(concat(f, CASE WHEN z > 0 THEN ' above usual' ELSE ' below usual' END), ', ' ORDER BY place) FILTER (place <= 3 AND z <> 0), '') AS reasons FROM p GROUP BY event_id"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    v = staged(anomaly.vectors(spread(security_events(spark, sf))), "vectors")
    return anomaly.scaled(anomaly.score(v, anomaly.fit(v)))


@query("h02_isolation_forest")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)


@query("e31_anomaly_summary")
def e31(spark: SparkSession, sf: str) -> DataFrame:
    s = staged(scored(spark, sf), "anomalies")
    top = s.orderBy(F.desc("score"), "event_id").limit(20).select(F.lit("top").alias("fact"), F.col("event_id").cast("string").alias("key"), "score")
    one = s.agg(F.count_if("anomalous").cast("double").alias("score")).select(F.lit("anomalous").alias("fact"), F.lit("").alias("key"), "score")
    return one.unionByName(top)


@query("d08_evidence_scores")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    return joins.scores_of_evidence(entries(spark, sf), scored(spark, sf))


@query("e25_rules_and_model")
def e25(spark: SparkSession, sf: str) -> DataFrame:
    cited = entries(spark, sf).select("event_id").distinct().withColumn("rules", F.lit(True))
    odd = scored(spark, sf).filter("anomalous").select("event_id").withColumn("model", F.lit(True))
    j = cited.join(odd, "event_id", "full_outer")
    return j.agg(F.count_if(F.col("model").isNull()).alias("rules_only"), F.count_if(F.col("rules").isNull()).alias("model_only"), F.count_if(F.col("model") & F.col("rules")).alias("both"))


@query("f08_top_reasons", REASONS)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.reasons(staged(anomaly.vectors(told(spark, sf)), "vectors"))


def _sink(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        import uuid

        path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
        writers.write(security_events(spark, sf), path, kind)
        back = spark.read.text(path)
        return writers.invalid(back, kind).withColumn("kind", F.lit(kind))

    return run


for _kind, _id in (("cef", "k04"), ("leef", "k05"), ("syslog", "k07"), ("ecs", "k08"), ("ocsf", "k09")):
    query(f"{_id}_{_kind}_sink", f"SELECT count(*) AS lines, CAST(0 AS BIGINT) AS faults, '{_kind}' AS kind FROM sec")(_sink(_kind))


def _table_sink(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        import uuid

        path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
        e = security_events(spark, sf).withColumn("job_id", F.date_format("ts", "yyyyMMdd"))
        writers.write(e, path, kind)
        back = {"parquet": lambda: spark.read.parquet(path), "json": lambda: spark.read.json(path), "csv": lambda: spark.read.option("header", True).csv(path)}[kind]()
        return back.groupBy(F.col("job_id").cast("string").alias("job_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message").alias("messages"))

    return run


for _kind, _id in (("parquet", "k01"), ("json", "k02"), ("csv", "k03")):
    query(f"{_id}_{_kind}_sink", "SELECT strftime(ts, '%Y%m%d') AS job_id, count(*) AS n, count(DISTINCT message) AS messages FROM sec GROUP BY 1")(_table_sink(_kind))


@query("k06_stix_indicators", "SELECT DISTINCT src_ip AS value, concat('[ipv4-addr:value = ''', src_ip, ''']') AS pattern FROM sec")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    rows = security_events(spark, sf).select(F.col("src_ip").alias("value")).distinct().withColumn("type", F.lit("ipv4"))
    return rows.select("value", F.get_json_object(writers.stix(rows), "$.pattern").alias("pattern"))


@query("m01_stream_ingest", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM sec")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_to_table(jobs.events_stream(spark, sf).withColumn("pii_detected", F.transform(indicators.personal(F.col("message")), lambda h: h.type)), "ingest")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("m02_stream_once", "SELECT event_id, 1::BIGINT AS n FROM sec")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives twice and is written once."""
    twice = jobs.events_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_to_table(jobs.once(twice, "event_id"), "once").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


#: Windows are given out when the watermark, the latest stamp in milliseconds less the delay, has reached their end.
_MARK = "(SELECT (max(epoch_us(ts)) // 1000) * 1000 FROM sec)"


@query("m03_stream_window_rule", f"""WITH f AS (SELECT src_ip AS entity, (epoch_us(ts) // 43200000000 - k) * 43200000000 AS s FROM sec, (VALUES (0), (1)) v(k) WHERE event_type = 'auth_failure')
 SELECT entity, s AS started_us, s + 86400000000 AS ended_us, count(*) AS value FROM f WHERE s + 86400000000 <= {_MARK} - 86400000000 GROUP BY ALL HAVING count(*) >= 3""")  # fmt: skip
def m03(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_to_table(jobs.window_rule(jobs.events_stream(spark, sf), BRUTE, "12 hours"), "window")
    return out.select("entity", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "value")


M04 = """WITH w AS (SELECT src_ip AS entity, epoch_us(ts) AS at_us, count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS value FROM sec WHERE event_type = 'auth_failure')
 SELECT entity, at_us, value FROM w WHERE value >= 3"""


@query("m04_stream_look_back", M04)
def m04(spark: SparkSession, sf: str) -> DataFrame:
    rule = Rule("B", match={"event_type": "auth_failure"}, threshold=3, window="1d")
    return jobs.run_to_table(jobs.look_back(jobs.events_stream(spark, sf), rule), "look-back")


@query("m05_stream_minutes", f"SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM sec GROUP BY 1 HAVING minute_us + 60000000 <= {_MARK} - 600000000")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_to_table(jobs.minutes(jobs.events_stream(spark, sf)), "minutes").select(F.unix_micros("minute").alias("minute_us"), "n")


@query("m06_sessions", f"""WITH g AS (SELECT username, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY username ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM sec),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY username ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT username, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 21600000000 AS ended_us, count(*) AS n FROM s GROUP BY username, k HAVING ended_us <= {_MARK} - 86400000000""")  # fmt: skip
def m06(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the stream that the watermark has closed."""
    out = jobs.run_to_table(jobs.sessions(jobs.events_stream(spark, sf), "username", "6 hours"), "sessions")
    return out.select("username", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


@query("m08_late_rows", """WITH c AS (SELECT ts, event_id % 3 AS k FROM sec), m AS (SELECT k, max(epoch_us(ts)) AS top FROM c GROUP BY k), l AS (SELECT k, coalesce(epoch_us(ts) < (SELECT max(top) FROM m WHERE m.k < c.k) - 86400000000, false) AS late FROM c)
 SELECT k AS batch, count(*) FILTER (late) AS late, count(*) AS n FROM l GROUP BY k""")  # fmt: skip
def m08(spark: SparkSession, sf: str) -> DataFrame:
    """The table arrives in three files, one after another; rows a day older than what came before are set aside."""
    import uuid

    src = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        raw.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{src}/part={k}")
    out = jobs.run_late(jobs.files_stream(spark, f"{src}/*", raw.schema), 86_400_000_000, "late")
    return out.select(F.col("event_id") % 3, "late").toDF("batch", "late").groupBy("batch").agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("n"))


CHAIN = f"""WITH o AS (SELECT sha256(message) AS h, event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM sec), k AS (SELECT n // {reports.CHUNK} AS chunk, count(*) AS events, sha256(string_agg(h, '' ORDER BY n)) AS h FROM o GROUP BY 1),
 d AS (SELECT 0::BIGINT AS job, CAST(sum(events) AS BIGINT) AS events, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM k) SELECT job, events, digest, repeat('0', 64) AS prev_hash, sha256(concat(repeat('0', 64), digest)) AS chain_hash FROM d"""


@query("m09_stream_chain", CHAIN)
def m09(spark: SparkSession, sf: str) -> DataFrame:
    """A chain-of-custody link for every micro-batch."""
    link = lambda df, k, path: reports.batch_digests(df, F.lit(k).cast("long"), "event_id", F.col("message")).write.mode("overwrite").parquet(f"{path}/links/batch={k}")
    out = jobs.run_each(jobs.events_stream(spark, sf), "chain", link)
    return reports.chained(spark.read.parquet(f"{out}/links").select("job", "events", "digest"))
