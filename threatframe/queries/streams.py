"""Queries of streams that keep state between micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedTable
from threatframe.functions.staging import ROWS, shared_dir, staged
from threatframe.operators import alerts, indicators, joins, reports
from threatframe.operators.model_refresh import ForestRefresh
from threatframe.operators.postings import TokenIndex
from threatframe.queries import case_sql, query
from threatframe.queries.detection import _BEST, BRUTE, BRUTE_WIN, DAYS
from threatframe.queries.ingest import REFERENCE, rendered
from threatframe.queries.reports import BASE, windows
from threatframe.sources import reference
from threatframe.sources.security import security_events
from threatframe.streaming import jobs
from threatframe.streaming.custody import Custody
from threatframe.streaming.enrich import Ingest
from threatframe.streaming.refresh import Refresh


def arrivals(spark: SparkSession, sf: str, part: Column, batches: int, files: int = 4) -> DataFrame:
    """The events as a stream of micro-batches: the k-th holds those for which `part` is k, in `files` files."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(batches):
        raw.filter(part == k).repartition(files).write.parquet(f"{path}/part={k}")
    return jobs.files_stream(spark, f"{path}/*", raw.schema, files)


def refreshed(spark: SparkSession, sf: str, batches: int) -> tuple[Refresh, int]:
    """(state, number of the last batch) after the events have come in micro-batches."""
    path = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    state, last = Refresh(spark, path, DAYS, alerts.RULES, joins.feed_table(spark)), [-1]

    def each(batch: DataFrame, number: int, _: str) -> None:
        state.apply(batch, number)
        last[0] = number

    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    files = max(4, -(-rows // (batches * ROWS)))
    jobs.run_each(arrivals(spark, sf, F.col("event_id") % batches, batches, files), "refresh", each)  # every batch has all days and entities
    return state, last[0]


@query("m07_stream_refresh", case_sql.REFRESHED)
def m07(spark: SparkSession, sf: str) -> DataFrame:
    """Detections, incidents, assets, indicators and alerts, kept up to date over three micro-batches, after the last one."""
    state, at = refreshed(spark, sf, 3)
    us, join = F.unix_micros, lambda *c: F.concat_ws("|", *(x if not isinstance(x, str) else F.col(x).cast("string") for x in c))
    row = lambda df, facet, key, *detail: df.select(F.lit(facet).alias("facet"), key.alias("key"), join(*detail).alias("detail"))
    return (
        row(state.detections(at), "detection", join("rule_id", F.array_join("entity", ":")), "value", us("started").cast("string"), us("ended").cast("string"), "risk_score")
        .union(row(state.incidents(at), "incident", F.col("cluster"), "risk_score", "members", "severity", "title"))
        .union(row(state.assets(at), "asset", F.col("name"), F.array_join("services", ","), F.size("ports").cast("string"), us("first_seen").cast("string"), us("last_seen").cast("string"), "max_risk", "events", "asset_type", "criticality"))
        .union(row(state.indicators(at), "indicator", join("value", "type"), "related_events", us("first_seen").cast("string"), us("last_seen").cast("string")))
        .union(row(state.alerts(at), "alert", join("alert_rule", "entity"), "severity", "risk_score", "facts"))
    )


@query("e04_upsert_in_place", "SELECT src_ip AS value, max(epoch_us(ts)) AS seen_at, arg_max(event_id, (ts, event_id)) AS event_id FROM sec GROUP BY src_ip")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    """Newest sightings in a bucketed table: three changes, each of which writes only the buckets of its own addresses; the
    second is made twice."""
    rows = security_events(spark, sf).select(F.col("src_ip").alias("value"), F.unix_micros("ts").alias("seen_at"), "event_id")
    table = KeyedTable(spark, f"{shared_dir(spark)}/sightings-{uuid.uuid4().hex}", "value string, seen_at long, event_id long", ("value",))
    for number, part in enumerate((0, 1, 1, 2)):
        indicators.upsert_into(table, number, rows.filter(F.col("event_id") % 3 == part), "seen_at")
    return table.read(3)


@query("e10_fold_each_job_once", BASE + " SELECT entity_type, entity, attribute, n, round(mean, 6) AS mean, round(std, 5) AS std FROM b")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    """Days folded by their remainder of three, and every even day offered again: the ledger keeps each to one time."""
    w, base = windows(spark, sf), reports.Baselines(spark, f"{shared_dir(spark)}/baselines-{uuid.uuid4().hex}")
    day = F.floor(F.col("job") / 86_400_000_000)
    for number, part in enumerate((day % 3 == 0, day % 3 == 1, day % 2 == 0, day % 3 == 2)):
        base.fold(number, w.filter(part))
    return reports.listing(base.read(3)).select(*reports.BASE_KEYS, "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


#: Ten days a batch, but a third of the events comes one day late and a third two days late.
LATE = "(datediff(ts, DATE '2024-01-01') + event_id % 3) div 10"


@query("m04_stream_followup", BRUTE_WIN + _BEST.format(t=3) + """, f AS (SELECT b.entity, b.n, b.started, b.ts, min(s.ts) AS at FROM best b LEFT JOIN sec s ON s.event_type = 'auth_success' AND s.src_ip = b.entity AND s.ts >= b.ts WHERE k = 1 GROUP BY ALL)
 SELECT f.entity, f.n, epoch_us(f.started) AS started_us, epoch_us(f.ts) AS ended_us, min(s.username) AS followed_by, coalesce(epoch_us(f.at), -1) AS followed_us FROM f LEFT JOIN sec s ON s.event_type = 'auth_success' AND s.src_ip = f.entity AND s.ts = f.at GROUP BY ALL""")  # fmt: skip
def m04f(spark: SparkSession, sf: str) -> DataFrame:
    """The best window of every source, and the login that followed it, from a stream of four batches with late events."""
    found = jobs.run_to_table(jobs.followed_windows(arrivals(spark, sf, F.expr(LATE), 4), BRUTE, "3 days"), "followed")
    return jobs.latest(found).select("entity", F.col("value").alias("n"), "started_us", "ended_us", "followed_by", F.coalesce("followed_us", F.lit(-1)).alias("followed_us"))


def custody(spark: SparkSession, sf: str) -> Custody:
    """The events in five micro-batches: three, then two more after the stream has ended and begun again."""
    path, files = f"{shared_dir(spark)}/custody-{uuid.uuid4().hex}", 3
    raw = spark.read.parquet(f"{sf}/events.parquet")
    chain = Custody(spark, path, "event_id", F.col("message"))
    for parts in ((0, 1, 2), (3, 4)):
        for k in parts:
            raw.filter(F.col("event_id") % 5 == k).repartition(files).write.parquet(f"{path}/arrived/part={k}")
        stream = jobs.files_stream(spark, f"{path}/arrived/*", raw.schema, files)
        jobs.run_each(stream, "custody", lambda batch, number, _: Custody(spark, path, "event_id", F.col("message")).link(batch, number), path)
    return chain


CUSTODY = f"""WITH o AS (SELECT event_id % 5 AS job, sha256(message) AS h, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) - 1 AS n FROM sec), k AS (SELECT job, n // {reports.CHUNK} AS chunk, count(*) AS events, sha256(string_agg(h, '' ORDER BY n)) AS h FROM o GROUP BY ALL),
 d AS (SELECT job, CAST(sum(events) AS BIGINT) AS events, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM k GROUP BY job), p AS (SELECT *, coalesce(lag(digest) OVER (ORDER BY job), repeat('0', 64)) AS prev_hash FROM d)"""


@query("m09_chain_over_restart", CUSTODY + " SELECT job, events, digest, prev_hash, sha256(concat(prev_hash, digest)) AS chain_hash FROM p")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    return custody(spark, sf).links()


@query("m09_changed_batch", "SELECT event_id % 5 AS job, CASE event_id % 5 WHEN 1 THEN 'changed' ELSE 'relinked' END AS fault FROM sec WHERE event_id % 5 IN (1, 2) GROUP BY ALL")
def m09_changed(spark: SparkSession, sf: str) -> DataFrame:
    """One message of the second batch is altered after the stream has gone on."""
    chain = custody(spark, sf)
    rows = chain.rows().filter("batch = 1").drop("batch")
    first = rows.agg(F.min("event_id").alias("_first"))
    altered = rows.crossJoin(F.broadcast(first)).withColumn("message", F.when(F.col("event_id") == F.col("_first"), "altered").otherwise(F.col("message"))).drop("_first")
    staged(altered, "altered").write.mode("overwrite").parquet(f"{chain.path}/rows/batch=1")
    return chain.faults()


def index(spark: SparkSession, sf: str) -> TokenIndex:
    """The messages, indexed in two batches."""
    e, out = security_events(spark, sf), TokenIndex(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    for number in (0, 1):
        out.add(number, e.filter(F.col("event_id") % 2 == number), "event_id", F.col("message"))
    return out


@query("j02_token_search", "SELECT event_id FROM sec WHERE regexp_matches(lower(message), '(^|[^a-z0-9])from user14([^a-z0-9]|$)')")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).phrase("From User14", 1).select(F.col("key").alias("event_id"))


@query("j02_any_token", "SELECT event_id, (regexp_matches(message, '(^|[^a-z0-9])user14([^a-z0-9]|$)')::INT + regexp_matches(message, '(^|[^a-z0-9])error([^a-z0-9]|$)')::INT)::BIGINT AS words FROM sec WHERE words > 0")
def j02_any(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).any_of("error user14", 1).select(F.col("key").alias("event_id"), "words")


#: The feed as it is at first, and from the third batch on.
FEEDS = (joins.FEED, [("8.8.8.20", "scanner", 0.95), ("10.1.0.37", "credential_attack", 0.5)])
_HIT = "CASE WHEN event_id % 3 = 2 THEN CASE src_ip WHEN '8.8.8.20' THEN 0.95 WHEN '10.1.0.37' THEN 0.5 END ELSE coalesce(CASE src_ip WHEN '8.8.8.10' THEN 0.85 WHEN '8.8.8.50' THEN 0.97 WHEN '10.1.0.37' THEN 0.92 END, CASE WHEN event_type = 'firewall_event' AND dst_ip = '192.168.0.7' THEN 0.6 END) END"


@query("m01_stream_enrich", f"""SELECT event_id, event_type, src_ip, CASE WHEN starts_with(src_ip, '8.') THEN 'US' ELSE 'PR' END AS country, CASE WHEN event_type = 'firewall_event' THEN 'private' END AS target,
 CASE WHEN event_type IN ('firewall_event', 'dns_query') THEN 2 ELSE 1 END AS iocs, CASE WHEN {_HIT} >= 0.9 THEN 'malicious' WHEN {_HIT} IS NOT NULL THEN 'suspicious' END AS verdict FROM sec""")  # fmt: skip
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines in three micro-batches, parsed and enriched; the feed's file is another one before the third."""
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    raw = rendered(spark, sf)
    for k in range(3):
        raw.filter(F.col("event_id") % 3 == k).repartition(4).write.parquet(f"{path}/arrived/part={k}")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/arrived/*")
    put = lambda rows: spark.createDataFrame(rows, "value string, threat_type string, confidence double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/feed")
    ingest = Ingest(f"{path}/events", lambda: joins.range_table(spark), lambda: reference.load_feed(spark, f"{path}/feed"), F.lit(REFERENCE).cast("timestamp"))
    put(FEEDS[0])

    def each(batch: DataFrame, number: int, _: str) -> None:
        if number == 2:
            put(FEEDS[1])
        ingest.apply(batch, number)

    jobs.run_each(stream, "ingest", each)
    out = spark.read.parquet(f"{path}/events")
    return out.select("event_id", "event_type", "src_ip", F.col("geo_src.country").alias("country"), F.col("geo_dst.kind").alias("target"), F.size("iocs").alias("iocs"), "verdict")


@query("h03_model_refresh")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    """All events, scored by the newest of three models that were fitted as the events came in; tests hold the samples against
    one pass over the table."""
    e, state = security_events(spark, sf), ForestRefresh(spark, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}")
    for number in range(3):
        state.update(number, e.filter(F.col("event_id") % 3 == number))
    return state.model(2).score_events(e)
