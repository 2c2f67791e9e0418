"""What a job looks like at a glance: cards, facets, counters, indicator lists and reputations over enriched events.

Enriched events have iocs, pii_detected and threat_type beside the columns of the event schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatframe.operators import indicators, reports
from threatframe.sources.security import severity_rank


def enriched(events: DataFrame) -> DataFrame:
    """Adds iocs and pii_detected from whole messages."""
    kinds = F.array_sort(F.array_distinct(F.transform(indicators.personal(F.col("message")), lambda h: h.type)))
    return events.withColumns({"iocs": indicators.iocs(F.col("message")), "pii_detected": kinds})


def cards(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: the plain counts, and different indicators, events with personal data, incidents and those that are new."""
    seen = events.select(F.explode("iocs").alias("i")).agg(F.count_distinct("i.value", "i.type").alias("indicators"))
    own = events.agg(F.count_if(F.size("pii_detected") > 0).alias("personal"))
    cases = incidents.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("status") == "NEW").alias("new_incidents"))
    return reduce(lambda a, b: a.crossJoin(b), (reports.cards(events), seen, own, cases))  # one row each


def facets(events: DataFrame, columns: dict[str, int | None], most_types: int | None = None) -> DataFrame:
    """(facet, key, n): the columns' breakdowns, threat types (without those of events that have none) and indicator types."""
    plain = reports.breakdowns(events, columns)
    threats = reports.breakdowns(events.filter("threat_type <> ''"), {"threat_type": most_types})
    types = reports.breakdowns(events.select(F.explode("iocs").alias("i")).select(F.col("i.type").alias("ioc_type")), {"ioc_type": None})
    return plain.unionByName(threats).unionByName(types)


def counters(events: DataFrame, most: int = 20) -> DataFrame:
    """(fact, key, value): events, those that a format named and those left generic, indicators by type, different indicators,
    events with personal data, personal data by type, and the commonest event types."""
    fallback = F.col("event_type").isNull() | (F.col("event_type") == "generic_event")
    one = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(~fallback).alias("parsed"), F.count_if(fallback).alias("unparsed"), F.count_if(F.size("pii_detected") > 0).alias("personal"))
    single = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), F.lit("").alias("key"), F.col(c).alias("value")) for c in one.columns))).alias("f")).select("f.*")
    found = events.select(F.explode("iocs").alias("i")).select("i.value", "i.type")
    by = lambda df, key, fact: df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(fact).alias("fact"), "key", "value")
    different = found.agg(F.count_distinct("value", "type").alias("value")).select(F.lit("different_iocs").alias("fact"), F.lit("").alias("key"), "value")
    kinds = by(events.select(F.explode("pii_detected").alias("kind")), "kind", "personal_type")
    top = by(events.select(F.coalesce("event_type", F.lit("generic_event")).alias("event_type")), "event_type", "event_type").orderBy(F.desc("value"), "key").limit(most)
    return single.unionByName(by(found, "type", "ioc_type")).unionByName(different).unionByName(kinds).unionByName(top)


def ioc_list(events: DataFrame, job: Column) -> DataFrame:
    """(job, value, type, occurrences, first_seen, last_seen) of every indicator of every type."""
    rows = events.select(job.alias("job"), "ts", F.explode("iocs").alias("i"))
    return rows.groupBy("job", F.col("i.value").alias("value"), F.col("i.type").alias("type")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("i.confidence").alias("confidence"))


def reputations(feed: DataFrame, seen: DataFrame, most: int = 20) -> DataFrame:
    """(value, verdict, threat_type, confidence, related_events, jobs, first_seen, last_seen, sightings) of every value that the
    feed or some job knows, upper and lower case alike.

    seen: rows as of `ioc_list`. Confidence is the feed's, or else that of the newest sighting; 0.9 is malicious, 0.7
    suspicious, less informational. sightings: of the `most` jobs that saw it last, the newest first (jobs counts all).
    """
    last = F.struct("last_seen", "job")
    g = seen.groupBy(F.lower("value").alias("_v")).agg(
        F.sum("occurrences").alias("related_events"), F.count(F.lit(1)).alias("jobs"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("confidence", last).alias("_sure"), F.max_by("value", last).alias("_own"), F.sort_array(F.collect_list(F.struct("last_seen", "job", "occurrences")), asc=False).alias("_all"),
    )
    known = feed.groupBy(F.lower("value").alias("_v")).agg(F.max(F.struct("confidence", "threat_type", "value")).alias("f"))
    j = known.join(g, "_v", "full_outer").withColumn("confidence", F.coalesce("f.confidence", "_sure"))
    verdict = F.when(F.col("confidence") >= 0.9, "malicious").when(F.col("confidence") >= 0.7, "suspicious").otherwise("informational")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.coalesce("f.value", "_own").alias("value"), verdict.alias("verdict"), "f.threat_type", "confidence", n("related_events"), n("jobs"), "first_seen", "last_seen", F.slice("_all", 1, most).alias("sightings"))


def asset_cases(assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Assets with what they were part of: sources (different addresses that an event about them came from), detections and
    incidents (different ones among the entries that name them as source, target or host; upper and lower case alike)."""
    names = F.array_distinct(F.transform(F.array("src_ip", "dst_ip", "hostname"), lambda n: F.lower(F.trim(n))))
    rows = entries.select("cluster", "rule_id", F.array_join("entity", ":").alias("entity"), "src_ip", F.explode(names).alias("_name")).filter("_name <> ''")
    g = rows.groupBy("_name").agg(F.count_distinct("src_ip").alias("sources"), F.count_distinct("rule_id", "entity").alias("detections"), F.count_distinct("cluster").alias("incidents"))
    out = assets.withColumn("_name", F.lower("name")).join(g, "_name", "left").drop("_name")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sources", "detections", "incidents")})


def response_edges(events: DataFrame) -> DataFrame:
    """(kind, source, target, weight, severity) of web requests by the class of their response: web, web_error for 400 to 499,
    web_fault from 500 on. A request without a status code is plain web."""
    code = F.col("status").try_cast("int")
    kind = F.when(code >= 500, "web_fault").when(code >= 400, "web_error").otherwise("web")
    g = events.filter("event_type = 'http_request' AND src_ip IS NOT NULL").groupBy(kind.alias("kind"), F.col("src_ip").alias("source"), F.col("hostname").alias("target"))
    return g.agg(F.count(F.lit(1)).alias("weight"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def typed_nodes(edges: DataFrame, risk: DataFrame, found: DataFrame, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges between them): the `most` riskiest end points (ties by name) with type, risk, whether a detection names
    them, and the rules that do. type: ip, user or host, by the end of the edge at which a node stands (the first of these)."""
    user = F.col("kind") == "login"
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("rank")).union(edges.select("target", F.when(F.col("kind") == "traffic", 0).when(user, 1).otherwise(2)))
    kinds = ends.groupBy("node").agg(F.min("rank").alias("rank"))
    top = risk.groupBy(F.col("src_ip").alias("node")).agg(F.max("risk").alias("risk"))
    named = found.select("rule_id", F.explode("entity").alias("node")).groupBy("node").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    nodes = kinds.join(top, "node", "left").withColumn("risk", F.coalesce("risk", F.lit(0))).orderBy(F.desc("risk"), "node").limit(most)
    nodes = nodes.join(named, "node", "left").select("node", F.element_at(F.array(*map(F.lit, ("ip", "user", "host"))), F.col("rank") + 1).alias("type"), "risk", F.col("rules").isNotNull().alias("flagged"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))
    inside = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    return nodes, inside


def parse_coverage(parsed: DataFrame, file: str = "file") -> DataFrame:
    """(file, lines, named, fallback, formats): of parsed lines, the percent that a format named, the percent left generic, and
    how many different formats occur; file is null for all files together."""
    fallback = F.col("format") == "generic"
    g = parsed.rollup(file).agg(F.count(F.lit(1)).alias("lines"), F.round(100 * F.avg((~fallback).cast("int")), 2).alias("named"), F.round(100 * F.avg(fallback.cast("int")), 2).alias("fallback"), F.count_distinct("format").alias("formats"))
    return g.withColumnRenamed(file, "file")
