"""Alerts from detections, incidents and indicators; narratives, reports, the knowledge graph and actor groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatframe.functions.staging import staged
from threatframe.operators import correlate, indicators
from threatframe.operators.scoring import lookup
from threatframe.sources.security import SEVERITIES, severity_rank


@dataclass(frozen=True)
class AlertRule:
    rule_id: str
    source: str  #: detection, incident or ioc
    severity: str = "HIGH"
    match_rule: str | None = None
    match_category: str | None = None
    min_risk: int = 0
    min_confidence: float = 0.0
    threshold: int = 1
    asset_type: str | None = None  #: an incident must touch an asset of this type
    min_criticality: str | None = None  #: and one of this criticality at least


#: The shipped alert rules.
RULES = [
    AlertRule("ALERT_CRITICAL_INCIDENT", "incident", "CRITICAL", min_risk=80),
    AlertRule("ALERT_HIGH_INCIDENT", "incident", "HIGH", min_risk=51),
    AlertRule("ALERT_BRUTE_FORCE", "detection", "HIGH", match_rule="BRUTE_FORCE_001"),
    AlertRule("ALERT_SQL_INJECTION", "detection", "HIGH", match_rule="WEB_SQLI_001"),
    AlertRule("ALERT_TRAVERSAL", "detection", "MEDIUM", match_rule="WEB_TRAVERSAL_001"),
    AlertRule("ALERT_MALWARE", "detection", "HIGH", match_category="Malware"),
    AlertRule("ALERT_HIGH_CONF_IOC", "ioc", "HIGH", min_confidence=0.9),
    AlertRule("ALERT_ASSET_WEB_ATTACK", "incident", "HIGH", min_risk=40, asset_type="web"),
    AlertRule("ALERT_CRITICAL_ASSET_INCIDENT", "incident", "HIGH", min_risk=45, min_criticality="CRITICAL"),
]

#: What to do about an incident, by its title.
ADVICE = {"Brute Force Attack": "Block the source and reset the accounts it tried.", "Possible Account Compromise": "Isolate the host and reset its credentials.", "Web Application Attack": "Review the web application and its firewall."}


SOURCES = ("detection", "incident", "ioc")


def parse_alert_rules(raw: Iterable[Mapping], base: Iterable[AlertRule] = ()) -> list[AlertRule]:
    """Alert rules from plain mappings on top of base rules: a known rule_id changes that rule, a new one is added; one
    that cannot be read is left out."""
    out = {r.rule_id: r for r in base}
    kinds = {f.name: f.type for f in fields(AlertRule)}
    for r in raw:
        try:
            r = {k: v for k, v in r.items() if k in kinds}
            r |= {k: int(r[k]) for k in ("min_risk", "threshold") if k in r} | {k: float(r[k]) for k in ("min_confidence",) if k in r}
            rule = replace(out[r["rule_id"]], **r) if r["rule_id"] in out else AlertRule(**r)
            if rule.source in SOURCES and rule.severity in SEVERITIES and rule.threshold > 0 and (rule.min_criticality or "LOW") in SEVERITIES:
                out[rule.rule_id] = rule
        except (KeyError, TypeError, ValueError):
            continue
    return list(out.values())


def found_indicators(events: DataFrame, feed: DataFrame) -> DataFrame:
    """The indicators of the events' addresses and messages, aggregated; the threat type is the feed's where it knows the value."""
    return indicators_of(indicator_facts(events), feed)


def indicator_facts(events: DataFrame) -> DataFrame:
    """(value, type, threat, related_events, first_seen, last_seen, sure): what events say of each indicator, by their own
    threat type ('' for none); sure is the sum of confidences (decimal, so that any order of adding gives the same). Facts of different events add up."""
    rows = indicators.indicator_table(different_texts(events), "text")
    sure = F.sum(F.col("confidence").cast("decimal(10,6)") * F.col("related_events")).cast("decimal(28,6)").alias("sure")
    return rows.groupBy("value", "type", "threat").agg(F.sum("related_events").alias("related_events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), sure)


def different_texts(events: DataFrame) -> DataFrame:
    """(threat, text, related_events, first_seen, last_seen): the texts in which indicators are looked for, each once. A message
    that cannot hold any is left empty, so most events differ by their addresses alone."""
    message = F.when(~F.col("message").rlike(indicators.TELLING), F.lit("")).otherwise(F.col("message"))
    own = F.coalesce("threat_type", F.lit("")) if "threat_type" in events.columns else F.lit("")
    rows = events.select("ts", own.alias("threat"), F.concat_ws(" ", "src_ip", "dst_ip", message).alias("text"))
    return rows.groupBy("threat", "text").agg(F.count(F.lit(1)).alias("related_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merged_indicator_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("value", "type", "threat").agg(F.sum("related_events").alias("related_events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sure").cast("decimal(28,6)").alias("sure"))


def indicators_of(facts: DataFrame, feed: DataFrame) -> DataFrame:
    """Facts as indicators: mean confidence of at most 0.99, and the feed's threat type or else the usual one (ties: the least)."""
    known = feed.select(F.lower("value").alias("_v"), F.col("threat_type").alias("_threat")).groupBy("_v").agg(F.min("_threat").alias("_threat"))
    first = F.min(F.when(F.col("threat") != "", F.struct((-F.col("related_events")).alias("n"), F.col("threat").alias("threat"))))
    agg = facts.groupBy("value", "type").agg(
        F.sum("related_events").alias("related_events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.least(F.lit(0.99), F.sum("sure").cast("double") / F.sum("related_events")).alias("confidence"), first.alias("_own"),
    )
    return agg.join(known, F.lower("value") == F.col("_v"), "left").withColumn("threat_type", F.coalesce("_threat", "_own.threat")).drop("_v", "_threat", "_own")


def candidates(rules: list[AlertRule], detections: DataFrame, incidents: DataFrame, found: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(alert_rule, severity, entity, risk_score, facts, dedup_key), one row per rule and entity.

    assets: (cluster, name, asset_type, criticality) of the incidents; without them no rule that asks for assets fires.
    """
    sources = {
        "detection": detections.select(F.array_join("entity", ":").alias("entity"), "risk_score", F.col("rule_id").alias("_rule"), F.col("category").alias("_cat"), F.lit(1.0).alias("_sure")),
        "incident": incidents.select(F.col("cluster").alias("entity"), "risk_score", F.lit(None).cast("string").alias("_rule"), F.col("category").alias("_cat"), F.lit(1.0).alias("_sure")),
        "ioc": found.select(F.col("value").alias("entity"), F.lit(0).alias("risk_score"), F.lit(None).cast("string").alias("_rule"), F.col("threat_type").alias("_cat"), F.col("confidence").alias("_sure")),
    }
    out = []
    for r in rules:
        df = sources[r.source].filter((F.col("risk_score") >= r.min_risk) & (F.col("_sure") >= r.min_confidence))
        if r.match_rule:
            df = df.filter(F.col("_rule") == r.match_rule)
        if r.match_category:
            df = df.filter(F.contains("_cat", F.lit(r.match_category)))
        if r.asset_type or r.min_criticality:
            if assets is None:
                continue
            kind = F.col("asset_type") == r.asset_type if r.asset_type else F.lit(True)
            grave = severity_rank(F.col("criticality")) >= SEVERITIES.index(r.min_criticality or "LOW")
            touched = assets.groupBy(F.col("cluster").alias("entity")).agg(F.bool_or(kind).alias("_kind"), F.bool_or(grave).alias("_grave")).filter("_kind AND _grave")
            df = df.join(touched.select("entity"), "entity", "left_semi")
        g = df.groupBy("entity").agg(F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("facts")).filter(F.col("facts") >= r.threshold)
        out.append(g.select(F.lit(r.rule_id).alias("alert_rule"), F.lit(r.severity).alias("severity"), "entity", "risk_score", "facts", F.concat(F.lit(f"{r.rule_id}|"), "entity").alias("dedup_key")))
    return reduce(DataFrame.unionByName, out)


def listing(alerts: DataFrame, status: str | None = None, severity: str | None = None, rule: str | None = None, limit: int = 100) -> DataFrame:
    """Alerts of a status, severity and rule (each where given), newest first; 1 to 500 of them."""
    wanted = {"status": status, "severity": severity and severity.upper(), "alert_rule": rule}
    for c, v in wanted.items():
        alerts = alerts.filter(F.col(c) == v) if v else alerts
    return alerts.orderBy(F.desc("created_at"), "alert_rule", "entity").limit(max(1, min(500, limit)))


def actor_narratives(groups: DataFrame, incidents: DataFrame, named: DataFrame) -> DataFrame:
    """actor, text: size, confidence and posture of an actor group, what its incidents share, and their worst severity."""
    worst = incidents.join(named, "cluster").groupBy("actor").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"))
    j = groups.join(worst, "actor")
    shared = [F.when(F.col(c) > 0, F.format_string(f"They share {what}.", c)) for c, what in (("iocs", "%d indicators"), ("techniques", "%d techniques"))]
    beat = F.when(F.col("beats") > 0, "Their events keep the same beat, as a schedule would.")
    head = F.format_string("%s: %d incidents, confidence %.2f, posture %d of 100.", "actor", "incidents", "confidence", "posture")
    return j.select("actor", F.concat_ws(" ", head, *shared, beat, F.concat(F.lit("Worst severity: "), "worst", F.lit("."))).alias("text"))


def narratives(incidents: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """cluster, text: what the computed facts say. entries: all of them; without, those that the timelines show."""
    entries = correlate.displayed(incidents) if entries is None else entries
    ts = F.unix_seconds("ts")
    facts = entries.groupBy("cluster").agg(F.count(F.lit(1)).alias("events"), F.floor((F.max(ts) - F.min(ts)) / 60).alias("span"))
    chain = correlate.kill_chain(entries).select("cluster", "tactics", "stage")
    j = incidents.join(facts, "cluster").join(chain, "cluster", "left")
    stage = F.when(F.col("tactics").isNotNull(), F.concat(F.lit("It reached: "), "tactics", F.lit(".")))
    text = F.concat_ws(" ", F.format_string("%s around %s: %d events in %d minutes, risk %d (%s).", "title", "cluster", "events", "span", "risk_score", "severity"), stage, lookup(F.col("title"), ADVICE, "Review the evidence."))
    return j.select("cluster", text.alias("text"))


def incident_reports(incidents: DataFrame) -> DataFrame:
    sure = F.round(F.least(F.lit(0.99), 0.5 + F.col("risk_score") / 200), 4)
    return incidents.select("cluster", "title", "severity", "category", sure.alias("confidence"), F.slice("timeline", 1, 10).alias("evidence"), lookup(F.col("title"), ADVICE, "Review the evidence.").alias("recommendation"))


def actors(incidents: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals; linked pairs; cluster, actor): communities of linked incidents; an unlinked incident is its own."""
    vectors = staged(correlate.signals(entries), "signals")
    links = staged(correlate.linked_pairs(vectors), "links")
    pairs = links.select(F.col("left").alias("a"), F.col("right").alias("b"))
    labels = correlate.components(pairs.union(incidents.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"))))
    named = labels.join(correlate.communities(labels), "label").select(F.col("node").alias("cluster"), F.col("name").alias("actor"))
    return vectors, links, staged(named, "actors")


def knowledge_graph(incidents: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (source, target, kind, provenance) of incidents, techniques, indicators and actors."""
    vectors, _, named = actors(incidents, entries)
    inc = lambda c: F.concat(F.lit("inc:"), c)
    sig = F.concat("signal", F.lit(":"), "value")
    nodes = incidents.select(inc("cluster").alias("id"), F.lit("incident").alias("kind")).unionByName(vectors.select(sig.alias("id"), F.col("signal").alias("kind"))).unionByName(named.select(F.col("actor").alias("id"), F.lit("actor").alias("kind")))
    edges = vectors.select(inc("cluster").alias("source"), sig.alias("target"), F.concat(F.lit("has_"), "signal").alias("kind"), F.lit("EXTRACTED").alias("provenance"))
    edges = edges.unionByName(named.select(F.col("actor").alias("source"), inc("cluster").alias("target"), F.lit("member").alias("kind"), F.lit("INFERRED").alias("provenance")))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def actor_groups(incidents: DataFrame, entries: DataFrame) -> DataFrame:
    """actor, incidents, confidence (mean of its links), posture (0 to 100) and what it is made of."""
    _, links, named = actors(incidents, entries)
    own = links.join(named, links["left"] == named["cluster"]).select("actor", "confidence", "signals")
    sure = own.groupBy("actor").agg(F.round(F.avg("confidence"), 3).alias("confidence"))
    shared = own.select("actor", F.explode("signals").alias("s")).groupBy("actor", "s.signal", "s.value").agg(F.count(F.lit(1)).alias("n"), F.max("s.weight").alias("weight"))
    of = lambda kind: F.count_if(F.col("signal") == kind)
    reuse = shared.groupBy("actor").agg(
        F.sum(F.when(F.col("signal") == "ioc", F.col("n"))).alias("iocs"), F.count_if((F.col("signal") == "ioc") & (F.col("weight") >= correlate.WEIGHTS["ioc_feed"])).alias("feed"),
        of("technique").alias("techniques"), of("geo").alias("geo"), of("cadence").alias("beats"),
    )
    stages = correlate.kill_chain(entries).select("cluster", "stage")
    g = incidents.select("cluster", "severity", "risk_score").join(named, "cluster").join(stages, "cluster", "left").groupBy("actor").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.sum(F.least(F.lit(20), 2 * F.coalesce("stage", F.lit(0)))).alias("stage"), F.max("risk_score").alias("top_risk"),
    )
    j = g.join(reuse, "actor", "left").join(sure, "actor", "left").na.fill(0, ["iocs", "feed", "techniques", "geo", "beats", "confidence"])
    points = {
        "base": F.lit(15), "reuse": 5 * F.col("iocs"), "feed": 10 * F.col("feed"), "technique": 3 * F.col("techniques"), "geo": F.when(F.col("geo") > 0, 4).otherwise(0), "cadence": F.when(F.col("beats") > 0, 4).otherwise(0),
        "severity": 6 * F.col("critical") + 3 * F.col("high"), "stage": F.col("stage"),
    }
    total = reduce(lambda a, b: a + b, points.values())
    parts = F.concat_ws(", ", *(F.concat(F.lit(f"{k} +"), v.cast("string")) for k, v in points.items()))
    return j.select("actor", "incidents", "confidence", "top_risk", "iocs", "techniques", "beats", F.least(F.lit(100), total).cast("int").alias("posture"), parts.alias("breakdown"))
