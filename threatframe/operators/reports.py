"""Aggregates over event tables: dashboards, timelines, baselines, assets, compliance, coverage and digests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedTable
from threatframe.functions.ranking import numbered
from threatframe.functions.staging import staged
from threatframe.sources.security import SEVERITIES, severity_rank

#: Services by port.
SERVICES = {21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "web", 110: "pop3", 143: "imap", 161: "snmp", 443: "web", 445: "smb", 1433: "mssql", 3306: "mysql", 3389: "rdp", 5432: "postgres", 5900: "vnc", 8080: "web", 8443: "web", 9200: "elasticsearch"}
DATABASES = ("mysql", "postgres", "mssql", "mongodb")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def cards(events: DataFrame) -> DataFrame:
    """The dashboard's counts in one pass."""
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "failure").alias("failures"),
        F.count_if(F.col("status") == "deny").alias("denied"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("username").alias("users"), F.count_if(F.col("risk") >= 60).alias("risky"),
    )


def breakdowns(events: DataFrame, columns: Mapping[str, int | None]) -> DataFrame:
    """(facet, key, n) for several columns from one scan; a facet may keep its largest n keys."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("key")) for c in columns)))
    counted = events.select(kinds.alias("k")).select("k.*").groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))
    most = reduce(lambda a, c: F.when(F.col("facet") == c[0], c[1]).otherwise(a), [(c, n) for c, n in columns.items() if n], F.lit(1 << 30))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "key"))).filter(F.col("place") <= most).select("facet", "key", "n")


def entity_windows(events: DataFrame, job: Column) -> DataFrame:
    """(job, entity_type, entity, attribute, value): per job, the measures of addresses, hosts, users and ports."""
    e = events.withColumn("job", job)
    long = lambda kind, key, measures: (
        e.filter(F.col(key).isNotNull()).groupBy("job", F.col(key).cast("string").alias("entity")).agg(*(m.cast("double").alias(a) for a, m in measures.items()))
        .select("job", F.lit(kind).alias("entity_type"), "entity", F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in measures))).alias("m"))
        .select("job", "entity_type", "entity", "m.*")
    )
    n = F.count(F.lit(1))
    return reduce(
        DataFrame.unionByName,
        [
            long("ip", "src_ip", {"events": n, "risk_sum": F.sum("risk"), "dst_ips": F.count_distinct("dst_ip"), "dst_ports": F.count_distinct("dst_port")}),
            long("host", "hostname", {"events": n}),
            long("user", "username", {"events": n, "failed_logins": F.count_if(F.col("event_type") == "auth_failure")}),
            long("port", "dst_port", {"events": n}),
        ],
    )


BASE_KEYS = ["entity_type", "entity", "attribute"]


def baseline(windows: DataFrame) -> DataFrame:
    """Moments per key: n, mean and m2 (the sum of squared deviations)."""
    return windows.groupBy(*BASE_KEYS).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def fold(base: DataFrame, more: DataFrame) -> DataFrame:
    """Two baselines of different jobs as one, by the pairwise formula for means and squared deviations (Chan et al.)."""
    one, two = base.select(*BASE_KEYS, F.struct("n", "mean", "m2").alias("a")), more.select(*BASE_KEYS, F.struct("n", "mean", "m2").alias("b"))
    j = one.join(two, BASE_KEYS, "full_outer")
    n, d = F.col("a.n") + F.col("b.n"), F.col("b.mean") - F.col("a.mean")
    both = F.struct(n.alias("n"), (F.col("a.mean") + d * F.col("b.n") / n).alias("mean"), (F.col("a.m2") + F.col("b.m2") + d * d * F.col("a.n") * F.col("b.n") / n).alias("m2"))
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both)
    return j.select(*BASE_KEYS, F.coalesce(both, "a", "b").alias("m")).select(*BASE_KEYS, "m.*")


class Baselines:
    """Baselines in a keyed table, with a ledger of the jobs that they hold: a job counts once, however often it is offered."""

    def __init__(self, spark, path: str, buckets: int = 16):
        self.moments = KeyedTable(spark, f"{path}/moments", "entity_type string, entity string, attribute string, n long, mean double, m2 double", tuple(BASE_KEYS), ("entity",), buckets)
        self.jobs = KeyedTable(spark, f"{path}/jobs", "job long, change long", ("job",), None, buckets)

    def fold(self, number: int, windows: DataFrame) -> DataFrame:
        """Change `number`: fold the jobs of `windows` (job and the columns of a baseline's windows) that are not in the ledger.

        A job's windows come together. Only baselines of entities that occur are read and written. Returns the new jobs.
        """
        known = self.jobs.of(windows.select("job").distinct(), number - 1).select("job")
        new = staged(windows.join(known, "job", "left_anti"), "windows")
        more = staged(baseline(new), "baseline")
        jobs = staged(new.select("job").distinct(), "jobs")
        self.moments.replace(number, fold(self.moments.of(more.select(*BASE_KEYS), number - 1), more))
        self.jobs.replace(number, jobs.withColumn("change", F.lit(number)))
        return jobs

    def read(self, at: int) -> DataFrame:
        return self.moments.read(at)


def listing(base: DataFrame) -> DataFrame:
    """Adds std (population) and the coefficient of variation."""
    std = F.sqrt(F.col("m2") / F.col("n"))
    return base.withColumn("std", std).withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")))


def anomalies(windows: DataFrame, base: DataFrame, min_z: float = 3.0, include_self: bool = True) -> DataFrame:
    """Windows at least min_z deviations above their baseline of two jobs or more.

    include_self=False takes the window's own value out of its baseline first.
    """
    j = windows.join(base, BASE_KEYS)
    if not include_self:
        rest = (F.col("n") * F.col("mean") - F.col("value")) / (F.col("n") - 1)
        j = j.filter("n > 1").withColumn("_m", rest)
        j = j.withColumn("m2", F.greatest(F.lit(0.0), F.col("m2") - (F.col("value") - F.col("mean")) * (F.col("value") - F.col("_m")))).withColumn("mean", F.col("_m")).withColumn("n", F.col("n") - 1).drop("_m")
    j = listing(j).filter((F.col("n") >= 2) & (F.col("std") > 1e-9)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    reason = F.format_string("%s %s: %s is %.1f deviations above its mean", "entity_type", "entity", "attribute", "z")
    return j.filter(F.col("z") >= min_z).withColumn("reason", reason)


def assets(events: DataFrame) -> DataFrame:
    """Inventory: hosts (else source addresses), and destinations on known service ports."""
    return assets_of(asset_facts(events))


def asset_facts(events: DataFrame) -> DataFrame:
    """(name, services, ports, named, first_seen, last_seen, max_risk, events): what events say of each asset. Facts of
    different events add up by `merged_facts`."""
    port = F.col("dst_port")
    service = F.element_at(F.create_map(*(F.lit(x) for kv in SERVICES.items() for x in kv)), port)
    own = F.struct(F.coalesce(F.nullif("hostname", F.lit("")), "src_ip").alias("name"), F.lit(None).cast("string").alias("service"), F.coalesce(F.col("hostname") != "", F.lit(False)).alias("named"), F.lit(None).cast("int").alias("port"))
    target = F.when(service.isNotNull(), F.struct(F.col("dst_ip").alias("name"), service.alias("service"), F.lit(False).alias("named"), port.alias("port")))
    rows = events.withColumn("a", F.explode(F.array(own, target))).select("a.*", "ts", "risk").filter("name IS NOT NULL AND name <> ''")
    few = rows.groupBy("name", "service", "port").agg(  # sets are made of these rows, not of events
        F.bool_or("named").alias("named"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("risk").alias("max_risk"), F.count(F.lit(1)).alias("events")
    )
    return few.groupBy("name").agg(
        F.array_sort(F.collect_set("service")).alias("services"), F.array_sort(F.collect_set("port")).alias("ports"), F.bool_or("named").alias("named"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("max_risk").alias("max_risk"), F.sum("events").alias("events"),
    )


def merged_facts(facts: DataFrame) -> DataFrame:
    """Facts of the same assets from different events, as one row each. Services and ports are few: known ones only."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return facts.groupBy("name").agg(every("services"), every("ports"), F.bool_or("named").alias("named"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("max_risk").alias("max_risk"), F.sum("events").alias("events"))


def assets_of(facts: DataFrame) -> DataFrame:
    """Facts with what follows from them: type and criticality."""
    role = F.when(F.arrays_overlap("services", F.array(*map(F.lit, DATABASES))), "database").when(F.array_contains("services", "web"), "web").when(F.col("named") | (F.size("services") > 0), "server").otherwise("unknown")
    g = facts.withColumn("asset_type", role)
    step = F.when(F.col("asset_type").isin("database", "web"), 2).when(F.col("asset_type").isin("network", "server"), 1).otherwise(0)
    step = F.when(F.col("max_risk") >= 75, 3).when(F.col("max_risk") >= 50, F.least(F.lit(3), step + 1)).otherwise(step)
    return g.withColumns({"ports": F.slice("ports", 1, 50), "criticality": F.element_at(F.array(*map(F.lit, SEVERITIES)), step + 1)}).drop("named")


def graph_edges(events: DataFrame) -> DataFrame:
    """(kind, source, target, weight, severity): traffic, logins and web requests, with the worst severity."""
    worst = F.max_by("severity", severity_rank(F.col("severity")))
    edge = lambda kind, rows, a, b: rows.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.count(F.lit(1)).alias("weight"), worst.alias("severity")).select(F.lit(kind).alias("kind"), "source", "target", "weight", "severity")
    logins, web = events.filter(F.col("event_type").isin("auth_failure", "auth_success")), events.filter("event_type = 'http_request'")
    return edge("traffic", events, "src_ip", "dst_ip").unionByName(edge("login", logins, "src_ip", "username")).unionByName(edge("web", web, "src_ip", "hostname"))


def graph_nodes(edges: DataFrame, risk: DataFrame, most: int = 400) -> DataFrame:
    """End points with their highest risk, the `most` riskiest (ties by name)."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()
    out = ends.join(risk.groupBy(F.col("src_ip").alias("node")).agg(F.max("risk").alias("risk")), "node", "left").withColumn("risk", F.coalesce("risk", F.lit(0)))
    return out.orderBy(F.desc("risk"), "node").limit(most)


def coverage(events: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(field, filled, share): how many rows fill each column, from one pass."""
    columns = list(columns)
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    one = events.agg(F.count(F.lit(1)).alias("_n"), *(filled(c).alias(c) for c in columns))
    rows = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns))).alias("f")).select("_n", "f.*")
    return rows.select("field", "filled", F.when(F.col("_n") > 0, F.round(100.0 * F.col("filled") / F.col("_n"), 2)).otherwise(0.0).alias("share"))


#: Controls as (framework, id, severity, metric, operator, value).
CONTROLS = [
    ("NIST SP 800-53", "SI-4", "high", "incident_count", "le", 2),
    ("NIST SP 800-53", "AU-6", "high", "auth_failures", "le", 5),
    ("NIST SP 800-53", "RA-5", "medium", "detection_count", "le", 3),
    ("NIST SP 800-53", "SC-7", "high", "deny_events", "ge", 1),
    ("NIST SP 800-53", "IR-4", "medium", "untriaged_incidents", "le", 0),
    ("ISO 27001:2022", "A.8.16", "high", "auth_failures", "le", 10),
    ("ISO 27001:2022", "A.8.23", "medium", "web_attacks", "le", 1),
    ("ISO 27001:2022", "A.5.10", "low", "pii_count", "le", 0),
    ("PCI-DSS v4.0", "REQ-10.2", "high", "event_count", "ge", 1),
    ("PCI-DSS v4.0", "REQ-10.7", "high", "incident_count", "le", 2),
    ("PCI-DSS v4.0", "REQ-11.2", "medium", "detection_count", "le", 4),
    ("CIS Controls v8", "CIS-8.5", "high", "auth_failures", "le", 5),
    ("CIS Controls v8", "CIS-12.4", "medium", "deny_events", "ge", 1),
    ("CIS Controls v8", "CIS-13.7", "high", "port_scans", "ge", 1),
    ("CERT-In (India)", "CERT-LOG-01", "high", "event_count", "ge", 1),
    ("CERT-In (India)", "CERT-LOG-02", "high", "incident_count", "le", 3),
    ("CERT-In (India)", "CERT-NTP-01", "medium", "timed_events", "ge", 1),
    ("CERT-In (India)", "CERT-RET-01", "high", "event_count", "ge", 1),
    ("CERT-In (India)", "CERT-RPT-01", "high", "untriaged_incidents", "le", 0),
    ("CERT-In (India)", "CERT-HYG-01", "medium", "auth_failures", "le", 5),
]


METRICS = ("event_count", "auth_failures", "deny_events", "timed_events", "risk_surface", "pii_count", "web_attacks", "detection_count", "incident_count", "port_scans", "untriaged_incidents")


def compliance_metrics(events: DataFrame, detections: DataFrame, incidents: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(metric, value), one row for each of METRICS.

    events: with pii_detected (types of personal data found) and threat_type; web_attacks are events whose threat type names a
    web attack, risk_surface the sources with a risk of 60 or more. port_scans are incidents of that category. untriaged are
    incidents whose status is NEW; statuses (cluster, status), the latest of each, override the incidents' own.
    """
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    has = lambda c, what: F.replace(F.lower(c), F.lit("_"), F.lit(" ")).contains(what)
    one = events.agg(
        F.count(F.lit(1)).alias("event_count"), n(F.col("event_type") == "auth_failure").alias("auth_failures"), n(F.col("status") == "deny").alias("deny_events"), F.count("ts").alias("timed_events"),
        F.count_distinct(F.when(F.col("risk") >= 60, F.col("src_ip"))).alias("risk_surface"), n(F.size("pii_detected") > 0).alias("pii_count"), n(has("threat_type", "web attack")).alias("web_attacks"),
    )
    if statuses is not None:
        incidents = incidents.join(statuses.select("cluster", F.col("status").alias("_latest")), "cluster", "left").withColumn("status", F.coalesce("_latest", "status"))
    cases = incidents.agg(F.count(F.lit(1)).alias("incident_count"), n(has("category", "port scan")).alias("port_scans"), n(F.col("status") == "NEW").alias("untriaged_incidents"))
    found = detections.agg(F.count(F.lit(1)).alias("detection_count"))
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns))).alias("m")).select("m.*")
    return long(one).unionByName(long(cases)).unionByName(long(found))


def audit(metrics: DataFrame, controls: Iterable | DataFrame = CONTROLS) -> DataFrame:
    """Controls (rows as in CONTROLS, or a table) against (metric, value) rows: PASS, or by severity FAIL (high) or WARN; UNKNOWN,
    with a null value, where nobody has computed the metric."""
    table = controls if isinstance(controls, DataFrame) else metrics.sparkSession.createDataFrame(list(controls), "framework string, control string, severity string, metric string, operator string, bound long")
    v = F.col("value")
    ok = F.when(F.col("operator") == "le", v <= F.col("bound")).when(F.col("operator") == "ge", v >= F.col("bound")).when(F.col("operator") == "gt", v > F.col("bound")).otherwise(v == F.col("bound"))
    return table.join(metrics, "metric", "left").withColumn("result", F.when(v.isNull(), "UNKNOWN").when(ok, "PASS").when(F.col("severity") == "high", "FAIL").otherwise("WARN"))


CHUNK = 4096  #: hashes that make one digest, on every level of a batch's tree


def batch_digests(events: DataFrame, job: Column, order: str, text: Column, fan_in: int = CHUNK) -> DataFrame:
    """(job, events, digest): a digest of a batch's ordered events, as a tree.

    The SHA-256 of fan_in events in order are hashed together, then the digests of fan_in such chunks, and so on up to one
    digest for each batch (there is always a level above the chunks). No row holds more than fan_in hashes. `order` tells
    the events of a batch apart.
    """
    rows = events.select(job.alias("job"), F.col(order).alias("o"), F.sha2(text, 256).alias("h"))
    rows = numbered(rows, [F.col("job"), F.col("o")], "n")
    first = staged(rows.groupBy("job").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("nodes")), "batches")
    level = rows.join(first, "job").select("job", (F.col("n") - F.col("first")).alias("n"), "h", F.lit(1).cast("long").alias("events"), "nodes")
    most, height = first.agg(F.max("nodes")).first()[0] or 0, 0
    while height < 2 or most > 1:
        hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x.h), ""), 256)
        top = F.when(F.col("nodes") == 1, F.min("h")) if height >= 2 else F.lit(None)  # a batch that has its digest waits for the others
        above = level.groupBy("job", "nodes", F.expr(f"n div {fan_in}").alias("up")).agg(F.coalesce(top, hashed).alias("h"), F.sum("events").alias("events"))
        level = staged(above.select("job", F.col("up").alias("n"), "h", "events", F.ceil(F.col("nodes") / fan_in).alias("nodes")), "digests")
        most, height = -(-most // fan_in), height + 1
    return level.select("job", "events", F.col("h").alias("digest"))


def chained(digests: DataFrame) -> DataFrame:
    """Adds prev_hash and chain_hash, each link over its predecessor's batch digest. One row per batch."""
    prev = F.lag("digest").over(Window.orderBy("job"))
    return digests.withColumn("prev_hash", F.coalesce(prev, F.lit("0" * 64))).withColumn("chain_hash", F.sha2(F.concat("prev_hash", "digest"), 256))


def broken_links(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Batches whose digest, or whose link to the one before, no longer holds."""
    now = chained(recomputed).select("job", F.col("digest").alias("_d"), F.col("prev_hash").alias("_p"))
    both = stored.join(now, "job", "full_outer")
    why = F.when(F.col("_d").isNull(), "missing").when(F.col("digest").isNull(), "unknown").when(F.col("digest") != F.col("_d"), "changed").when(F.col("prev_hash") != F.col("_p"), "relinked")
    return both.withColumn("fault", why).filter("fault IS NOT NULL").select("job", "fault")
