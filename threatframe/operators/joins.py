"""Joins of events to reference data and to earlier results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import staged
from threatframe.operators.indicators import MAPPED, iocs, ip_key

#: Address ranges as (first, last, country, kind), not overlapping.
RANGES = [
    (0, 16777215, "ZZ", "reserved"),
    (134744064, 134744319, "US", "public"),
    (167772160, 184549375, "PR", "private"),
    (2130706432, 2147483647, "LO", "private"),
    (2851995648, 2852061183, "PR", "private"),
    (2886729728, 2887778303, "PR", "private"),
    (3232235520, 3232301055, "PR", "private"),
    (3758096384, 4026531839, "ZZ", "reserved"),
]

#: A small feed as (value, threat type, confidence).
FEED = [("8.8.8.10", "scanner", 0.85), ("8.8.8.50", "command_and_control", 0.97), ("10.1.0.37", "credential_attack", 0.92), ("192.168.0.7", "web_attack", 0.6), ("203.0.113.9", "malware", 0.88)]

#: Actions by category.
PLAYBOOK = {
    "Brute Force": ["BLOCK_SRC_1H", "ENFORCE_LOCKOUT_MFA", "RESET_TARGET_CREDS"],
    "Credential Attack": ["DISABLE_ACCOUNT", "FORCE_RESET_TRANSITIVE", "REVIEW_AUTH_LOGS"],
    "Reconnaissance": ["RATE_LIMIT_SRC", "VERIFY_EXPOSURE"],
    "Port Scanning": ["BLOCK_SCANNER", "REVIEW_OPEN_PORTS"],
    "Malware": ["ISOLATE_HOST", "CAPTURE_FORENSICS", "ROTATE_HOST_CREDS"],
    "Phishing": ["SEARCH_MAILGW", "BRIEF_TARGETS"],
    "Web Attack": ["ROTATE_DB_CREDS", "REVIEW_WAF", "ISOLATE_WEB_HOST"],
    "Data Exfiltration": ["QUARANTINE_DESTINATION", "REVIEW_VOLUMES"],
    "Privilege Escalation": ["REVOKE_ELEVATED", "AUDIT_ELEVATION_PATHS"],
    "Command Execution": ["ISOLATE_EXEC_HOST", "CAPTURE_EXEC_EVIDENCE", "ROTATE_EXEC_CREDS"],
    "Persistence": ["HUNT_PERSISTENCE", "REIMAGE_IF_CONFIRMED"],
    "Lateral Movement": ["SEGMENT_PATHS", "RESET_TRANSITIVE_CREDS"],
}
FALLBACK = ["MANUAL_TRIAGE"]


def range_table(spark: SparkSession, ranges: Iterable = RANGES) -> DataFrame:
    return spark.createDataFrame(list(ranges), "lo long, hi long, country string, kind string")


def feed_table(spark: SparkSession, feed: Iterable = FEED) -> DataFrame:
    return spark.createDataFrame(list(feed), "value string, threat_type string, confidence double")


def _blocks(key: Column) -> Column:
    """Where an address is looked for: the first half of an IPv4 address; the first 16 and the first 32 bits of an IPv6 one."""
    six = F.array(F.concat(F.lit("w"), F.substring(key, 1, 4)), F.concat(F.lit("n"), F.substring(key, 1, 8)))
    return F.when(key.startswith(MAPPED), F.array(F.concat(F.lit("4"), F.substring(key, 25, 4)))).otherwise(six)


def _range_blocks(lo: Column, hi: Column) -> Column:
    """The blocks of a range: at most 65,536 of an IPv4 range. A wide IPv6 range has 32-bit blocks only at its two ends and
    16-bit blocks between them, so it has at most three times as many."""
    number = lambda key, at, n: F.conv(F.substring(key, at, n), 16, 10).cast("long")
    named = lambda numbers, name, n: F.transform(numbers, lambda x: F.concat(F.lit(name), F.lpad(F.lower(F.hex(x)), n, "0")))
    first, last = number(lo, 1, 8), number(hi, 1, 8)
    top, end = F.shiftright(first, 16), F.shiftright(last, 16)
    middle = F.when(end - top > 1, named(F.sequence(top + 1, end - 1), "w", 4)).otherwise(F.array().cast("array<string>"))
    wide = F.concat(named(F.sequence(first, F.shiftleft(top, 16) + 0xFFFF), "n", 8), middle, named(F.sequence(F.shiftleft(end, 16), last), "n", 8))
    four = named(F.sequence(number(lo, 25, 4), number(hi, 25, 4)), "4", 4)
    return F.when(lo.startswith(MAPPED) & hi.startswith(MAPPED), four).when(end > top, wide).otherwise(named(F.sequence(first, last), "n", 8))


def located(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(_ip, country, kind) of the different IPv4 and IPv6 addresses in a table's only column; kind is `public` outside all ranges.

    ranges: lo, hi, country and kind; bounds are keys as `ip_key` makes them, or numbers of IPv4 addresses. Of several ranges
    that hold an address the innermost counts: the one that starts last, of these the one that ends first (ties: by text).

    Ranges are cut into blocks, so that the lookup is an equi-join. The addresses are read once; the answers are written, so
    that the planner knows their size and sends few of them to the events instead of shuffling the events to them.
    """
    if ranges.schema["lo"].dataType.typeName() != "string":
        ranges = ranges.withColumns({c: F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(c)), 8, "0")) for c in ("lo", "hi")})
    cut = ranges.filter("lo <= hi").select("lo", "hi", "country", "kind", F.explode(F.array_distinct(_range_blocks(F.col("lo"), F.col("hi")))).alias("_block"))
    ips = staged(addresses.toDF("_ip").distinct(), "addresses").withColumn("_key", ip_key(F.col("_ip"))).filter("_key IS NOT NULL")
    hit = ips.withColumn("_block", F.explode(_blocks(F.col("_key")))).join(cut, "_block").filter(F.col("_key").between(F.col("lo"), F.col("hi")))
    inner = F.max(F.struct("lo", F.translate("hi", "0123456789abcdef", "fedcba9876543210").alias("end"), "country", "kind")).alias("_r")
    known = ips.select("_ip").join(hit.groupBy("_ip").agg(inner), "_ip", "left")
    return staged(known.select("_ip", F.col("_r.country").alias("country"), F.coalesce("_r.kind", F.lit("public")).alias("kind")), "located")


def geo_lookup(events: DataFrame, ranges: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Adds country and kind of an IPv4 or IPv6 address, as `located` finds them; known: its answers, where they are at hand
    already. One row for every event."""
    known = located(events.select(column), ranges) if known is None else known
    known = known.select(F.col("_ip").alias("_at"), "country", "kind")
    return events.join(known, events[column] == F.col("_at"), "left").drop("_at")


def both_ends(events: DataFrame) -> DataFrame:
    """The source and target addresses of events, as one column."""
    return events.select(F.explode(F.array("src_ip", "dst_ip")).alias("_ip"))


def intel_match(events: DataFrame, feed: DataFrame, candidates: list[str], key: str) -> DataFrame:
    """The first candidate column whose value the feed holds: adds matched, threat_type, verdict; raises risk."""
    rows = events.select(key, F.posexplode(F.array(*candidates)).alias("_pos", "value"))
    hit = rows.join(feed, "value").groupBy(key).agg(F.min_by(F.struct("value", "threat_type", "confidence"), "_pos").alias("_m"))
    out = events.join(hit, key, "left")
    sure = F.col("_m.confidence")
    more = F.when(sure >= 0.9, 45).when(sure >= 0.7, 30).when(sure.isNotNull(), 15).otherwise(0)
    verdict = F.when(sure >= 0.9, "malicious").when(sure.isNotNull(), "suspicious")
    old = F.col("threat_type") if "threat_type" in events.columns else F.lit(None).cast("string")
    return out.withColumns(
        {"matched": F.col("_m.value"), "threat_type": F.coalesce(F.nullif(old, F.lit("")), F.col("_m.threat_type")), "verdict": verdict, "risk": F.least(F.lit(100), F.col("risk") + more)}
    ).drop("_m")


def reputation(feed: DataFrame, events: DataFrame, candidates: list[str], key: str) -> DataFrame:
    """Every value that the feed or the events know, with its sightings; unknown to the feed: no confidence."""
    seen = events.select(key, F.explode(F.array(*candidates)).alias("_v")).groupBy(F.lower("_v").alias("_v")).agg(F.count(key).alias("sightings"))
    both = feed.withColumn("_v", F.lower("value")).join(seen, "_v", "full_outer")
    return both.select(F.coalesce("value", "_v").alias("value"), "threat_type", "confidence", F.coalesce("sightings", F.lit(0)).alias("sightings"))


def latest_by_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """The newest row for each name, upper and lower case alike."""
    rest = [c for c in df.columns]
    g = df.groupBy(F.lower(name).alias("name")).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return g.select("name", "r.*")


def unsuppressed(new: DataFrame, old: DataFrame, seconds: int) -> DataFrame:
    """Alerts without an open one of their key, or one made in the `seconds` before."""
    n, o = new.alias("n"), old.alias("o")
    gap = F.unix_micros("n.created_at") - F.unix_micros("o.created_at")
    held = F.col("o.status").isin("OPEN", "NEW") | gap.between(0, seconds * 1_000_000)
    return n.join(o, (F.col("n.dedup_key") == F.col("o.dedup_key")) & held, "left_anti")


def recommended_actions(df: DataFrame, key: str) -> DataFrame:
    """Per key, the actions of its comma-separated categories: in order, each once; a fallback where none is known."""
    table = df.sparkSession.createDataFrame([(c, k, a) for c, acts in PLAYBOOK.items() for k, a in enumerate(acts)], "category string, nth int, action string")
    rows = df.select(key, F.posexplode(F.split("category", r",\s*")).alias("place", "category"))
    hit = rows.join(F.broadcast(table), "category").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "nth", "action"))).alias("a"))
    out = df.select(key).join(hit, key, "left")
    return out.select(key, F.coalesce(F.array_distinct(F.transform("a", lambda x: x.action)), F.array(*map(F.lit, FALLBACK))).alias("actions"))


def scores_of_evidence(entries: DataFrame, scores: DataFrame, limit: float = 0.7) -> DataFrame:
    """(cluster, peak, flagged, bump): anomaly scores of an incident's different events, worth up to 30 points."""
    cited = entries.select("cluster", "event_id").distinct().join(scores, "event_id")
    g = cited.groupBy("cluster").agg(F.max("score").alias("peak"), F.count_if(F.col("score") >= limit).alias("flagged"))
    return g.withColumn("bump", F.least(F.lit(30), F.round(F.col("peak") * 20) + F.least(F.lit(10), F.col("flagged") * 2)).cast("int"))


def incident_assets(entries: DataFrame, assets: DataFrame) -> DataFrame:
    """(cluster, name, asset_type, criticality): the assets that an incident touches: its own key, and the sources, targets and
    hosts of its events; upper and lower case alike."""
    names = entries.select("cluster", F.explode(F.array("src_ip", "dst_ip", "hostname")).alias("name")).union(entries.select("cluster", F.col("cluster").alias("name")))
    names = names.select("cluster", F.lower(F.trim("name")).alias("_name")).filter("_name <> ''").distinct()
    return names.join(assets.select(F.lower("name").alias("_name"), "name", "asset_type", "criticality"), "_name").drop("_name")


def evidence_map(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(event_id, src_ip, dst_ip, country, iocs): for each different event of the entries, the country of the first public
    address of source and target, and the indicators of its message."""
    rows = entries.select("event_id", "src_ip", "dst_ip", "message").dropDuplicates(["event_id"])
    each = rows.select("event_id", F.posexplode(F.array("src_ip", "dst_ip")).alias("_pos", "_addr")).filter("_addr IS NOT NULL")
    public = geo_lookup(each, ranges, "_addr").filter("kind = 'public' AND country IS NOT NULL").groupBy("event_id").agg(F.min_by("country", "_pos").alias("country"))
    return rows.join(public, "event_id", "left").select("event_id", "src_ip", "dst_ip", "country", iocs(F.col("message")).alias("iocs"))
