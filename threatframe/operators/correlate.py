"""From detections to incidents: components over shared entities, incident facts, kill chains, phases and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatframe.functions.ranking import numbered
from threatframe.functions.staging import staged
from threatframe.operators import joins
from threatframe.operators.indicators import indicator_table
from threatframe.operators.scoring import CRITICAL_CATEGORIES, DOTTED_QUAD, band, normalize_category
from threatframe.plans.rulesets import TACTICS, TECHNIQUES

MEMBERS = 200  #: entries of an incident's timeline, which is for display; facts come from `entries`

#: Weight of a signal that two incidents share.
WEIGHTS = {"ioc": 2.0, "ioc_feed": 4.0, "technique": 1.5, "geo": 0.5, "cadence": 1.0}

#: Fixed values: (category, categories that make it a combination, title of the combination, title alone), in order.
TITLES = (
    ("brute force", CRITICAL_CATEGORIES + ("privilege escalation",), "Possible Account Compromise", "Brute Force Attack"),
    ("port scanning", (), "", "Reconnaissance / Port Scan Activity"),
    ("reconnaissance", (), "", "Network Reconnaissance"),
    ("web attack", (), "", "Web Application Attack"),
    ("command execution", (), "", "Suspicious Command Execution"),
    ("malware", (), "", "Malware-like Activity"),
    ("persistence", (), "", "Persistence Mechanism Detected"),
    ("privilege escalation", (), "", "Brute Force Attack"),
)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any orderable type -> (node, label): the least node of each connected component.

    Alternating star contraction: each round links every neighbour of a node to the least one around it. Rounds are
    written to the shared folder, so the plan stays short and a lost executor costs one round. Their number grows with
    the logarithm of a component's size.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    now, mark = staged(now, "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        linked = now.join(least, "u")
        up = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
        now = staged(up.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    return found.union(alone.join(found.select("node"), "node", "left_anti"))


def communities(labels: DataFrame) -> DataFrame:
    """Names by size: (label, size, name). One row per component."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    named = numbered(sizes, [F.desc("size"), F.col("label")], "nth")
    return named.select("label", "size", F.concat(F.lit("actor-"), (F.col("nth") + 1).cast("string")).alias("name"))


def cluster(found: DataFrame, bridges: bool = True) -> DataFrame:
    """Adds `cluster`: detections that share a key part, or whose login bridge leads to one, stand together."""
    parts = F.filter("entity", lambda p: p != "-")
    rows = found.withColumns({"_parts": parts, "_first": F.element_at(parts, 1)})
    edges = rows.select(F.col("_first").alias("a"), F.explode("_parts").alias("b"))
    if bridges:
        edges = edges.union(rows.filter("followed_by IS NOT NULL").select(F.col("_first").alias("a"), F.col("followed_by").alias("b")))
    labels = components(edges).select(F.col("node").alias("_first"), F.col("label").alias("cluster"))
    return rows.join(labels, "_first").drop("_parts", "_first")


def _title(categories: Column) -> Column:
    low = F.transform(categories, F.lower)
    out = F.lit("Suspicious Activity Cluster")
    for first, followers, combined, alone in reversed(TITLES):
        title = F.lit(alone)
        if followers:
            title = F.when(F.arrays_overlap(low, F.array(*map(F.lit, followers))), combined).otherwise(alone)
        out = F.when(F.array_contains(low, first), title).otherwise(out)
    return out


def incidents(clustered: DataFrame) -> DataFrame:
    """One row per cluster of scored detections: score, band, class, title, reasons, and the first entries of its timeline."""
    entry = F.transform("evidence", lambda e: F.struct(e.ts.alias("ts"), F.col("rule_id"), e.event_id.alias("event_id"), F.col("name").alias("rule_name"), F.col("severity"), e.excerpt.alias("excerpt")))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("t"))
    shown = clustered.select("cluster", F.explode(entry).alias("t")).withColumn("_nth", nth).filter(F.col("_nth") <= MEMBERS)
    shown = shown.groupBy("cluster").agg(F.array_sort(F.collect_list("t")).alias("timeline"))
    rows = clustered.withColumn("_cat", normalize_category(F.col("category")))
    g = rows.groupBy("cluster").agg(
        F.max("risk_score").alias("_base"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("_cat")).alias("categories"),
        F.bool_or(F.col("followed_by").isNotNull()).alias("success"),
    ).join(shown, "cluster")
    several, broad = F.size("categories") >= 2, F.col("members") >= 3
    bonus = {"several categories": (several, 10), "a login succeeded after failures": (F.col("success"), 10), "three detections or more": (broad, 5)}
    score = reduce(lambda a, b: a + F.when(b[0], b[1]).otherwise(0), bonus.values(), F.col("_base"))
    g = g.withColumn("risk_score", F.least(F.lit(100), score).cast("int"))
    low = F.transform("categories", F.lower)
    logins = F.arrays_overlap(low, F.array(F.lit("brute force"), F.lit("credential attack")))
    bad = (F.col("success") & logins) | (F.col("risk_score") >= 81) | F.arrays_overlap(low, F.array(*map(F.lit, CRITICAL_CATEGORIES)))
    reasons = [F.concat(F.lit("+"), F.col("_base").cast("string"), F.lit(" highest score of a member"))]
    reasons += [F.when(when, F.lit(f"+{points} {what}")) for what, (when, points) in bonus.items()]
    return g.withColumns(
        {"severity": band(F.col("risk_score")), "classification": F.when(bad, "MALICIOUS").when(F.col("risk_score") >= 31, "SUSPICIOUS").otherwise("BENIGN"),
         "title": _title(F.col("categories")), "category": F.array_join("categories", ", "), "reasons": F.array_compact(F.array(*reasons)),
         "event_ids": F.transform("timeline", lambda t: t.event_id), "status": F.lit("NEW")}
    ).drop("_base")


def entries(clustered: DataFrame, rows: DataFrame) -> DataFrame:
    """(cluster, rule_id, entity, event_id, ts, src_ip, dst_ip, hostname, message): all events in the windows of a cluster's detections, one row each."""
    return clustered.select("cluster", "rule_id", "entity").join(rows, ["rule_id", "entity"])


def displayed(inc: DataFrame) -> DataFrame:
    """The entries that the timelines show."""
    return inc.select("cluster", F.explode("timeline").alias("t")).select("cluster", "t.*")


def technique_table(spark) -> DataFrame:
    """(rule_id, place, technique, tactic): a few dozen rows of reference data."""
    return spark.createDataFrame([(r, k, t, tac) for r, ts in TECHNIQUES.items() for k, (t, tac) in enumerate(ts)], "rule_id string, place int, technique string, tactic string")


def with_techniques(found: DataFrame) -> DataFrame:
    """Adds techniques: ARRAY<STRUCT<place,technique,tactic>>; one UNMAPPED entry where the rule is unknown."""
    table = technique_table(found.sparkSession).groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("place", "technique", "tactic"))).alias("techniques"))
    none = F.array(F.struct(F.lit(0).alias("place"), F.lit("UNMAPPED").alias("technique"), F.lit("unmapped").alias("tactic")))
    return found.join(F.broadcast(table), "rule_id", "left").withColumn("techniques", F.coalesce("techniques", none))


def _tactic_rows(found: DataFrame) -> DataFrame:
    """(cluster, rule_id, ts, technique, tactic, stage) of incident entries."""
    rows = found.select("cluster", "rule_id", "ts", "event_id")
    stage = F.array_position(F.array(*map(F.lit, TACTICS)), F.col("tactic")).cast("int")
    return rows.join(F.broadcast(technique_table(found.sparkSession)), "rule_id").withColumn("stage", stage)


def kill_chain(found: DataFrame) -> DataFrame:
    """Per incident: tactics in their order, different techniques, evidence weight, furthest stage, progress."""
    g = _tactic_rows(found).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("stage", "tactic"))), lambda s: s.tactic), " > ").alias("tactics"),
        F.count_distinct("technique").alias("techniques"), F.count(F.lit(1)).alias("weight"), F.max("stage").alias("stage"),
    )
    return g.withColumn("progress", F.round(100 * F.col("stage") / len(TACTICS), 1))


def phases(found: DataFrame) -> DataFrame:
    """Incident entries by tactic, in the order of the tactics."""
    g = _tactic_rows(found).groupBy("cluster", "stage", "tactic")
    return g.agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def annotate(events: DataFrame, inc: DataFrame, found: DataFrame) -> DataFrame:
    """Cited events take the incident's first category, unless they have a threat type, and half its risk if larger."""
    facts = inc.select("cluster", F.element_at("categories", 1).alias("_cat"), F.floor(F.col("risk_score") / 2).cast("int").alias("_half"))
    cited = found.select("cluster", "event_id").join(facts, "cluster")
    cited = cited.groupBy("event_id").agg(F.max_by("_cat", F.struct("_half", "_cat")).alias("_cat"), F.max("_half").alias("_half"))
    out = events.join(cited, "event_id", "left")
    return out.withColumns({"threat_type": F.coalesce(F.nullif("threat_type", F.lit("")), "_cat"), "risk": F.greatest("risk", "_half")}).drop("_cat", "_half")


def cadence(events: DataFrame, key: str) -> DataFrame:
    """Median gap, in seconds, between the different time stamps of a key with three of them or more.

    Gaps are taken within hours and between the ends of a key's hours, so a busy key is spread over its hours.
    """
    stamps = events.select(key, F.unix_micros("ts").alias("_t")).filter("_t IS NOT NULL").distinct().withColumn("_hour", F.floor(F.col("_t") / 3_600_000_000))
    within = stamps.select(key, (F.col("_t") - F.lag("_t").over(Window.partitionBy(key, "_hour").orderBy("_t"))).alias("_gap"))
    ends = stamps.groupBy(key, "_hour").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    between = ends.select(key, (F.col("_first") - F.lag("_last").over(Window.partitionBy(key).orderBy("_hour"))).alias("_gap"))
    g = within.unionByName(between).groupBy(key).agg(F.count("_gap").alias("gaps"), (F.median("_gap") / 1e6).alias("cadence_s"))
    return g.filter("gaps >= 2")


def signals(found: DataFrame, ranges: DataFrame | None = None, feed: DataFrame | None = None) -> DataFrame:
    """(cluster, signal, value, weight) of incident entries: techniques, indicators of all types in whole messages (those
    of the feed weigh double), countries of public addresses, and the cadence in seconds.

    An event counts with the first public address of its source and target. The countries of an incident weigh once.
    """
    spark = found.sparkSession
    ranges, feed = joins.range_table(spark) if ranges is None else ranges, joins.feed_table(spark) if feed is None else feed
    tech = _tactic_rows(found).select("cluster", F.lit("technique").alias("signal"), F.col("technique").alias("value"), F.lit(WEIGHTS["technique"]).alias("weight"))
    known = feed.select(F.lower("value").alias("_v")).distinct().withColumn("_feed", F.lit(True))
    iocs = indicator_table(found.select("cluster", "message")).select("cluster", F.lower("value").alias("_v")).distinct().join(known, "_v", "left")
    ioc = iocs.select("cluster", F.lit("ioc").alias("signal"), F.col("_v").alias("value"), F.when(F.col("_feed"), WEIGHTS["ioc_feed"]).otherwise(WEIGHTS["ioc"]).alias("weight"))
    own = F.filter(F.split("cluster", ":"), lambda p: p.rlike(f"^{DOTTED_QUAD}$"))
    ips = found.select("cluster", F.array("src_ip", "dst_ip").alias("_ips")).union(found.select("cluster", F.slice(own, 1, 1))).distinct()
    each = ips.select("cluster", "_ips", F.posexplode("_ips").alias("_pos", "_addr")).filter("_addr IS NOT NULL")
    public = joins.geo_lookup(each, ranges, "_addr").filter("kind = 'public' AND country IS NOT NULL")
    first = public.groupBy("cluster", "_ips").agg(F.min_by("country", "_pos").alias("value"))
    geo = first.select("cluster", F.lit("geo").alias("signal"), "value", F.lit(WEIGHTS["geo"]).alias("weight"))
    beat = cadence(found, "cluster").select("cluster", F.lit("cadence").alias("signal"), F.col("cadence_s").cast("string").alias("value"), F.lit(WEIGHTS["cadence"]).alias("weight"))
    return reduce(DataFrame.unionByName, (tech, ioc, geo, beat)).distinct()


def shared_signals(vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """(left, right, signal, value, weight, total): what the pairs share that can reach `least` of the lighter total.

    Only the lighter incident's rarest signals, those without which `least` is out of reach, look for partners; so a common
    technique meets its holders only where it decides. Cadences c and d agree when the larger is at most
    max(3, 1.25 times the smaller); each looks in its own band of width 1.3 and in the two beside it.
    """
    log = F.floor(F.log(F.greatest(F.lit(2.4), F.col("value").cast("double"))) / F.log(F.lit(1.3))).cast("string")
    once = F.when(F.col("signal") == "geo", F.row_number().over(Window.partitionBy("cluster", "signal").orderBy("value")) == 1).otherwise(True)
    keyed = vectors.withColumns({"key": F.when(F.col("signal") == "cadence", log).otherwise(F.col("value")), "_mass": F.when(once, F.col("weight")).otherwise(0.0)})
    totals = keyed.groupBy("cluster").agg(F.sum("_mass").alias("total"))
    use = keyed.groupBy("signal", "key").agg(F.count(F.lit(1)).alias("_use"))
    rows = staged(keyed.join(totals, "cluster").join(use, ["signal", "key"]).drop("_mass"), "vectors")
    rarest = Window.partitionBy("cluster").orderBy("_use", "signal", "key", "value").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    need = least * F.greatest(F.lit(1.0), F.col("total")) - 1e-9
    seeds = rows.withColumn("_rest", F.sum("weight").over(rarest)).filter(F.col("_rest") >= need).drop("_rest")
    near = F.when(F.col("signal") == "cadence", F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: (F.col("key").cast("int") + d).cast("string"))).otherwise(F.array("key"))
    wide = rows.withColumn("key", F.explode(near))
    a, b = seeds.alias("a"), wide.alias("b")
    lighter = F.struct("a.total", "a.cluster") < F.struct("b.total", "b.cluster")
    pairs = a.join(b, (F.col("a.signal") == F.col("b.signal")) & (F.col("a.key") == F.col("b.key")) & lighter).select(F.col("a.cluster").alias("_light"), F.col("b.cluster").alias("_heavy"), F.col("a.total").alias("total")).distinct()
    light, heavy = rows.select(F.col("cluster").alias("_light"), "signal", "key", "value", "weight").alias("a"), wide.select(F.col("cluster").alias("_heavy"), "signal", "key", F.col("value").alias("_other")).alias("b")
    both = pairs.join(light, "_light").join(heavy, ["_heavy", "signal", "key"])
    lo, hi = (f(F.col("value").cast("double"), F.col("_other").cast("double")) for f in (F.least, F.greatest))
    same = F.when(F.col("signal") == "cadence", hi <= F.greatest(F.lit(3.0), 1.25 * lo)).otherwise(F.col("value") == F.col("_other"))
    return both.filter(same).select(F.least("_light", "_heavy").alias("left"), F.greatest("_light", "_heavy").alias("right"), "signal", "value", "weight", "total")


def linked_pairs(vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """Incident pairs that share at least `least` of the lighter one's signal weight; `signals` says what they share."""
    once = F.when(F.col("signal") != "geo", F.col("weight")).otherwise(0.0)
    geo = F.coalesce(F.max(F.when(F.col("signal") == "geo", F.col("weight"))), F.lit(0.0))
    pairs = shared_signals(vectors, least).groupBy("left", "right", "total").agg((F.sum(once) + geo).alias("shared"), F.collect_list(F.struct("signal", "value", "weight")).alias("signals"))
    confidence = F.least(F.lit(1.0), F.col("shared") / F.greatest(F.lit(1.0), F.col("total")))
    return pairs.filter(confidence >= least).select("left", "right", "shared", F.round(confidence, 4).alias("confidence"), "signals")
