"""Everything downstream of the events, kept up to date batch by batch: detections, incidents, assets, indicators, alerts.

Each kind is a keyed table (`functions/keyed.py`), and a batch changes only the keys that it touches:

* Detections. The rules' events lie in a log by entity. New events change the look-back windows that end at most a window's
  length after them, so only those are counted again, from three time buckets around the new events. A count never falls, so
  the best of the old best window and these is the best of all. Evidence is read for windows that changed; the first login
  after a window is looked up where the window moved, and compared with the batch's logins elsewhere.
* Incidents. The labels of connected components are merged: the new detections' edges between old labels are contracted and
  the labels that lose theirs are renamed. Only where an edge has gone (a login bridge that led elsewhere) is that component
  built again from its own detections. Incidents are computed again for components that changed.
* Assets and indicators. Facts of a batch are added to the facts so far.
* Alerts. Entities whose detections, incident, assets or indicator changed are judged again.

Batches may hold any events in any order. After each the tables equal the batch operators on all events so far.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedLog, KeyedTable
from threatframe.functions.staging import over_cores, staged, temporary, together
from threatframe.operators import alerts, correlate, reports, rules, scoring
from threatframe.operators.rules import Rule, of_rule

PAIR = ["rule", "entity"]
HIT = "rule int, entity array<string>, first string, value long, started timestamp, ended timestamp, evidence array<struct<event_id:{id},ts:timestamp,excerpt:string>>, has_address boolean, targets long, followed_by string, followed_at timestamp"
KEPT = ["evidence", "has_address", "targets", "followed_by", "followed_at"]


def _known_parts() -> Column:
    return F.filter("entity", lambda p: p != "-")


def edges_of(found: DataFrame) -> DataFrame:
    """(a, b): what ties an entity's parts, and the user of the login that followed, to its first known part."""
    rows = found.select(F.element_at(_known_parts(), 1).alias("a"), _known_parts().alias("_parts"), "followed_by")
    parts = F.array_compact(F.concat("_parts", F.array("followed_by")))
    return rows.select("a", F.explode(parts).alias("b")).distinct()


class Refresh:
    """State of one set of rules in one folder; `apply` is the body of a foreachBatch."""

    def __init__(self, spark: SparkSession, path: str, rule_set: Sequence[Rule], alert_rules: Sequence[alerts.AlertRule], feed: DataFrame, id_type: str = "bigint", buckets: int = 16):
        self.spark, self.rules, self.alert_rules, self.feed = spark, list(rule_set), list(alert_rules), feed
        table = lambda name, schema, key, by=None: KeyedTable(spark, f"{path}/{name}", schema, key, by, buckets)
        self.history = KeyedLog(spark, f"{path}/history", f"rule int, entity array<string>, first string, field string, event_id {id_type}, ts timestamp, src_ip string, dst_ip string, hostname string, message string", ("first",), buckets)
        self.logins = KeyedLog(spark, f"{path}/logins", "src_ip string, ts timestamp, username string", ("src_ip",), buckets)
        self.hits = table("hits", HIT.format(id=id_type), ("rule", "entity", "first"), ("first",))
        self.names = table("names", "rule int, entity array<string>, first string, name string", ("rule", "entity", "first"), ("first",))
        self.labels = table("labels", "node string, label string", ("node",))
        self.members = table("members", "cluster string, rule int, entity array<string>, first string", ("cluster",))
        self.cases = table("incidents", self._incident_schema(id_type), ("cluster",))
        self.touches = table("touches", "cluster string, name string", ("cluster",))
        self.facts = table("assets", "low string, name string, services array<string>, ports array<int>, named boolean, first_seen timestamp, last_seen timestamp, max_risk int, events long", ("low", "name"), ("low",))
        self.sightings = table("indicators", "value string, type string, threat string, related_events long, first_seen timestamp, last_seen timestamp, sure decimal(28,6)", ("value", "type", "threat"), ("value",))
        self.raised = table("alerts", "source string, entity string, alert_rule string, severity string, risk_score int, facts long, dedup_key string", ("source", "entity"))

    def _incident_schema(self, id_type: str) -> str:
        none = self.spark.createDataFrame([], HIT.format(id=id_type))
        df = correlate.incidents(self._scored(none).withColumn("cluster", F.lit("")))
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    # Reading

    def _scored(self, hits: DataFrame) -> DataFrame:
        return scoring.score_detections(rules.reported(hits, self.rules))

    def detections(self, at: int) -> DataFrame:
        return self._scored(self.hits.read(at))

    def incidents(self, at: int) -> DataFrame:
        return self.cases.read(at)

    def assets(self, at: int) -> DataFrame:
        return reports.assets_of(self.facts.read(at).drop("low"))

    def indicators(self, at: int) -> DataFrame:
        return alerts.indicators_of(self.sightings.read(at), self.feed)

    def alerts(self, at: int) -> DataFrame:
        return self.raised.read(at).drop("source")

    # One batch

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take a batch of events in. A batch that is applied again after a failure gives the same tables."""
        with temporary(self.spark):
            batch = staged(over_cores(batch), "batch")

            def cases() -> tuple[DataFrame, DataFrame]:
                changed = staged(self._detect(batch, number), "changed")
                return changed, staged(self._correlate(changed, number), "clusters")

            (changed, clusters), assets, values = together(cases, lambda: staged(self._assets(batch, number), "assets"), lambda: staged(self._indicators(batch, number), "values"))
            self._alert(changed, clusters, assets, values, number)

    def _detect(self, batch: DataFrame, number: int) -> DataFrame:
        """Update hits; returns (rule, entity, first, was, now) of hits that changed, was and now their edges."""
        tagged = rules.tagged(batch, self.rules).withColumn("first", F.element_at("entity", 1))
        success = batch.filter("event_type = 'auth_success' AND src_ip IS NOT NULL").select("src_ip", "ts", F.coalesce("username", "src_ip").alias("username"))
        together(lambda: self.history.append(number, tagged), lambda: self.logins.append(number, success))
        rows, logins = self.history.batch(number), self.logins.batch(number)
        touched = staged(rows.select(*PAIR, "first").distinct(), "touched")
        # of the entities' history, what can share a window with the new events; the log's files are pruned by time
        ends = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
        reach = F.expr(f"INTERVAL {2 * max(r.seconds for r in self.rules)} SECONDS")
        recent = F.col("ts").between(F.lit(ends.first) - reach, F.lit(ends.last) + reach) if ends.first else F.lit(False)
        near = self.history.of(touched.select("first"), number).filter(recent)
        old = staged(self.hits.of(touched, number - 1), "old")
        # windows that end in an affected bucket, from the bucket before it on
        width = of_rule(self.rules, lambda r: r.seconds * 1_000_000)
        bucket = F.call_function("div", F.unix_micros("ts"), width)
        around = F.explode(F.array(*(F.struct((bucket + d).alias("span"), F.lit(d >= 0).alias("near")) for d in (-1, 0, 1))))
        spans = rows.filter("ts IS NOT NULL").select(*PAIR, around.alias("s")).groupBy(*PAIR, "s.span").agg(F.bool_or("s.near").alias("near"))
        context = near.select(*PAIR, "ts", "field", bucket.alias("span")).join(spans, [*PAIR, "span"])
        fresh = rules.best_of(rules.counted(rules.merged(context), self.rules).filter("near"), self.rules)
        both = fresh.withColumn("fresh", F.lit(1)).unionByName(old.filter("ended IS NOT NULL").select(*PAIR, "value", "started", "ended").withColumn("fresh", F.lit(0)))
        best = F.max(F.struct("value", (-F.unix_micros("ended")).alias("early"), "fresh", "started", "ended")).alias("b")
        best = both.groupBy(*PAIR).agg(best).select(*PAIR, "b.value", "b.started", "b.ended", "b.fresh")
        # groups without any time stamp are judged whole
        untimed = rows.filter("ts IS NULL").select(*PAIR, "first").union(old.filter("ended IS NULL").select(*PAIR, "first")).distinct()
        apart = staged(self.history.of(untimed.select("first"), number).join(untimed.select(*PAIR), PAIR, "left_semi"), "apart")
        whole = rules.timeless_groups(apart, self.rules)
        hits = staged(best.filter("fresh = 1").drop("fresh").unionByName(whole), "hits")
        past = self.history.of(hits.select(F.element_at("entity", 1).alias("first")), number).filter(recent | F.col("ts").isNull())
        past = past.select(*PAIR, "event_id", "ts", "src_ip", "dst_ip", "hostname", "message")
        held = staged(rules.inside(hits, past, PAIR), "held")  # of the history, only what lies in windows that changed is written
        hits = staged(rules.evidence_in(held, PAIR), "evident")
        follow = of_rule(self.rules, lambda r: r.then_success)
        events = self.logins.of(hits.filter(follow).select(F.element_at("entity", 1).alias("src_ip")), number).withColumn("event_type", F.lit("auth_success"))
        none = {"followed_by": F.lit(None).cast("string"), "followed_at": F.lit(None).cast("timestamp")}
        new = rules.success_followup(hits.filter(follow), events).unionByName(hits.filter(~follow).withColumns(none))
        new = staged(new.withColumn("first", F.element_at("entity", 1)), "new")
        # logins of this batch after windows that stay
        sources = logins.select(F.col("src_ip").alias("first")).distinct()
        stay = self.hits.of(sources, number - 1).filter(follow).join(new.select(*PAIR), PAIR, "left_anti")
        after = stay.join(logins.toDF("first", "at", "who"), "first").filter("at >= ended").groupBy(*PAIR).agg(F.min(F.struct("at", "who")).alias("f"))
        known = F.when(F.col("followed_at").isNotNull(), F.struct(F.col("followed_at").alias("at"), F.col("followed_by").alias("who")))
        moved = stay.join(after, PAIR).withColumn("f", F.least("f", known)).filter(~F.col("f").eqNullSafe(known))
        moved = moved.withColumns({"followed_by": F.col("f.who"), "followed_at": F.col("f.at")}).drop("f")
        rows_now = staged(new.unionByName(moved.select(*new.columns)), "now")
        lost = old.filter("ended IS NULL").join(rows_now.select(*PAIR), PAIR, "left_anti")
        gone = rows_now.select(*PAIR, "first").unionByName(lost.select(*PAIR, "first")).distinct()
        before = staged(self.hits.of(gone, number - 1), "before")
        seen = held.select(*PAIR, F.element_at("entity", 1).alias("first"), F.explode(F.array("src_ip", "dst_ip", "hostname")).alias("name")).withColumn("name", F.lower(F.trim("name")))
        together(
            lambda: self.hits.replace(number, rows_now, gone),
            lambda: self.names.replace(number, seen.filter("name <> ''").distinct(), new.select(*PAIR, "first").unionByName(lost.select(*PAIR, "first"))),
        )
        was = before.select(*PAIR, F.col("followed_by").alias("was"))
        now = rows_now.select(*PAIR, F.col("followed_by").alias("now"), F.lit(True).alias("stands"))
        return gone.join(was, PAIR, "left").join(now, PAIR, "left").withColumn("stands", F.coalesce("stands", F.lit(False)))

    def _correlate(self, changed: DataFrame, number: int) -> DataFrame:
        """Update labels, members, incidents and touched names; returns the clusters that changed, came or went."""
        at = number - 1
        now = edges_of(changed.filter("stands").select("entity", F.col("now").alias("followed_by")))
        lost = staged(edges_of(changed.select("entity", F.col("was").alias("followed_by"))).join(now, ["a", "b"], "left_anti"), "lost")
        label = lambda nodes: self.labels.of(nodes.select("node").distinct(), at)
        broken = staged(label(lost.select(F.col("a").alias("node"))).select(F.col("label").alias("cluster")).distinct(), "broken")
        refs = staged(self.members.of(broken, at).select("rule", "entity", "first"), "refs")
        inner = edges_of(self.hits.of(refs, number))
        edges = staged(now.union(inner).distinct(), "edges")
        ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        loose = broken.select(F.col("cluster").alias("label"))
        stand = staged(label(ends).join(loose, "label", "left_anti").select("node", "label"), "stand")
        to = ends.join(stand, "node", "left").select("node", F.coalesce("label", "node").alias("at"))
        merged = edges.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        found = staged(correlate.components(merged), "found")  # (node, label) of old labels and of nodes without one
        olds = staged(stand.select(F.col("label").alias("cluster")).union(broken).distinct(), "olds")
        was = staged(self.members.of(olds, at), "was")
        # what a member's place is now: its cluster as a node of `found`, or where that was broken, its own first part
        kept = was.join(broken, "cluster", "left_anti").select(*PAIR, "first", F.col("cluster").alias("by_cluster"))
        free = was.join(broken, "cluster", "left_semi").unionByName(changed.filter("stands").join(was, PAIR, "left_anti").select(*PAIR, "first"), allowMissingColumns=True)
        every = kept.unionByName(free.select(*PAIR, "first", F.lit(None).cast("string").alias("by_cluster"))).join(changed.filter("NOT stands").select(*PAIR), PAIR, "left_anti")
        every = every.withColumn("node", F.element_at(_known_parts(), 1)).join(to.withColumnRenamed("at", "by_node"), "node", "left").withColumn("at", F.coalesce("by_cluster", "by_node"))
        every = every.join(found.toDF("at", "cluster"), "at").select("cluster", *PAIR, "first")
        every = staged(every, "members")
        gone = staged(olds.union(every.select("cluster")).distinct(), "gone")
        hits = staged(self.hits.of(every.select("rule", "entity", "first"), number).join(every.select("cluster", *PAIR), PAIR), "hits")
        nodes = hits.select("cluster", F.explode(F.array_compact(F.concat(_known_parts(), F.array("followed_by")))).alias("node")).select("node", F.col("cluster").alias("label")).distinct()
        names = self.names.of(every.select("rule", "entity", "first"), number).join(every.select("cluster", *PAIR), PAIR).select("cluster", "name")
        names = names.union(every.select("cluster", F.lower(F.trim("cluster")))).distinct()
        together(
            lambda: self.members.replace(number, every, gone),
            lambda: self.labels.replace(number, nodes, lost.select(F.col("b").alias("node"))),
            lambda: self.cases.replace(number, correlate.incidents(self._scored_in(hits)), gone),
            lambda: self.touches.replace(number, names, gone),
        )
        return gone

    def _scored_in(self, hits: DataFrame) -> DataFrame:
        clusters = hits.select(of_rule(self.rules, lambda r: r.rule_id).alias("rule_id"), "entity", "cluster")
        return self._scored(hits.drop("cluster")).join(clusters, ["rule_id", "entity"])

    def _assets(self, batch: DataFrame, number: int) -> DataFrame:
        """Add a batch's facts; returns the names whose type or criticality changed."""
        more = staged(reports.asset_facts(batch).withColumn("low", F.lower("name")), "facts")
        old = staged(self.facts.of(more.select("low", "name"), number - 1), "old")
        new = staged(reports.merged_facts(old.unionByName(more)).withColumn("low", F.lower("name")), "merged")
        self.facts.replace(number, new)
        kind = lambda df: reports.assets_of(df).select("name", "asset_type", "criticality")
        return kind(new).exceptAll(kind(old)).select(F.lower("name").alias("name")).distinct()

    def _indicators(self, batch: DataFrame, number: int) -> DataFrame:
        """Add a batch's sightings; returns the values that it saw."""
        more = staged(alerts.indicator_facts(batch), "sightings")
        old = self.sightings.of(more.select("value", "type", "threat"), number - 1)
        self.sightings.replace(number, alerts.merged_indicator_facts(old.unionByName(more)))
        return more.select("value").distinct()

    def _alert(self, changed: DataFrame, clusters: DataFrame, assets: DataFrame, values: DataFrame, number: int) -> None:
        entity = F.array_join("entity", ":")
        named = changed.select(entity.alias("entity")).distinct()
        firsts = changed.select("first").distinct()
        found = self._scored(self.hits.of(firsts, number)).join(named.withColumnRenamed("entity", "_e"), entity == F.col("_e"), "left_semi")
        near = self.touches.read(number).join(assets, "name", "left_semi").select("cluster")
        clusters = staged(clusters.union(near).distinct(), "clusters")
        cases = staged(self.cases.of(clusters, number), "cases")
        touched = staged(self.touches.of(clusters, number).withColumnRenamed("name", "low"), "touched")
        known = reports.assets_of(self.facts.of(touched.select("low"), number))
        touched = touched.join(known, "low").select("cluster", "name", "asset_type", "criticality")
        seen = alerts.indicators_of(self.sightings.of(values, number), self.feed)
        parts = {"detection": named, "incident": clusters.select(F.col("cluster").alias("entity")), "ioc": values.select(F.col("value").alias("entity"))}
        new, gone = [], []
        for source, keys in parts.items():
            own = [r for r in self.alert_rules if r.source == source]
            gone.append(keys.select(F.lit(source).alias("source"), "entity"))
            if own:
                new.append(alerts.candidates(own, found, cases, seen, touched).withColumn("source", F.lit(source)))
        if new:
            self.raised.replace(number, reduce(DataFrame.unionByName, new), reduce(DataFrame.unionByName, gone))
