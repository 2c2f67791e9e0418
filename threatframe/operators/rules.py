"""Detection rules as data, and their evaluation over an event table.

A rule selects events (equality, status and type lists, message pattern), groups them and fires when some look-back
window of a group holds enough events (or enough different values of a field). The best window of each group becomes a
detection with up to 50 events of evidence.

All rules are evaluated in one scan. Windows are computed in time buckets of one window's length: an event takes part in
its own bucket and, as context, in the next one. A busy key is thus spread over its buckets instead of standing in one
task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatframe.functions.staging import staged
from threatframe.operators.scoring import DOTTED_QUAD

EVIDENCE = 50
EXCERPT = 160
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

#: Names that rules may use for event columns.
ALIASES = {"source_ip": "src_ip", "destination_ip": "dst_ip", "destination_port": "dst_port", "source_port": "src_port"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str = ""
    category: str = "Unknown"
    severity: str = "MEDIUM"
    match: Mapping = field(default_factory=dict)
    statuses: tuple = ()
    event_types: tuple = ()
    regex: str | None = None
    group_by: tuple = ("src_ip",)
    metric: str = "count"
    distinct_field: str | None = None
    threshold: int = 1
    window: str = "5m"
    then_success: bool = False

    @property
    def seconds(self) -> int:
        return int(self.window[:-1]) * _UNITS[self.window[-1]]


def parse_rules(raw: Iterable[Mapping]) -> list[Rule]:
    """Rules from plain mappings (such as a YAML list); one that cannot be read is left out."""
    names, out = {f.name for f in fields(Rule)}, []
    column = lambda c: ALIASES.get(c, c)
    for r in raw:
        try:
            r = {k: v for k, v in r.items() if k in names}
            r["match"] = {column(k): v for k, v in (r.get("match") or {}).items()}
            r["group_by"] = tuple(map(column, r.get("group_by") or ["src_ip"]))
            for k in ("statuses", "event_types"):
                r[k] = tuple(str(x).lower() for x in r.get(k) or ())
            if r.get("distinct_field"):
                r["distinct_field"] = column(r["distinct_field"])
            if r.get("regex"):
                re.compile(r["regex"])
            rule = Rule(**r)
            if rule.seconds > 0 and int(rule.threshold) > 0:
                out.append(rule)
        except (KeyError, TypeError, ValueError, re.error):
            continue
    return out


def condition(rule: Rule) -> Column:
    """The events that a rule looks at, as one expression that a scan can evaluate."""
    parts = [F.col(c) == v for c, v in rule.match.items()]
    if rule.statuses:
        parts.append(F.lower(F.coalesce("status", F.lit(""))).isin(*rule.statuses))
    if rule.event_types:
        parts.append(F.lower(F.coalesce("event_type", F.lit(""))).isin(*rule.event_types))
    if rule.regex:
        parts.append(F.coalesce("message", F.lit("")).rlike(f"(?i){rule.regex}"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _parts(rule: Rule) -> list[Column]:
    return [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")) for c in rule.group_by]


def _entity(rule: Rule) -> Column:
    return F.array(*_parts(rule))


def _known(rule: Rule) -> Column:
    return reduce(lambda a, b: a | b, (p != "-" for p in _parts(rule)), F.lit(False))


def grouped(events: DataFrame, rule: Rule) -> DataFrame:
    """The rule's events with `entity`: an array of key values, '-' for unknown; rows without any are dropped."""
    return events.filter(condition(rule)).filter(_known(rule)).withColumn("entity", _entity(rule))


def tagged(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, entity, field, event_id, ts, src_ip, dst_ip, hostname, message): a row for every event and rule that looks at it.

    One scan evaluates all rules; `rule` is a place in `rules`, `field` what a distinct rule counts.
    """
    tags = []
    for k, r in enumerate(rules):
        field = F.col(r.distinct_field or "dst_port").cast("string") if r.metric == "distinct" else F.lit(None).cast("string")
        tags.append(F.when(condition(r) & _known(r), F.struct(F.lit(k).alias("rule"), _entity(r).alias("entity"), field.alias("field"))))
    rows = events.withColumn("_tag", F.explode(F.array(*tags))).filter("_tag IS NOT NULL")
    return rows.select("_tag.*", "event_id", "ts", "src_ip", "dst_ip", "hostname", "message")


def of_rule(rules: Sequence[Rule], value) -> Column:
    """value(rule) of the row's rule."""
    return F.element_at(F.array(*(F.lit(value(r)) for r in rules)), F.col("rule") + 1)


def counted(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Timed rows of (rule, entity, ts, field, ...) with `value` (events, or different fields, in the look-back window)
    and `started` (the window's first event).

    An event adds one at its time and takes it back when the window has passed it; a running sum over both is the
    window's count, in one pass whatever the window holds. For different values an event adds only where its value was
    not in the window, and takes back only where the value does not come again. Windows are closed at both ends.
    Rows that `merged` made count for as many events as they stand for.
    """
    part = ["rule", "entity", "_bucket"]
    us = F.unix_micros("ts")
    rows = rows.filter("ts IS NOT NULL").withColumns({"_us": us, "_w": of_rule(rules, lambda r: r.seconds * 1_000_000)})
    rows = rows.withColumn("_own", F.expr("_us div _w")).withColumn("_bucket", F.explode(F.array("_own", F.col("_own") + 1)))
    rows = rows.repartition(*part)  # one exchange for the three windows
    by_time = Window.partitionBy(*part).orderBy("_us")
    rows = rows.withColumn("_next", F.lead("_us").over(by_time))
    fresh = ends = many = F.col("_n") if "_n" in rows.columns else F.lit(1)
    if any(r.metric == "distinct" for r in rules):
        same = Window.partitionBy(*part, "field").orderBy("_us")
        before, after = F.col("_us") - F.lag("_us").over(same), F.lead("_us").over(same) - F.col("_us")
        known, distinct = F.col("field").isNotNull(), of_rule(rules, lambda r: r.metric == "distinct")
        fresh = F.when(~distinct, many).when(known & (before.isNull() | (before > F.col("_w"))), 1).otherwise(0)
        ends = F.when(~distinct, many).when(known & (after.isNull() | (after > F.col("_w"))), 1).otherwise(0)
    rows = rows.withColumns({"_fresh": fresh, "_ends": ends})
    begin = F.struct((2 * F.col("_us")).alias("at"), F.col("_fresh").alias("step"), F.lit(None).cast("long").alias("left"))
    over = F.struct((2 * (F.col("_us") + F.col("_w")) + 1).alias("at"), (-F.col("_ends")).alias("step"), F.coalesce("_next", F.lit(1 << 62)).alias("left"))
    # no window of its own bucket, which is one length long (the one around 1970 is two), has passed an event
    stays = (F.col("_own") == F.col("_bucket")) & (F.col("_us") >= 0)
    rows = rows.withColumn("_s", F.explode(F.when(stays, F.array(begin)).otherwise(F.array(begin, over))))
    so_far = Window.partitionBy(*part).orderBy("_s.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce(F.max("_s.left").over(so_far), F.min("_us").over(so_far))  # what followed the last event that has left
    rows = rows.withColumns({"value": F.sum("_s.step").over(so_far).cast("long"), "started": F.timestamp_micros(first)})
    return rows.filter("_s.left IS NULL AND _own = _bucket").drop("_us", "_w", "_own", "_bucket", "_next", "_fresh", "_ends", "_s")


def merged(rows: DataFrame) -> DataFrame:
    """Timed rows that are alike in all columns (rule, entity, ts, field and so on) as one, with their number `_n`: enough for
    the best window, and no more than the time stamps of an entity, however many events share one."""
    return rows.filter("ts IS NOT NULL").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))


def sliding(df: DataFrame, rule: Rule) -> DataFrame:
    """The rule's timed rows with `value` (events, or different values, in the look-back window) and `started`."""
    return counted(_as_rows(df, rule), [rule]).drop("rule", "field")


def _best(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, entity, value, started, ended): the best look-back window of every firing group, the earliest of equals."""
    return best_of(counted(merged(rows.select("rule", "entity", "ts", "field")), rules), rules)


def best_of(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The best window of every group among counted rows, where it reaches the threshold."""
    firing = rows.filter(F.col("value") >= of_rule(rules, lambda r: r.threshold))
    top = F.max(F.struct("value", (-F.unix_micros("ts")).alias("early"), F.struct("started", "ts").alias("w"))).alias("t")
    return firing.groupBy("rule", "entity").agg(top).select("rule", "entity", F.col("t.value").alias("value"), F.col("t.w.started").alias("started"), F.col("t.w.ts").alias("ended"))


def timeless_groups(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Firing groups (of rows as `tagged` gives them) without any time stamp, judged as a whole."""
    g = rows.groupBy("rule", "entity").agg(F.count("ts").alias("timed"), F.count(F.lit(1)).alias("n"), F.count_distinct("field").alias("different"))
    value, least = F.when(of_rule(rules, lambda r: r.metric == "distinct"), F.col("different")).otherwise(F.col("n")), of_rule(rules, lambda r: r.threshold)
    stamp = F.lit(None).cast("timestamp")
    return g.withColumn("value", value).filter((F.col("timed") == 0) & (F.col("n") >= least) & (F.col("value") >= least)).select("rule", "entity", "value", stamp.alias("started"), stamp.alias("ended"))


def _as_rows(df: DataFrame, rule: Rule) -> DataFrame:
    return df.withColumns({"rule": F.lit(0), "field": F.col(rule.distinct_field or "dst_port").cast("string") if rule.metric == "distinct" else F.lit(None).cast("string")})


def best_windows(df: DataFrame, rule: Rule) -> DataFrame:
    """One row per firing group: entity, value, started, ended. Ties go to the earliest end."""
    return _best(_as_rows(df, rule), [rule]).drop("rule")


def timeless(df: DataFrame, rule: Rule) -> DataFrame:
    """Firing groups without any time stamp, judged as a whole."""
    return timeless_groups(_as_rows(df, rule), [rule]).drop("rule")


def inside(hits: DataFrame, rows: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The rows of each hit's window, found again by its bounds."""
    within = (F.col("h.ended").isNull() & F.col("e.ts").isNull()) | F.col("e.ts").between(F.col("h.started"), F.col("h.ended"))
    same = reduce(lambda a, b: a & b, (F.col(f"h.{k}") == F.col(f"e.{k}") for k in keys))
    return hits.alias("h").join(rows.alias("e"), same & within).select("h.*", *(f"e.{c}" for c in rows.columns if c not in keys))


def evidence_of(hits: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds what a hit's window holds: evidence, has_address and targets; see `with_evidence`."""
    return evidence_in(inside(hits, rows.select(*keys, "event_id", "ts", "dst_ip", "message"), keys), keys)


def evidence_in(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`evidence_of`, of hits joined to the rows of their windows."""
    address = F.coalesce(F.col("message").rlike(DOTTED_QUAD), F.lit(False))
    both = both.withColumns({"excerpt": F.substring("message", 1, EXCERPT), "_address": address})
    facts = both.groupBy(*keys).agg(F.bool_or("_address").alias("has_address"), F.count_distinct("dst_ip").alias("targets"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    first = both.withColumn("nth", nth).filter(F.col("nth") <= EVIDENCE)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id", "ts", "excerpt"))), lambda s: s.dropFields("nth"))
    return first.groupBy(*keys, "value", "started", "ended").agg(shown.alias("evidence")).join(facts, list(keys))


def with_evidence(hits: DataFrame, df: DataFrame) -> DataFrame:
    """Adds, from each hit's window: evidence (the first events, to show), has_address (whether any event of it names an
    address) and targets (different dst_ip)."""
    return evidence_of(hits, df, ["entity"])


def window_events(found: DataFrame, events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, entity, event_id, ts, src_ip, dst_ip, hostname, message): every event in the window of each detection, one row each, uncut."""
    rules = list(rules)
    rows = tagged(events, rules).withColumn("rule_id", of_rule(rules, lambda r: r.rule_id)).drop("rule", "field")
    return inside(found.select("rule_id", "entity", "started", "ended"), rows, ["rule_id", "entity"]).drop("started", "ended")


def success_followup(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Adds followed_by and followed_at: the first auth_success from the entity's first key at or after the end."""
    keys = [k for k in ("rule", "entity") if k in hits.columns]
    ok = events.filter("event_type = 'auth_success'").select(F.col("src_ip").alias("_src"), F.col("ts").alias("_at"), F.coalesce("username", "src_ip").alias("_who"))
    found = hits.select(*keys, "ended", F.element_at("entity", 1).alias("_src")).join(ok, "_src").filter(F.col("_at") >= F.col("ended"))
    found = found.groupBy(*keys).agg(F.min(F.struct("_at", "_who")).alias("f"))
    return hits.join(found, keys, "left").select(*hits.columns, F.col("f._who").alias("followed_by"), F.col("f._at").alias("followed_at"))


def evaluate(events: DataFrame, rules: Iterable[Rule], known: DataFrame | None = None) -> DataFrame:
    """Detections of all rules, without those whose (rule_id, entity) is known already.

    The events are scanned once, for all rules together; what some rule looks at is written, and windows, evidence and
    whole groups are taken from there.
    """
    rules = list(rules)
    rows = staged(tagged(events, rules), "tagged")
    hits = staged(_best(rows, rules).unionByName(timeless_groups(rows, rules)), "hits")
    hits = evidence_of(hits, rows, ["rule", "entity"])
    followed = of_rule(rules, lambda r: r.then_success)
    none = {"followed_by": F.lit(None).cast("string"), "followed_at": F.lit(None).cast("timestamp")}
    hits = hits.filter(~followed).withColumns(none).unionByName(success_followup(hits.filter(followed), events)) if any(r.then_success for r in rules) else hits.withColumns(none)
    out = reported(hits, rules)
    return new_detections(out, known) if known is not None else out


def reported(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Detections as they are shown, of hits (rule, entity, value, started, ended, evidence, has_address, targets, followed_by,
    followed_at) with the rule's place in `rules`."""
    least = of_rule(rules, lambda r: r.threshold)
    reason = F.format_string("+%d %d matching events (threshold %d, window %s)", F.least(F.lit(30), 10 + 4 * F.col("value")).cast("int"), "value", least, of_rule(rules, lambda r: r.window))
    note = F.when(F.col("followed_by").isNotNull(), F.concat(F.lit("+ successful authentication followed ("), "followed_by", F.lit(")")))
    return hits.select(
        *(of_rule(rules, lambda r, k=k: getattr(r, k)).alias(k) for k in ("rule_id", "name", "category", "severity", "threshold")),
        F.split(of_rule(rules, lambda r: ",".join(r.group_by)), ",").alias("entity_type"), "entity", "value", "started", "ended", "evidence", "has_address", "targets", "followed_by", "followed_at",
        F.array_compact(F.array(reason, note)).alias("reasons"),
    )


def detect(events: DataFrame, rule: Rule) -> DataFrame:
    """All detections of one rule."""
    return evaluate(events, [rule])


def new_detections(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("rule_id", "entity").distinct(), ["rule_id", "entity"], "left_anti")
