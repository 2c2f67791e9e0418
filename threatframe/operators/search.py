"""Typed event filters, listings, status logs and identity of events."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT = ("message", "src_ip", "dst_ip", "username")


def contains(needle: str, columns: list[str] | tuple = TEXT) -> Column:
    """Whether one of the columns holds the text, upper and lower case alike."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(needle.lower())) for c in columns])


def phrase(words: str, column: str = "message") -> Column:
    """Whether the words follow one another as whole tokens."""
    tokens = [re.escape(t) for t in re.findall(r"[a-z0-9]+", words.lower())]
    return F.lower(column).rlike("(^|[^a-z0-9])" + "[^a-z0-9]+".join(tokens) + "([^a-z0-9]|$)")


@dataclass(frozen=True)
class EventFilter:
    """What an analyst can ask for; every part that is set narrows the result."""

    severity: str | None = None
    severities: tuple = ()
    threat: str | None = None
    auth: bool = False
    personal: bool = False
    ioc_type: str | None = None
    text: str | None = None
    since: str | None = None

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.severity:
            parts.append(F.col("severity") == self.severity)
        if self.severities:
            parts.append(F.col("severity").isin(*self.severities))
        if self.threat:
            parts.append(contains(self.threat, ["threat_type"]))
        if self.auth:
            parts.append(F.col("event_type").isin("auth_failure", "auth_success"))
        if self.personal:
            parts.append(F.size("pii_detected") > 0)
        if self.ioc_type:
            parts.append(F.exists("iocs", lambda i: i.type == self.ioc_type))
        if self.text:
            parts.append(contains(self.text))
        if self.since:
            parts.append(F.col("ts") >= F.lit(self.since).cast("timestamp"))
        return reduce(lambda a, b: a & b, parts)


def find(events: DataFrame, wanted: EventFilter) -> DataFrame:
    return events.filter(wanted.condition())


def page(df: DataFrame, offset: int, rows: int) -> DataFrame:
    """Newest first; ties by event_id."""
    return df.orderBy(F.desc("ts"), "event_id").offset(offset).limit(rows)


def by_severity(events: DataFrame, cited: DataFrame, severity: str) -> DataFrame:
    """Events of a severity, or cited by a detection of it. cited: an event_id per row, repeats allowed."""
    cited = cited.select("event_id").distinct().withColumn("_cited", F.lit(True))
    return events.join(cited, "event_id", "left").filter((F.col("severity") == severity) | F.coalesce("_cited", F.lit(False))).drop("_cited")


def latest_status(log: DataFrame, key: str, order: Column) -> DataFrame:
    """From a log of transitions: the last status, the first acknowledgement, the last resolution."""
    at = lambda s: F.when(F.col("status") == s, F.col("ts"))
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"), F.min(at("ACK")).alias("acked"), F.max(at("RESOLVED")).alias("resolved"))


def triage(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("created")).alias("oldest_us"))


def health_facts(events: DataFrame) -> DataFrame:
    """(fact, key, value): failures, severities, span and the five commonest messages as one table."""
    one = events.agg(F.count_if(F.col("status") == "failure").alias("failed"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    single = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), F.lit("").alias("key"), F.col(c).alias("value")) for c in one.columns))).alias("f")).select("f.*")
    counted = lambda c, fact: events.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(fact).alias("fact"), "key", "value")
    return single.unionByName(counted("severity", "severity")).unionByName(counted("message", "message").orderBy(F.desc("value"), "key").limit(5))


def deterministic_id(time: Column, host: Column, process: Column, raw: Column) -> Column:
    """The same line always gets the same id; an unknown time counts as a constant."""
    parts = F.concat_ws("|", F.coalesce(time, F.lit("NOTS")), F.coalesce(host, F.lit("")), F.coalesce(process, F.lit("")), F.coalesce(raw, F.lit("")))
    return F.substring(F.sha2(parts, 256), 1, 32)


def first_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per id, the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")


def type_shares(df: DataFrame, column: str, most: int) -> DataFrame:
    """(column, n, share of all rows in percent), the commonest first."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("share", F.round(100.0 * F.col("n") / total, 3)).orderBy(F.desc("n"), column).limit(most)
