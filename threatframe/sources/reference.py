"""Reference data from files: rules, feed, address ranges, controls, techniques, playbook and policy.

Tables are read by Spark, so they may be of any size and lie anywhere that Spark reads from; rules and policies, which
become parts of a plan, are short lists and come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.operators.alerts import AlertRule, parse_alert_rules
from threatframe.operators.indicators import MAPPED, ip_key, policy_of
from threatframe.operators.rules import Rule, parse_rules

RULE = "rule_id string, name string, category string, severity string, match map<string,string>, statuses array<string>, event_types array<string>, regex string, group_by array<string>, metric string, distinct_field string, threshold int, window string, then_success boolean"
ALERT_RULE = "rule_id string, source string, severity string, match_rule string, match_category string, min_risk int, min_confidence double, threshold int, asset_type string, min_criticality string"


def _mappings(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Detection rules from JSON lines; one that cannot be read is left out."""
    return parse_rules(_mappings(spark.read.schema(RULE).json(path).filter("rule_id IS NOT NULL")))


def load_alert_rules(spark: SparkSession, path: str, base: tuple = ()) -> list[AlertRule]:
    """Alert rules from JSON lines, on top of base rules."""
    return parse_alert_rules(_mappings(spark.read.schema(ALERT_RULE).json(path).filter("rule_id IS NOT NULL")), base)


def load_feed(spark: SparkSession, path: str) -> DataFrame:
    """value, threat_type, confidence from CSV with a header; of equal values the surest entry."""
    df = spark.read.option("header", True).csv(path)
    rows = df.select(F.lower(F.trim("value")).alias("value"), "threat_type", F.col("confidence").try_cast("double").alias("confidence")).filter("value <> '' AND confidence IS NOT NULL")
    return rows.groupBy("value").agg(F.max(F.struct("confidence", "threat_type")).alias("b")).select("value", "b.threat_type", "b.confidence")


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """lo, hi, country, kind from CSV with first, last, country and kind; bounds are IPv4 or IPv6 addresses of one family, and
    become keys (`ip_key`). Ranges may overlap and nest. A line whose bounds cannot be read is left out."""
    df = spark.read.option("header", True).csv(path)
    keys = df.select(ip_key(F.trim("first")).alias("lo"), ip_key(F.trim("last")).alias("hi"), "country", "kind").filter("lo <= hi")
    return keys.filter(F.col("lo").startswith(MAPPED) == F.col("hi").startswith(MAPPED))


def load_controls(spark: SparkSession, path: str) -> DataFrame:
    """framework, control, severity, metric, operator, bound from CSV with a header."""
    df = spark.read.option("header", True).csv(path)
    return df.select("framework", "control", F.lower("severity").alias("severity"), "metric", "operator", F.col("bound").try_cast("long").alias("bound")).filter("bound IS NOT NULL AND operator IN ('le', 'ge', 'gt', 'eq')")


def load_techniques(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, place, technique, tactic from CSV with a header."""
    return spark.read.option("header", True).csv(path).select("rule_id", F.col("place").try_cast("int").alias("place"), "technique", F.lower("tactic").alias("tactic"))


def load_playbook(spark: SparkSession, path: str) -> DataFrame:
    """category, nth, action from CSV with a header."""
    return spark.read.option("header", True).csv(path).select("category", F.col("nth").try_cast("int").alias("nth"), "action")


def load_policy(spark: SparkSession, path: str) -> dict[str, str]:
    """A privacy policy from CSV with category and action, over the default one; an unknown action is refused."""
    return policy_of({r.category: r.action for r in spark.read.option("header", True).csv(path).collect()})
