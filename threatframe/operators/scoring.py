"""Transparent scores of detections and incidents: every point comes from a named factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SEVERITY_POINTS = {"LOW": 5, "MEDIUM": 12, "HIGH": 20, "CRITICAL": 30}
BANDS = ((80, "CRITICAL"), (50, "HIGH"), (20, "MEDIUM"))
CRITICAL_CATEGORIES = ("command execution", "malware")
TAXONOMY = ("Brute Force", "Credential Attack", "Reconnaissance", "Port Scanning", "Malware", "Phishing", "Web Attack", "Data Exfiltration", "Privilege Escalation", "Command Execution", "Persistence", "Lateral Movement", "Unknown")
DOTTED_QUAD = r"([0-9]{1,3}\.){3}[0-9]{1,3}"


def lookup(column: Column, table: dict, otherwise) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(otherwise))


def band(score: Column) -> Column:
    out = F.lit("LOW")
    for floor, name in reversed(BANDS):
        out = F.when(score > floor, name).otherwise(out)
    return out


def normalize_category(category: Column) -> Column:
    return lookup(F.lower(F.trim(F.coalesce(category, F.lit("")))), {t.lower(): t for t in TAXONOMY}, "Unknown")


def score_detections(found: DataFrame, targets: Column | None = None) -> DataFrame:
    """Adds risk_score (0 to 100) and appends one reason per factor. targets: different targets, by default those that the
    detection's window holds."""
    targets = F.col("targets") if targets is None else targets
    size = F.size("evidence")
    over = F.greatest(F.lit(0), F.col("value") - F.col("threshold"))
    factors = {
        "severity of the rule": lookup(F.upper("severity"), SEVERITY_POINTS, 10),
        "events over the threshold": F.least(F.lit(20), over * 3 + F.when(F.col("value") >= F.col("threshold"), 5).otherwise(0)),
        "IOC named in the window": F.when(F.col("has_address"), 10).otherwise(0),
        "login succeeded afterwards": F.when(F.col("followed_by").isNotNull(), 15).otherwise(0),
        "different targets": F.least(F.lit(10), targets * 2),
        "size of the evidence": F.least(F.lit(5), F.floor(size / 5)),
    }
    points = {k: v.cast("int") for k, v in factors.items()}
    reasons = F.filter(F.array(*(F.when(p > 0, F.concat(F.lit("+"), p.cast("string"), F.lit(f" {k}"))) for k, p in points.items())), lambda x: x.isNotNull())
    total = sum(points.values(), F.lit(0))
    return found.withColumns({"risk_score": F.least(F.lit(100), total).cast("int"), "reasons": F.concat("reasons", reasons)})


def classify_detections(scored: DataFrame) -> DataFrame:
    bad = (F.upper("severity").isin("CRITICAL", "HIGH")) | F.lower("category").isin(*CRITICAL_CATEGORIES) | (F.col("risk_score") >= 51)
    odd = (F.col("risk_score") >= 21) | (F.upper("severity") == "MEDIUM")
    return scored.withColumn("classification", F.when(bad, "MALICIOUS").when(odd, "SUSPICIOUS").otherwise("BENIGN"))


def halve_false_positives(df: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Feedback: rows whose latest status is FALSE_POSITIVE keep half their risk, at least 1, with one reason."""
    wrong = status.filter("status = 'FALSE_POSITIVE'").select(key).distinct().withColumn("false_positive", F.lit(True))
    out = df.join(wrong, key, "left").withColumn("false_positive", F.coalesce("false_positive", F.lit(False)))
    note = F.lit("risk halved: marked as a false positive")
    return out.withColumns(
        {"risk_score": F.when(F.col("false_positive"), F.greatest(F.lit(1), F.floor(F.col("risk_score") / 2)).cast("int")).otherwise(F.col("risk_score")),
         "reasons": F.when(F.col("false_positive"), F.array_union("reasons", F.array(note))).otherwise(F.col("reasons"))}
    )
