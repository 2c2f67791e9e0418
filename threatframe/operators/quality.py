"""Quality of extraction, redaction and detection against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extraction(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1; no count is raised to one."""
    a = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    b = truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    j = a.join(b, keys, "full_outer")
    c = j.agg(F.count_if(F.col("_f") & F.col("_t")).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    share = lambda n: F.when(F.col("tp") + n > 0, F.col("tp") / (F.col("tp") + n)).otherwise(0.0)
    c = c.withColumns({"precision": share(F.col("fp")), "recall": share(F.col("fn"))})
    return c.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def redaction(clean: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(labelled, share): how many labelled values are gone from the redacted text."""
    j = labels.join(clean, key)
    gone = F.count_if(~F.contains(text, "value"))
    return j.agg(F.count(F.lit(1)).alias("labelled"), F.when(F.count(F.lit(1)) > 0, gone / F.count(F.lit(1))).otherwise(1.0).alias("share"))


def agreement(found: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """(label, n, right): how often the found value equals the labelled one."""
    j = truth.select(key, F.col(column).alias("label")).join(found.select(key, F.col(column).alias("found")), key, "left")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("label") == F.col("found"), F.lit(False)).cast("double")), 4).alias("right"))
