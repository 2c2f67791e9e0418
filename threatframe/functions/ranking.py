"""Exact numbers of rows in an order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatframe.functions.staging import staged


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in the order, which must tell rows apart.

    A range sort deals the rows over tasks; a row's place in its task and the counts of the tasks before give its number.
    """
    place = F.monotonically_increasing_id()  # task number in the upper bits, place in the task in the lower 33
    rows = staged(df.orderBy(*order).withColumn("_place", place), "sorted").withColumns({"_task": F.shiftright("_place", 33), "_nth": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per task
    return rows.join(counts.select("_task", before.alias("_before")), "_task").withColumn(name, F.col("_before") + F.col("_nth")).drop("_place", "_task", "_nth", "_before")
