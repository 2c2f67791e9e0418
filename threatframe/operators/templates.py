"""Line templates of files that no parser knows: mining and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Variable parts of a line and their marks, in the order in which they are masked.
MASKS = (
    (r"https?://[^ ]+", "<URL>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
    (r"1[0-9]{9}([0-9]{3})?", "<EPOCH>"),
    (r"[0-9]+(\.[0-9]+)?(ms|us|ns|s|m|h)([^A-Za-z0-9]|$)", "<DUR>$3"),
    (r"0x[0-9a-fA-F]+|[0-9a-fA-F]{16,}", "<HEX>"),
    (r"[0-9]+(\.[0-9]+)?", "<NUM>"),
)


#: What a line must hold for a mask to find anything.
NEEDS = {"<URL>": "://", "<EMAIL>": "@"}


def mask(line: Column) -> Column:
    """The line with its variable parts marked; each mask runs only over lines that a cheap test lets through."""
    digit = line.rlike("[0-9]")
    for pattern, mark in MASKS:
        test = line.contains(NEEDS[mark]) if mark in NEEDS else (digit | (F.length(line) >= 16)) if mark == "<HEX>" else digit
        line = F.when(test, F.regexp_replace(line, pattern, mark)).otherwise(line)
    return line


def keyed(lines: DataFrame, column: str) -> DataFrame:
    """Adds the masked line and the template key: number of tokens and the first two masked tokens."""
    masked = mask(F.col(column))
    tokens = F.filter(F.split(masked, r"[ \t]+"), lambda t: t != "")
    return lines.withColumn("mask", masked).withColumns({"n_tokens": F.size(tokens), "head": F.array_join(F.slice(tokens, 1, 2), " ")})


def mine(lines: DataFrame, column: str, support: int = 2) -> DataFrame:
    """(n_tokens, head, template, support): the commonest mask of every key (ties by mask) that reaches the support."""
    counted = keyed(lines, column).groupBy("n_tokens", "head", "mask").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("n_tokens", "head").orderBy(F.desc("n"), "mask"))
    total = F.sum("n").over(Window.partitionBy("n_tokens", "head"))
    rows = counted.withColumns({"k": best, "support": total})
    return rows.filter((F.col("k") == 1) & (F.col("support") >= support)).select("n_tokens", "head", F.col("mask").alias("template"), "support")


def apply(lines: DataFrame, column: str, templates: DataFrame) -> DataFrame:
    """Adds event_type and template_id: lines with a learned key, and generic ones."""
    out = keyed(lines, column).join(templates, ["n_tokens", "head"], "left")
    known = F.col("template").isNotNull()
    return out.withColumns(
        {"event_type": F.when(known, "learned_template_event").otherwise("generic_event"), "template_id": F.when(known, F.substring(F.sha2("template", 256), 1, 16))}
    ).drop("n_tokens", "head", "mask")
