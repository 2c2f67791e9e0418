"""Reading raw logs: numbered text lines, JSON, CSV, XML, Windows events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_lines(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """file, line_no, line of every text file: exact numbers over splits; blank files give none. longest: cut lines there."""
    line = F.substring("value", 1, longest) if longest else F.col("value")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), line.alias("line"))
    parts = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at"))
    return raw.withColumn("_own", own).join(parts.withColumn("_before", before).drop("_n"), ["file", "_block"]).select("file", (F.col("_before") + F.col("_own")).alias("line_no"), "line")


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays as JSON text."""
    out = []

    def walk(schema: StructType, path: list[str]) -> None:
        for f in schema.fields:
            here = [*path, f.name]
            col = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                walk(f.dataType, here)
            else:
                out.append((F.to_json(col) if isinstance(f.dataType, ArrayType) else col).alias(".".join(here)))

    walk(df.schema, [])
    return df.select(*out)


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON lines, or (multiline) whole files that hold an array or an object."""
    return flattened(spark.read.option("multiLine", multiline).json(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and doubled quotes; empty cells are null."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row per element; attributes as @name."""
    return flattened(spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").load(path))


def read_windows_events(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """Event XML as win_event_id, severity, hostname, ts_raw, username, src_ip and the map of all data values (and the file).

    Events may stand in a document or one after another without a root; a file is split at their ends.
    """
    schema = (
        "System STRUCT<EventID: STRING, Level: STRING, Computer: STRING, TimeCreated: STRUCT<`_SystemTime`: STRING>>, "
        "EventData STRUCT<Data: ARRAY<STRUCT<`_Name`: STRING, `_VALUE`: STRING>>>"
    )
    parts = spark.read.option("lineSep", "</Event>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?s)<Event[\s>].*$", 0).alias("x")).filter("x <> ''")
    df = parts.select("file", F.from_xml(F.concat("x", F.lit("</Event>")), schema).alias("e")).select("file", "e.*")
    data = F.map_from_entries(F.filter(F.transform("EventData.Data", lambda d: F.struct(d["_Name"], d["_VALUE"])), lambda e: e["_Name"].isNotNull()))
    level = F.element_at(F.create_map(*(F.lit(x) for x in ("1", "CRITICAL", "2", "HIGH", "3", "MEDIUM", "4", "LOW"))), F.col("System.Level"))
    user = F.coalesce(data["TargetUserName"], data["SubjectUserName"])
    return df.select(
        F.lit("windows_event").alias("event_type"), F.col("System.EventID").try_cast("int").alias("win_event_id"), F.coalesce(level, F.lit("LOW")).alias("severity"), F.col("System.Computer").alias("hostname"),
        F.col("System.TimeCreated._SystemTime").alias("ts_raw"), user.alias("username"), F.nullif(data["IpAddress"], F.lit("-")).alias("src_ip"), data.alias("mappings"), *(["file"] if with_file else []),
    )


def read_windows_text(spark: SparkSession, path: str | list[str], newline: str = "\n", with_file: bool = False) -> DataFrame:
    """Classic text exports: blocks of `Name: value` lines between blank lines, as a map. A file is split at its blank
    lines, so a large one is read by many tasks."""
    blocks = spark.read.option("lineSep", newline * 2).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("block")).filter(F.trim("block") != "")
    pair = F.lit(r"(?m)^\s*([A-Za-z ]+?):[ \t]*(.*)$")
    keys, values = F.transform(F.regexp_extract_all("block", pair, 1), F.lower), F.regexp_extract_all("block", pair, 2)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    m = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e.k) == i + 1))
    return blocks.select(F.lit("windows_event").alias("event_type"), m["event id"].try_cast("int").alias("win_event_id"), m["computer"].alias("hostname"), m["account name"].alias("username"), m["source network address"].alias("src_ip"), m.alias("mappings"), *(["file"] if with_file else []))
