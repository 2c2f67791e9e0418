"""Normalization of parsed fields to the event schema, and time stamps in the forms that logs use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatframe.operators.search import deterministic_id
from threatframe.sources.security import SEVERITIES

#: Time stamp patterns with a year, each with the shape that a stamp must have to be tried with it.
PATTERNS = (
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "^[0-9]{4}-.{5}T.*([Zz]|[+-][0-9]{2}:[0-9]{2})$"), ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "^[0-9]{4}-.{5}T.*[0-9]$"), ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "^[0-9]{4}-.{5} "),
    ("yyyy/MM/dd HH:mm:ss", "^[0-9]{4}/"), ("dd/MMM/yyyy:HH:mm:ss Z", "^[0-9]{2}/[A-Z]"), ("MM/dd/yyyy-HH:mm:ss[.SSSSSS]", "^[0-9]{2}/[0-9]{2}/[0-9]{4}-"), ("MM/dd/yy-HH:mm:ss[.SSSSSS]", "^[0-9]{2}/[0-9]{2}/[0-9]{2}-"), ("dd MMM yyyy HH:mm:ss", "^[0-9]{2} [A-Z]"),
)
YEARLESS = "yyyy MMM d HH:mm:ss"


def parse_timestamp(raw: Column, reference: Column) -> Column:
    """A TIMESTAMP from epoch seconds or milliseconds, or one of the patterns; null if none fits.

    A stamp without a year takes the reference date's year, or the year before if that is over a day ahead.
    """
    raw = F.trim(raw)
    number = F.when(raw.rlike(r"^[0-9]{9,13}(\.[0-9]+)?$"), raw.try_cast("double"))
    epoch = F.timestamp_micros((F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)).cast("long"))
    full = [F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(p))) for p, shape in PATTERNS]
    short = F.regexp_replace(raw, " +", " ")
    year = F.year(reference)
    at = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), short), F.lit(YEARLESS))
    near = F.when(at(year) > reference + F.expr("INTERVAL 1 DAY"), at(year - 1)).otherwise(at(year))
    return F.coalesce(epoch, *full, F.when(short.rlike("^[A-Z][a-z]{2} [0-9]"), near))


def to_port(c: Column) -> Column:
    n = c.try_cast("double").try_cast("int")
    return F.when(n.between(0, 65535), n)


def normalize(parsed: DataFrame, reference: Column, raw: str = "line", job: Column | None = None) -> DataFrame:
    """Parsed fields -> events: typed columns, unknown as null, severity checked, message from the line, stable ids."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    kept = [c for c in parsed.columns if c not in ("ts_raw", raw)]
    text = [c for c in ("src_ip", "dst_ip", "protocol", "username", "hostname", "process", "action", "status", "method", "path", "domain", "event_type") if c in kept]
    df = parsed.withColumns({c: clean(c) for c in text})
    mapped = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, text)), F.array(*map(F.col, text))), lambda k, v: v.isNotNull())
    ts = parse_timestamp(F.col("ts_raw"), reference)
    level = F.upper(clean("severity"))
    df = df.withColumns(
        {"ts": ts, "src_port": to_port(F.col("src_port")), "dst_port": to_port(F.col("dst_port")), "severity": F.when(level.isin(*SEVERITIES), level).otherwise("LOW"),
         "message": F.substring(raw, 1, 500), "mappings": mapped, "job_id": F.lit("job") if job is None else job}
    )
    df = df.withColumn("timestamp_source", F.when(F.col("ts").isNotNull(), "event").otherwise("ingest"))
    ids = deterministic_id(F.unix_micros("ts").cast("string"), F.col("hostname"), F.col("process"), F.col(raw))
    return df.withColumn("dedup_event_id", ids).drop("ts_raw")


def with_raw(events: DataFrame, raw_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Events with `raw`, the line that they were read from; null where it is not kept."""
    return events.join(raw_lines.select(*keys, F.col("line").alias("raw")), keys, "left")


def backfilled_ids(events: DataFrame, raw_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Events without a dedup_event_id get it from their raw line, or else from the message; others keep theirs."""
    j = events.join(raw_lines.select(*keys, F.col("line").alias("_raw")), keys, "left")
    ids = deterministic_id(F.unix_micros("ts").cast("string"), F.col("hostname"), F.col("process"), F.coalesce("_raw", "message"))
    return j.withColumn("dedup_event_id", F.coalesce("dedup_event_id", ids)).drop("_raw")
