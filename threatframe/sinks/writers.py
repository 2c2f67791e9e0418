"""Sinks: event formats as columns and distributed writes. Every sink goes through the privacy gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatframe.operators.indicators import gate
from threatframe.operators.scoring import lookup

#: Severities of the target formats.
CEF_LEVEL = {"LOW": 3, "MEDIUM": 5, "HIGH": 8, "CRITICAL": 10}
ECS_LEVEL = {"LOW": 10, "MEDIUM": 40, "HIGH": 70, "CRITICAL": 90}
SYSLOG_LEVEL = {"LOW": 6, "MEDIUM": 4, "HIGH": 3, "CRITICAL": 2}
EXTENSION = {"src": "src_ip", "dst": "dst_ip", "dpt": "dst_port", "suser": "username", "shost": "hostname", "outcome": "status", "msg": "message"}


def _escaped(c: Column, marks: str) -> Column:
    for mark in "\\" + marks:
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))


def _parts(df: DataFrame, join: str, marks: str) -> Column:
    named = [(k, F.col(c).cast("string")) for k, c in EXTENSION.items() if c in df.columns]
    return F.concat_ws(join, *(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), _escaped(v, marks))) for k, v in named))


def cef(df: DataFrame) -> Column:
    head = [F.lit("CEF:0"), F.lit("threatframe"), F.lit("threatframe"), F.lit("1.0"), _escaped(F.col("event_type"), "|"), _escaped(F.col("event_type"), "|"), lookup(F.col("severity"), CEF_LEVEL, 3).cast("string")]
    return F.concat_ws("|", *head, _parts(df, " ", "="))


def leef(df: DataFrame) -> Column:
    head = [F.lit("LEEF:2.0"), F.lit("threatframe"), F.lit("threatframe"), F.lit("1.0"), _escaped(F.col("event_type"), "|"), F.lit("x09")]
    return F.concat_ws("|", *head, _parts(df, "\t", ""))


def syslog(df: DataFrame) -> Column:
    pri = (32 + lookup(F.col("severity"), SYSLOG_LEVEL, 6)).cast("string")
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))
    text = F.substring(F.replace(F.coalesce("message", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 900)
    return F.concat(F.lit("<"), pri, F.lit(">1 "), stamp, F.lit(" "), F.coalesce("hostname", F.lit("-")), F.lit(" threatframe - "), F.col("event_type"), F.lit(" - "), text)


def ecs(df: DataFrame) -> Column:
    return F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), F.col("message"),
            F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("action"), F.col("status").alias("outcome"), lookup(F.col("severity"), ECS_LEVEL, 10).alias("severity")).alias("event"),
            F.struct(F.col("src_ip").alias("ip")).alias("source"), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("destination"),
            F.struct(F.col("username").alias("name")).alias("user"), F.struct(F.col("hostname").alias("name")).alias("host"), F.struct(F.lit("8.11").alias("version")).alias("ecs"),
        )
    )


def ocsf(df: DataFrame) -> Column:
    kind = F.when(F.col("event_type").startswith("auth_"), 3002).when(F.col("event_type").isin("privilege_escalation", "edr_event"), 1008).otherwise(4001)
    return F.to_json(
        F.struct(
            kind.alias("class_uid"), F.unix_millis("ts").alias("time"), F.col("message"), (F.array_position(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("severity")) + 1).alias("severity_id"),
            F.struct(F.col("src_ip").alias("ip")).alias("src_endpoint"), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("dst_endpoint"), F.struct(F.col("username").alias("name")).alias("actor"),
            F.struct(F.lit("1.1.0").alias("version"), F.struct(F.lit("threatframe").alias("name")).alias("product")).alias("metadata"),
        )
    )


def stix(indicators: DataFrame) -> Column:
    """value, type -> STIX 2.1 indicator objects whose ids follow from their content."""
    h = F.sha2(F.concat_ws("|", "type", "value"), 256)
    at = lambda a, n: F.substring(h, a, n)
    uid = F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(F.lit("8"), at(18, 3)), at(21, 12))
    quoted = F.concat(F.lit("'"), _escaped(F.col("value"), "'"), F.lit("'"))
    pattern = F.when(F.col("type") == "ipv4", F.concat(F.lit("[ipv4-addr:value = "), quoted, F.lit("]"))).when(F.col("type") == "domain", F.concat(F.lit("[domain-name:value = "), quoted, F.lit("]")))
    pattern = pattern.when(F.col("type") == "url", F.concat(F.lit("[url:value = "), quoted, F.lit("]"))).when(F.col("type") == "ipv6", F.concat(F.lit("[ipv6-addr:value = "), quoted, F.lit("]"))).otherwise(F.concat(F.lit("[file:hashes."), F.upper("type"), F.lit(" = "), quoted, F.lit("]")))
    return F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uid).alias("id"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type")))


LINES = {"cef": cef, "leef": leef, "syslog": syslog, "ecs": ecs, "ocsf": ocsf}

STIX_ID = "^indicator--[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"

#: What a written line must look like.
VALID = {"cef": r"^CEF:0(\|([^|\\]|\\.)*){6}\|", "leef": r"^LEEF:2\.0(\|([^|\\]|\\.)*){4}\|", "syslog": r"^<[0-9]{1,3}>1 [^ ]+ [^ ]+ ", "ecs": r'^\{.*"event":\{', "ocsf": r'^\{"class_uid":(3002|1008|4001),'}


def lines(events: DataFrame, kind: str, policy: Mapping[str, str] | None = None) -> DataFrame:
    """The redacted events as one text column."""
    safe = gate(events, policy)
    return safe.select(LINES[kind](safe).alias("value"))


def fault(kind: str, value: str = "value") -> Column:
    """Why a formatted line is not valid; null if it is."""
    v = F.col(value)
    parsed = F.try_parse_json(v)
    key = lambda *names: F.coalesce(*(F.try_variant_get(parsed, f"$.{n}", "string") for n in names)).isNotNull()
    rules = {
        "csv": [(F.length(F.regexp_replace(v, '[^"]', "")) % 2 == 1, "unbalanced quotes")],
        "json": [(parsed.isNull(), "no JSON")],
        "ecs": [(parsed.isNull(), "no JSON"), (~key("event.action"), "no event")],
        "ocsf": [(parsed.isNull(), "no JSON"), (~key("class_uid"), "no class")],
        "stix": [(parsed.isNull(), "no JSON"), (~F.coalesce(F.get_json_object(v, "$.id").rlike(STIX_ID), F.lit(False)), "bad id"), (~F.coalesce(F.get_json_object(v, "$.pattern").rlike(r"^\[.*=.*\]$"), F.lit(False)), "bad pattern")],
    }
    checks = [(v.isNull() | (F.trim(v) == ""), "empty"), (v.contains("\n"), "line break"), *rules.get(kind, [])]
    if kind in VALID:
        checks.append((~v.rlike(VALID[kind]), "malformed header"))
    out = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        out = F.when(bad, why).otherwise(out)
    return out


def invalid(formatted: DataFrame, kind: str) -> DataFrame:
    """(lines, faults) of a formatted column."""
    return formatted.agg(F.count(F.lit(1)).alias("lines"), F.count(fault(kind)).alias("faults"))


def write(events: DataFrame, path: str, kind: str, policy: Mapping[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Write events as parquet (by job), json, csv, cef, leef, syslog, ecs or ocsf; each task writes its own part."""
    if kind in LINES:
        lines(events, kind, policy).write.mode(mode).text(path)
        return
    safe = gate(events, policy)
    if kind == "parquet":
        w = safe.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (w.partitionBy("job_id") if "job_id" in safe.columns else w).parquet(path)
    elif kind == "json":
        safe.write.mode(mode).json(path)
    elif kind == "csv":
        flat = [F.replace(F.col(c), F.lit("\n"), F.lit("\\n")).alias(c) if t == "string" else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in safe.dtypes]
        safe.select(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unknown sink: {kind}")
