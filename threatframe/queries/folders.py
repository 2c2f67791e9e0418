"""Queries of folders that hold files of all kinds, rendered from the security view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import shared_dir
from threatframe.queries import query
from threatframe.sources import routing
from threatframe.sources.security import security_events

KINDS = ("syslog", "csv", "xml", "windows_xml", "json", "arrows", "windows_text", "firewall")


def folder(spark: SparkSession, sf: str) -> str:
    """One folder with a file for each kind and each run of 8,000 event ids."""
    e = security_events(spark, sf).withColumns({"kind": F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int")), "chunk": F.expr("event_id div 8000")})
    record = {
        "syslog": F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" h1 sshd[7]: Failed password for "), "username", F.lit(" from "), "src_ip", F.lit(" port 2200 ssh2")),
        "csv": F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "src_ip", "username", F.concat(F.lit('"a, b"'))),
        "xml": F.concat(F.lit("<entry level=\"1\"><src_ip>"), "src_ip", F.lit("</src_ip><user>"), "username", F.lit("</user></entry>")),
        "windows_xml": F.concat(F.lit("<Event><System><EventID>4625</EventID><Computer>h1</Computer></System><EventData><Data Name=\"TargetUserName\">"), "username", F.lit("</Data><Data Name=\"IpAddress\">"), "src_ip", F.lit("</Data></EventData></Event>")),
        "json": F.to_json(F.struct(F.lit("ConsoleLogin").alias("eventName"), F.lit("signin").alias("eventSource"), F.col("src_ip").alias("sourceIPAddress"), F.struct(F.col("username").alias("arn")).alias("userIdentity"))),
        "arrows": F.concat("username", F.lit(" -> "), "src_ip"),
        "windows_text": F.concat(F.lit("Log Name: Security\nEvent ID: 4625\nComputer: h1\nAccount Name: "), "username", F.lit("\nSource Network Address: "), "src_ip", F.lit("\n")),
        "firewall": F.concat(F.lit("src="), "src_ip", F.lit(" dst=10.0.0.1 user="), "username", F.lit(" action=deny")),
    }
    text = F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in record.items()))
    docs = e.groupBy("kind", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x.t).alias("rows"))
    joined = lambda sep: F.array_join("rows", sep)
    doc = (
        F.when(F.col("kind") == "csv", F.concat(F.lit("time,src_ip,username,\"note, long\"\n"), joined("\n"))).when(F.col("kind") == "xml", F.concat(F.lit("<?xml version=\"1.0\"?>\n<log>\n"), joined("\n"), F.lit("\n</log>")))
        .when(F.col("kind") == "json", F.concat(F.lit("[\n"), joined(",\n"), F.lit("\n]"))).when(F.col("kind") == "arrows", F.concat(F.lit("#arrows 1\n"), joined("\n"))).otherwise(joined("\n"))
    )
    path = f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}"
    docs.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def arrows(stream):
    """A user's handler: `user -> address` lines under a head."""
    for line in stream.read().decode().splitlines()[1:]:
        user, _, address = line.partition(" -> ")
        yield {"user": user, "ip": address}


def _with_handler(run):
    routing.file_handler("arrows", lambda first: first.startswith("#arrows"))(arrows)
    try:
        return run()
    finally:
        routing.unregister_file_handler("arrows")


_SNIFFED = f"""WITH k AS (SELECT event_id, event_id // 8000 AS chunk, CAST([{", ".join(map(repr, KINDS))}][CAST(event_id % 8 + 1 AS INT)] AS STRING) AS kind, src_ip, username FROM sec)"""


@query("b01_mixed_folder", _SNIFFED + " SELECT CASE kind WHEN 'json' THEN 'json_document' ELSE kind END AS format, CASE kind WHEN 'syslog' THEN 'sshd' END AS subtype, count(DISTINCT chunk) AS files, CAST(1.0 AS DOUBLE) AS confidence, CAST(0.0 AS DOUBLE) AS noise FROM k GROUP BY kind")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    """What each file of a folder with eight kinds is, a user's own among them."""
    found = _with_handler(lambda: routing.sniff(spark, folder(spark, sf)))
    return found.groupBy("format", "subtype").agg(F.count(F.lit(1)).alias("files"), F.min("confidence").alias("confidence"), F.max("noise").alias("noise"))


@query("n01_mixed_folder", _SNIFFED + " SELECT kind AS format, src_ip, username, count(*) AS n FROM k GROUP BY ALL")
def n01(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all eight kinds from one call."""
    out = _with_handler(lambda: routing.parse_folder(spark, folder(spark, sf)))
    return out.groupBy("format", "src_ip", "username").agg(F.count(F.lit(1)).alias("n"))
