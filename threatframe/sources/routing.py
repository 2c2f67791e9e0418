"""File-level routing: what each file of a mixed folder is, and its records by the reader that fits.

A look at the head of every file decides. Files of lines go to the line formats; XML, Windows exports, CSV and JSON
documents to Spark's structured readers; files that a user's handler claims to that handler, through a Python data source with
one partition for each file. All give the same columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import BinaryIO
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threatframe.functions.staging import staged
from threatframe.sources import formats, readers
from threatframe.sources.formats import FIELDS, LEAST_SHARE, SAMPLE_LINES, SYSLOG, any_of

LONGEST = 8000  #: characters of a line that are looked at
LEAST_CSV = 0.8  #: share of lines with the commonest number of commas
STRUCTURED = ("windows_xml", "windows_text", "xml", "json_document", "csv")

#: Names by which a record's fields are known.
NAMES = {
    "event_type": ("event_type", "eventtype", "type", "category"), "ts_raw": ("ts_raw", "timestamp", "@timestamp", "time", "datetime", "date", "ts"),
    "src_ip": ("src_ip", "source_ip", "srcip", "src", "source", "client_ip", "ip"), "dst_ip": ("dst_ip", "destination_ip", "dstip", "dst", "destination"),
    "src_port": ("src_port", "source_port", "sport", "spt"), "dst_port": ("dst_port", "destination_port", "dport", "dpt"), "protocol": ("protocol", "proto"),
    "username": ("username", "user", "account", "user_name"), "hostname": ("hostname", "host", "computer", "device"), "process": ("process", "program", "app"), "action": ("action", "act"),
    "status": ("status", "result", "outcome"), "severity": ("severity", "level"), "method": ("method",), "path": ("path", "url", "uri"), "domain": ("domain", "query"),
}


@dataclass(frozen=True)
class Handler:
    name: str
    detect: Callable[[Column], Column]
    read: Callable[[BinaryIO], Iterator[dict]]


_handlers: dict[str, Handler] = {}


def file_handler(name: str, detect: Callable[[Column], Column]):
    """Register a reader of whole files: detect judges a file's first line that is not blank (a column), the decorated
    function takes the open file and gives a record (a dict) at a time. Handlers are asked before anything else."""

    def register(read: Callable[[BinaryIO], Iterator[dict]]):
        _handlers[name] = Handler(name, detect, read)
        return read

    return register


def unregister_file_handler(name: str) -> None:
    _handlers.pop(name, None)


def handler_source(handler: Handler) -> type[DataSource]:
    """A Python data source that reads the files of its option `paths` (a JSON list), each as one partition."""
    name, read = f"threatframe_{handler.name}", handler.read

    class FilePartition(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, paths: list[str]):
            self.paths = paths

        def partitions(self):
            return [FilePartition(p) for p in self.paths]

        def read(self, partition):
            from pyarrow import fs

            system, inside = fs.FileSystem.from_uri(partition.path) if ":/" in partition.path else (fs.LocalFileSystem(), partition.path)
            with system.open_input_file(inside) as stream:
                for n, record in enumerate(read(stream), 1):
                    yield partition.path, n, {str(k).lower(): str(v) for k, v in record.items() if v is not None}

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "file string, line_no bigint, fields map<string,string>"

        def reader(self, schema):
            return Reader(json.loads(self.options["paths"]))

    return Source


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, line): the first lines, of those that are not blank, of every file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.substring("value", 1, LONGEST).alias("line"))
    rows = raw.filter((F.col("block") == 0) & (F.trim("line") != ""))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_LINES).select("file", "nth", "line")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, confidence, lines, subtype, noise, first), a row for every file with a line that is not blank.

    format: a handler's name, a structured kind, a line format or generic. confidence: the share of lines that say so (1 where
    the first line decides). subtype: of syslog files, the commonest program. noise: the share of lines that no line format
    knows, 0 in structured files.
    """
    line = F.col("line")
    process = F.regexp_extract("line", SYSLOG, 3)
    rows = heads(spark, path).select(
        "file", "nth", line, formats.line_format(line).alias("known"), (F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))).alias("commas"),
        F.nullif(process, F.lit("")).alias("process"), line.rlike(r"<Event[\s>]").alias("event"), line.rlike(r"^Log Name:\s").alias("log_name"),
    )
    rows = staged(rows, "heads")
    one = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.trim(F.min_by("line", "nth")).alias("first"), F.trim(F.max_by("line", "nth")).alias("last"), F.mode("known", deterministic=True).alias("known"), F.mode("commas", deterministic=True).alias("commas"),
        F.mode("process", deterministic=True).alias("process"), F.count_if("event").alias("events"), F.count_if("log_name").alias("log_names"), F.count_if(F.col("known").isNull()).alias("unknown"),
    )
    fits = rows.select("file", F.col("known").alias("k"), F.col("commas").alias("c")).join(one.select("file", "known", "commas"), "file").groupBy("file").agg(F.count_if(F.col("k") == F.col("known")).alias("alike"), F.count_if(F.col("c") == F.col("commas")).alias("even"))
    j = one.join(fits, "file")
    share, even, first = F.col("alike") / F.col("lines"), F.col("even") / F.col("lines"), F.col("first")
    kind = (
        F.when(F.col("log_names") > 0, "windows_text").when(F.col("events") > 0, "windows_xml")
        .when(first.startswith("<?xml") | (first.startswith("<") & F.col("last").endswith(">")), "xml")
        .when(first.startswith("[") & first.rlike(r"^\[\s*(\{.*|\]?)$") | (first.startswith("{") & ~first.endswith("}")), "json_document")
        .when(share >= LEAST_SHARE, F.col("known")).when((F.col("commas") >= 2) & (even >= LEAST_CSV), "csv").otherwise("generic")
    )
    for h in reversed(_handlers.values()):
        kind = F.when(F.coalesce(h.detect(first), F.lit(False)), h.name).otherwise(kind)
    j = j.withColumn("format", kind)
    line_file = ~F.col("format").isin(*STRUCTURED, *_handlers)
    sure = F.when(F.col("format") == "csv", even).when(line_file, F.when(F.col("format") == "generic", 0.0).otherwise(share)).otherwise(1.0)
    noise = F.when(line_file, F.col("unknown") / F.col("lines")).otherwise(0.0)
    return j.select("file", "format", F.round(sure, 4).alias("confidence"), "lines", F.when(F.col("format") == "syslog", F.col("process")).alias("subtype"), F.round(noise, 4).alias("noise"), F.substring("first", 1, LONGEST).alias("first"))


def _record_columns(df: DataFrame, kind: str) -> DataFrame:
    """file, line_no, line, format and FIELDS of records (file, line_no, fields)."""
    fields = {c: any_of(F.col("fields"), *names) for c, names in NAMES.items()}
    return df.select("file", "line_no", F.to_json("fields").alias("line"), F.lit(kind).alias("format"), *(fields[c].alias(c) for c in FIELDS))


def _as_map(df: DataFrame) -> Column:
    """The columns of a flat table, but for `file`, as a map by lower-case name; nulls are left out."""
    names = [c for c in df.columns if c != "file"]
    every = F.map_from_entries(F.array(*(F.struct(F.lit(c.lower().lstrip("@")).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in {c.lower(): c for c in names}.values()))) if names else F.create_map().cast("map<string,string>")
    return F.map_filter(every, lambda k, v: v.isNotNull())


def _structured(spark: SparkSession, kind: str, files: list[tuple[str, str]]) -> list[DataFrame]:
    """Records of the (path, first line) of one kind. Files of one layout (header, record element) are read together."""
    none, file = F.lit(None).cast("long").alias("line_no"), F.col("_metadata.file_path").alias("file")
    paths = [unquote(p) for p, _ in files]
    layouts: dict[str, list[str]] = {}
    if kind == "csv":
        for p, (_, head) in zip(paths, files, strict=True):
            layouts.setdefault(head, []).append(p)
        read = [spark.read.option("header", True).option("escape", '"').csv(ps).select("*", file) for ps in layouts.values()]
        read = [d.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in d.columns)) for d in read]
    elif kind == "xml":
        tags = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][A-Za-z0-9_.:-]*)"), 1).alias("t"), F.monotonically_increasing_id().alias("at"))
        second = tags.filter(F.size("t") > 0).select("file", "at", F.posexplode("t").alias("k", "tag")).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("at", "k"))).filter("nth = 2")
        for r in second.select("file", "tag").collect():  # one row per XML file
            layouts.setdefault(r.tag, []).append(unquote(r.file))
        read = [readers.flattened(spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").load(ps).select("*", file)) for tag, ps in layouts.items()]
    elif kind == "windows_xml":
        read = [readers.read_windows_events(spark, paths, True)]
    else:
        read = [readers.read_windows_text(spark, paths, with_file=True)]
    if kind.startswith("windows"):
        extra = lambda d: F.create_map(*(x for c in ("event_type", "win_event_id", "hostname", "username", "src_ip", "severity", "ts_raw") if c in d.columns for x in (F.lit(c), F.col(c).cast("string"))))
        return [_record_columns(d.select("file", none, F.map_filter(extra(d), lambda k, v: v.isNotNull()).alias("fields")), kind) for d in read]
    return [_record_columns(d.select("file", none, _as_map(d).alias("fields")), kind) for d in read]


def parse_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line, format and FIELDS of every record of every file in a folder (or glob) of any kinds.

    JSON documents give one line for each record, which the JSON formats (vendors too) then parse. line_no is null where a
    structured reader gives none. Blank files give nothing.
    """
    kinds = staged(sniff(spark, path), "kinds")
    own = kinds.filter(F.col("format").isin(*STRUCTURED, *_handlers)).select("format", "file", "first")
    by_kind: dict[str, list[tuple[str, str]]] = {}
    for r in own.collect():  # names of structured files, which the readers' own listings hold on the driver anyhow
        by_kind.setdefault(r.format, []).append((r.file, r.first))
    line_files = kinds.join(own.select("file"), "file", "left_anti").select("file", F.col("format").alias("file_format"))
    lines = readers.read_lines(spark, path, LONGEST).join(line_files, "file").select("file", "line_no", "line", "file_format")
    if documents := by_kind.pop("json_document", None):
        docs = spark.read.option("multiLine", True).json([unquote(p) for p, _ in documents])
        text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
        docs = docs.select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_no"), text.alias("line"), F.lit("json").alias("file_format"))
        lines = lines.unionByName(docs)
    out = [formats.parsed(lines, "line", "file_format").drop("file_format")]
    for kind, files in by_kind.items():
        if kind in _handlers:
            source = handler_source(_handlers[kind])
            spark.dataSource.register(source)
            out.append(_record_columns(spark.read.format(source.name()).option("paths", json.dumps([p for p, _ in files])).load(), kind))
        else:
            out += _structured(spark, kind, files)
    columns = ["file", "line_no", "line", "format", *FIELDS]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in out])
