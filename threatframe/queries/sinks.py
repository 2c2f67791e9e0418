"""Queries that hold the contents of written lines against lines that SQL builds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threatframe.functions.staging import shared_dir
from threatframe.queries import query
from threatframe.sinks import writers
from threatframe.sources.security import security_events

_LEVEL = "CASE severity WHEN 'LOW' THEN {} WHEN 'MEDIUM' THEN {} WHEN 'HIGH' THEN {} ELSE {} END"


def _fields(join: str, message: str) -> str:
    return f"concat('src=', src_ip, {join}, 'dst=', dst_ip, {join}, 'dpt=', dst_port, {join}, 'suser=', username, {join}, 'shost=', hostname, {join}, 'outcome=', status, {join}, 'msg=', {message})"


LINES = {
    "k04_cef_contents": ("cef", f"concat('CEF:0|threatframe|threatframe|1.0|', event_type, '|', event_type, '|', {_LEVEL.format(3, 5, 8, 10)}, '|', {_fields(repr(' '), "replace(message, '=', '\\=')")})"),
    "k05_leef_contents": ("leef", f"concat('LEEF:2.0|threatframe|threatframe|1.0|', event_type, '|x09|', {_fields('chr(9)', 'message')})"),
    "k07_syslog_contents": ("syslog", f"concat('<', 32 + {_LEVEL.format(6, 4, 3, 2)}, '>1 ', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ' ', hostname, ' threatframe - ', event_type, ' - ', message)"),
    "k08_ecs_contents": ("ecs", f"""concat('{{"@timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","message":"', message, '","event":{{"id":"', event_id, '","action":"', event_type, '","outcome":"', status, '","severity":', {_LEVEL.format(10, 40, 70, 90)}, '}},"source":{{"ip":"', src_ip,
 '"}},"destination":{{"ip":"', dst_ip, '","port":', dst_port, '}},"user":{{"name":"', username, '"}},"host":{{"name":"', hostname, '"}},"ecs":{{"version":"8.11"}}}}')"""),
    "k09_ocsf_contents": ("ocsf", f"""concat('{{"class_uid":', CASE WHEN starts_with(event_type, 'auth_') THEN 3002 ELSE 4001 END, ',"time":', epoch_us(ts) // 1000, ',"message":"', message, '","severity_id":', {_LEVEL.format(2, 3, 4, 5)}, ',"src_endpoint":{{"ip":"', src_ip, '"}},"dst_endpoint":{{"ip":"', dst_ip,
 '","port":', dst_port, '}},"actor":{{"name":"', username, '"}},"metadata":{{"version":"1.1.0","product":{{"name":"threatframe"}}}}}}')"""),
}


def _written(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
        writers.write(security_events(spark, sf), path, kind)
        return spark.read.text(path).withColumnRenamed("value", "line")

    return run


for _name, (_kind, _line) in LINES.items():
    query(_name, f"SELECT {_line} AS line FROM sec")(_written(_kind))
