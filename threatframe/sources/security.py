"""The security view over the driver's events table: the event schema that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column expressions that mean the same in Spark SQL and DuckDB.
COLUMNS = {
    "event_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "event_type": "CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' WHEN 'click' THEN 'http_request' WHEN 'view' THEN 'dns_query' ELSE 'firewall_event' END",
    "src_ip": "CASE WHEN user_id % 10 = 0 THEN concat('8.8.8.', CAST(user_id % 200 AS STRING)) ELSE concat('10.', CAST(user_id % 4 AS STRING), '.0.', CAST(user_id % 200 AS STRING)) END",
    "dst_ip": "concat('192.168.0.', CAST(event_id % 50 AS STRING))",
    "dst_port": "CAST((event_id * 37) % 1024 AS INT)",
    "src_port": "CAST(1024 + (event_id * 53) % 60000 AS INT)",
    "protocol": "CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'udp' ELSE 'tcp' END",
    "username": "concat('user', CAST(user_id % 40 AS STRING))",
    "hostname": "concat('host', CAST(user_id % 25 AS STRING))",
    "status": "CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 'deny' ELSE 'allow' END",
    "severity": "CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 80 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END",
    "risk": "CAST(least(100, floor(value)) AS INT)",
    "message": "concat(event_type, ' from user', CAST(user_id AS STRING), ' value=', CAST(CAST(round(value) AS INT) AS STRING))",
}

SEC = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM events"

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(column):
    """0 for LOW to 3 for CRITICAL; text order would be wrong."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), column).cast("int") - 1


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{sql} AS {name}" for name, sql in COLUMNS.items()))


def with_sec(sql: str) -> str:
    """DuckDB SQL over a `sec` view."""
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}sec AS ({SEC}), {sql.removeprefix(start)}"
    return f"WITH sec AS ({SEC}) {sql}"
