"""Costs that must not grow faster than the table: sizes of tasks, and work that is done once for each row."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from threatframe.functions.staging import ROWS, over_cores, spread
from threatframe.operators import alerts, anomaly, indicators, joins, reports, rules
from threatframe.operators.rules import Rule
from threatframe.sources.security import security_events
from threatframe.streaming import refresh


def test_no_task_gets_more_rows_than_the_bound(spark):
    rows = spark.range(0, 9 * ROWS // 2, 1, 4)
    sizes = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9 * ROWS // 2 and max(sizes) <= ROWS


def test_an_address_is_worked_out_once(spark):
    plan = spark.createDataFrame([("from 10.0.0.1",)], "t string").select(indicators.iocs(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 8  # one for each place where numbers are made, not one for each network


def test_vectors_do_not_shuffle_the_events(spark, sf):
    plan = anomaly.vectors(security_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_places_of_both_ends(spark):
    events = spark.createDataFrame([(1, "8.8.8.8", "10.0.0.1"), (2, "1.1.1.1", None), (3, "x", "8.8.8.8")], "event_id long, src_ip string, dst_ip string")
    places = {r._ip: (r.country, r.kind) for r in joins.located(joins.both_ends(events), joins.range_table(spark)).collect()}
    assert places == {"8.8.8.8": ("US", "public"), "10.0.0.1": ("PR", "private"), "1.1.1.1": (None, "public")}


def test_texts_without_indicators_are_read_once(spark):
    """Facts are those of every row for itself, but rows that differ by a message that can hold none are one text."""
    at = dt.datetime(2024, 1, 1)
    notes = [f"view from user{i} value={i}" for i in range(200)]
    notes += [None, "", "see 9.9.9.9", "see 9.9.9.9", "at HTTPS://a.example/x", "a::1", "x" + "0aF" * 12, "v 1", 'version "', "</script> end", "fe80:: x.example.org"]
    ends = [("10.0.0.1", "8.8.8.8"), ("10.0.0.2", None), ("version", "1.2.3.4"), ("v1.2.3.4/5.6.7.8", "v"), ("<script>a.example.net", "1.1.1.1")]
    data = [(at + dt.timedelta(seconds=i), *ends[k], note) for i, note in enumerate(notes) for k in range(len(ends))]
    events = spark.createDataFrame(data, "ts timestamp, src_ip string, dst_ip string, message string")
    assert alerts.different_texts(events).count() <= len(ends) * (1 + len(notes) - 200)
    rows = indicators.indicator_table(events.select("ts", F.concat_ws(" ", "src_ip", "dst_ip", "message").alias("text")), "text")
    want = rows.groupBy("value", "type").agg(F.count(F.lit(1)), F.min("ts"), F.max("ts"), F.sum(F.col("confidence").cast("decimal(10,6)")).cast("decimal(28,6)"))
    got = alerts.indicator_facts(events).select("value", "type", "related_events", "first_seen", "last_seen", "sure")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sets_of_an_asset_are_made_of_few_rows(spark, sf):
    plan = reports.asset_facts(security_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(?<!Object)HashAggregate\(keys=\[name#\d+, service#\d+, port#\d+\]", plan)


def test_windows_are_counted_once_a_time_stamp(spark):
    """Events that share a time stamp are one row; the best windows are those of brute force, also around 1970."""
    rng = random.Random(2)
    us = [rng.choice([-3, 1]) * rng.randrange(400) * 1_000_000 for _ in range(60)] * 5
    data = [(u, rng.choice(["a", "b"]), rng.choice([1, 2, 3, 4, None])) for u in us]
    events = spark.createDataFrame(data, "us long, src_ip string, dst_port int").withColumn("ts", F.timestamp_micros("us"))
    assert rules.merged(events.select("ts")).count() == len(set(us))
    for metric, window in (("count", "1m"), ("distinct", "1m"), ("count", "7m"), ("distinct", "20s")):
        rule, want = Rule("R", metric=metric, window=window, threshold=2), []
        for who in ("a", "b"):
            mine, best = [(u, p) for u, s, p in data if s == who], (0, 0, 0)
            for end, _ in mine:
                held = [(u, p) for u, p in mine if end - rule.seconds * 1_000_000 <= u <= end]
                value = len(held) if metric == "count" else len({p for _, p in held if p is not None})
                best = max(best, (value, -end, min(u for u, _ in held)))
            want.append((who, best[0], best[2], -best[1]))
        found = rules.best_windows(events.withColumn("entity", F.array("src_ip")), rule)
        got = found.select(F.col("entity")[0], "value", F.unix_micros("started"), F.unix_micros("ended"))
        assert sorted(map(tuple, got.collect())) == want


def test_a_batch_of_one_file_is_dealt_out(spark, tmp_path, monkeypatch):
    assert over_cores(spark.range(0, 100, 1, 3)).rdd.getNumPartitions() == 3  # of four cores
    assert over_cores(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4
    parts = []

    class Seen(Exception):
        pass

    def seen(df, name):
        parts.append((name, df.rdd.getNumPartitions()))
        raise Seen

    state = refresh.Refresh(spark, str(tmp_path), [Rule("R")], [], joins.feed_table(spark))
    monkeypatch.setattr(refresh, "staged", seen)
    with pytest.raises(Seen):
        state.apply(spark.range(0, 100, 1, 1), 0)
    assert parts == [("batch", 4)]
