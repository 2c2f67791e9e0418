"""Streams over several micro-batches equal brute force over all their rows."""

import datetime as dt
import hashlib
import random
import uuid

from pyspark.sql import functions as F

from threatframe.operators import reports
from threatframe.operators.rules import Rule
from threatframe.streaming import custody, jobs

EVENT = "event_id long, ts timestamp, event_type string, src_ip string, username string"
RULE = Rule("R", match={"event_type": "auth_failure"}, threshold=3, window="10m", group_by=("src_ip", "username"), then_success=True)


def brute(rows):
    """Best window and follow-up of each (src_ip, username), by trying every window."""
    out = {}
    fails = [r for r in rows if r[1] and r[2] == "auth_failure"]
    for key in {(r[3], r[4]) for r in fails}:
        times = sorted(r[1] for r in fails if (r[3], r[4]) == key)
        found = [(-len(w), t, w[0]) for t in times if len(w := [x for x in times if t - dt.timedelta(minutes=10) <= x <= t]) >= 3]
        if found:
            n, end, start = min(found)
            after = min([(r[1], r[4] or r[3]) for r in rows if r[1] and r[2] == "auth_success" and r[3] == key[0] and r[1] >= end], default=(None, None))
            out[f"{key[0]}:{key[1] or '-'}"] = (-n, start, end, after[1], after[0])
    return out


def test_windows_with_followups_equal_brute_force(spark, tmp_path):
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        ts = start + dt.timedelta(seconds=rng.randrange(12 * 3600)) if rng.random() > 0.01 else None
        rows.append((i, ts, rng.choice(["auth_failure"] * 3 + ["auth_success", "other"]), f"10.0.0.{rng.randrange(12)}", rng.choice(["a", "b", None])))
    # arrival by time with up to an hour's lateness, in six batches; the delay allows two hours
    late = lambda r: ((r[1] or start) - start).total_seconds() + rng.random() * 3600
    rows.sort(key=late)
    src = tmp_path / "in"
    for k in range(6):
        spark.createDataFrame(rows[250 * k : 250 * k + 250], EVENT).coalesce(1).write.parquet(str(src / f"part={k}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    found = jobs.run_to_table(jobs.followed_windows(stream, RULE, "2 hours"), f"t{uuid.uuid4().hex}")
    at = lambda us: None if us is None else start + dt.timedelta(microseconds=us - int(start.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000)
    got = {r.entity: (r.value, at(r.started_us), at(r.ended_us), r.followed_by, at(r.followed_us)) for r in jobs.latest(found).collect()}
    assert got == brute(rows) and len(got) > 10
    assert found.count() > len(got)  # windows moved


def tree(hashes, fan_in):
    join = lambda level: [hashlib.sha256("".join(level[i : i + fan_in]).encode()).hexdigest() for i in range(0, len(level), fan_in)]
    level = join(join(hashes))
    while len(level) > 1:
        level = join(level)
    return level[0]


def test_digests_are_trees_of_bounded_fan_in(spark):
    rows = [(j, i, f"m{j}-{i}") for j, n in ((1, 1), (2, 3), (3, 4), (4, 50), (5, 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "job long, o long, m string").repartition(3)
    got = {r.job: (r.events, r.digest) for r in reports.batch_digests(df, F.col("job"), "o", F.col("m"), 3).collect()}
    for j in range(1, 6):
        own = [hashlib.sha256(m.encode()).hexdigest() for k, _, m in rows if k == j]
        assert got[j] == (len(own), tree(own, 3))
    assert reports.batch_digests(df.limit(0), F.col("job"), "o", F.col("m"), 3).count() == 0


def test_chain_of_custody_survives_restarts_and_finds_faults(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m{i}") for i in range(50)], "event_id long, message string")
    path = str(tmp_path)
    make = lambda: custody.Custody(spark, path, "event_id", F.col("message"), 4)
    parts = [df.filter(F.col("event_id") % 5 == k) for k in range(5)]
    make().link(parts[0], 0)
    make().link(parts[1], 1)
    make().link(df.limit(0), 2)  # nothing came
    make().link(parts[2], 3)
    make().link(parts[2], 3)  # the same batch, again after a failure
    links = {r.job: r for r in make().links().collect()}
    assert sorted(links) == [0, 1, 3] and links[3].prev_hash == links[1].digest and links[0].prev_hash == custody.NONE
    assert make().faults().count() == 0
    parts[1].withColumn("message", F.regexp_replace("message", "m11", "m1l")).write.mode("overwrite").parquet(f"{path}/rows/batch=1")
    assert {(r.job, r.fault) for r in make().faults().collect()} == {(1, "changed"), (3, "relinked")}
