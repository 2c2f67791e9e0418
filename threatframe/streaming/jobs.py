"""Structured Streaming forms: exactly-once rows, window rules, exact look-back rules, sessions, late rows, links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threatframe.functions.staging import shared_dir
from threatframe.operators.rules import Rule, grouped
from threatframe.sources.security import COLUMNS


def events_stream(spark: SparkSession, sf: str, per_trigger: int = 1) -> DataFrame:
    """The security view over a folder of Parquet files that grows."""
    return files_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, per_trigger, "*events*.parquet")


def files_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1, names: str = "*.parquet") -> DataFrame:
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", names).parquet(path)
    return raw.selectExpr(*(f"{sql} AS {name}" for name, sql in COLUMNS.items()))


def once(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Rows of new ids only; an id is remembered for the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def window_rule(events: DataFrame, rule: Rule, slide: str, delay: str = "1 day") -> DataFrame:
    """Approximate form of a rule: counts in sliding windows, given out when the watermark has passed them. Different values
    are estimated, and windows start at multiples of the slide; `look_back` is the exact form."""
    length = f"{rule.seconds} seconds"
    value = F.approx_count_distinct(rule.distinct_field or "dst_port") if rule.metric == "distinct" else F.count(F.lit(1))
    g = grouped(events.withWatermark("ts", delay), rule).groupBy(F.window("ts", length, slide), F.array_join("entity", ":").alias("entity"))
    return g.agg(value.alias("value")).filter(F.col("value") >= rule.threshold).select("entity", F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "value")


def minutes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("minute"), "n")


def sessions(events: DataFrame, key: str, gap: str, delay: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def look_back(events: DataFrame, rule: Rule, delay: str = "1 day") -> DataFrame:
    """Exact form of a count rule: a key's state is its time stamps within one window of the watermark, sorted.

    Gives (entity, at_us, value) for every event whose look-back window reaches the threshold. Events older than the
    watermark are dropped before, so older stamps can count for none; a key's state goes when the watermark has passed
    its last window.
    """
    width = rule.seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = np.array(state.get[0] if state.exists else [], np.int64)
        new = np.sort(np.concatenate([b["us"].to_numpy(np.int64) for b in batches]))
        every = np.sort(np.concatenate([old, new]))
        n = np.searchsorted(every, new, side="right") - np.searchsorted(every, new - width, side="left")
        fires = n >= rule.threshold
        out = {"entity": key[0], "at_us": new[fires], "value": n[fires]}
        mark = state.getCurrentWatermarkMs()
        state.update((every[every >= mark * 1000 - width].tolist(),))
        state.setTimeoutTimestamp(max(int(every[-1]) // 1000 + width // 1000, mark + 1))
        yield pd.DataFrame(out)

    rows = grouped(events.withWatermark("ts", delay), rule).select(F.array_join("entity", ":").alias("entity"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, at_us long, value long", "stamps array<long>", "append", GroupStateTimeout.EventTimeTimeout)


DETECTED = "entity string, value long, started_us long, ended_us long, followed_by string, followed_us long, revision long"
_ENTITY_STATE = "entities array<struct<entity:string,stamps:array<long>,value:long,started:long,ended:long,who:string,at:long,revision:long>>, logins array<struct<at:long,who:string>>"


class _Watch:
    """What is remembered of one entity: its recent stamps, and its best window with the login that followed."""

    __slots__ = ("entity", "stamps", "value", "started", "ended", "who", "at", "revision")

    def __init__(self, entity, stamps=(), value=None, started=None, ended=None, who=None, at=None, revision=0):
        self.entity, self.stamps = entity, np.array(stamps, np.int64)
        self.value, self.started, self.ended, self.who, self.at, self.revision = value, started, ended, who, at, revision

    def found(self) -> tuple:
        return self.value, self.started, self.ended, self.who, self.at

    def take(self, new: np.ndarray, width: int, threshold: int) -> None:
        """Count the windows that new stamps change: those that end at them or up to a window's length later."""
        self.stamps = np.sort(np.concatenate([self.stamps, new]))
        ends = self.stamps[self.stamps >= new.min()]
        first = np.searchsorted(self.stamps, ends - width, side="left")
        n = np.searchsorted(self.stamps, ends, side="right") - first
        k = int(n.argmax())  # the earliest of the largest
        value, ended = int(n[k]), int(ends[k])
        if value >= threshold and (self.value is None or (-value, ended) <= (-self.value, self.ended)):
            if ended != self.ended:
                self.who = self.at = None
            self.value, self.started, self.ended = value, int(self.stamps[first[k]]), ended

    def follow(self, logins: list[tuple[int, str]]) -> None:
        """The first login at or after the window's end, of the one known and those given."""
        if self.ended is not None:
            after = [x for x in logins if x[0] >= self.ended] + ([(self.at, self.who)] if self.at is not None else [])
            self.at, self.who = min(after, default=(None, None))


def followed_windows(events: DataFrame, rule: Rule, delay: str = "1 day") -> DataFrame:
    """A count rule with its follow-up, exactly: each entity's best look-back window, and the first successful login from the
    entity's first key at or after that window's end. DETECTED rows, one for every change; the last revision holds.

    State is kept by first key. A firing window waits for its first login; a later failure that makes a better window moves
    it, and the login that follows that one may have come before the failure did. An event that is not yet late, by `delay`,
    can only change windows that end after the watermark. So a timer drops the stamps that are older than a window's length
    before the watermark and the logins before it; an entity that has fired keeps its best window and login, one that has
    not is forgotten. Events without a time are left out.
    """
    width = rule.seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entities, logins = state.get if state.exists else ([], [])
        watched = {e[0]: _Watch(*e) for e in entities}
        logins = [tuple(x) for x in logins]
        before = {k: w.found() for k, w in watched.items()}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            new = rows[rows["entity"].isna()]
            logins += list(zip(new["us"].tolist(), new["who"].tolist(), strict=True))
            for entity, part in rows[rows["entity"].notna()].groupby("entity"):
                watched.setdefault(entity, _Watch(entity)).take(part["us"].to_numpy(np.int64), width, rule.threshold)
            for w in watched.values():
                w.follow(logins)
        changed = [w for k, w in watched.items() if w.ended is not None and w.found() != before.get(k)]
        for w in changed:
            w.revision += 1
        mark = state.getCurrentWatermarkMs() * 1000
        for w in watched.values():
            w.stamps = w.stamps[w.stamps >= mark - width]
        keep = [w for w in watched.values() if len(w.stamps) or w.ended is not None]
        logins = [x for x in logins if x[0] >= mark]
        if keep or logins:
            state.update(([(w.entity, w.stamps.tolist(), w.value, w.started, w.ended, w.who, w.at, w.revision) for w in keep], logins))
            last = max([int(w.stamps[-1]) + width for w in keep if len(w.stamps)] + [x[0] for x in logins], default=None)
            if last is not None:
                state.setTimeoutTimestamp(max(last, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if found := [(w.entity, w.value, w.started, w.ended, w.who, w.at, w.revision) for w in changed]:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in DETECTED.split(", ")]).astype({"followed_us": "Int64"})

    timed = events.filter("ts IS NOT NULL").withWatermark("ts", delay)
    failures = grouped(timed, rule).select(F.element_at("entity", 1).alias("first"), F.array_join("entity", ":").alias("entity"), F.lit(None).cast("string").alias("who"), "ts")
    success = timed.filter("event_type = 'auth_success' AND src_ip IS NOT NULL").select(F.col("src_ip").alias("first"), F.lit(None).cast("string").alias("entity"), F.coalesce("username", "src_ip").alias("who"), "ts")
    rows = failures.union(success).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("first").applyInPandasWithState(step, DETECTED, _ENTITY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(detected: DataFrame) -> DataFrame:
    """The last revision of each entity."""
    rest = [c for c in detected.columns if c not in ("entity", "revision")]
    return detected.groupBy("entity").agg(F.max_by(F.struct(*rest), "revision").alias("d")).select("entity", "d.*")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read back what it appended."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_each(stream: DataFrame, name: str, each, path: str | None = None) -> str:
    """foreachBatch over what is there now; returns the folder that `each(batch, batch_id, folder)` may write to. With the
    folder of an earlier run, the stream goes on where that one ended."""
    import uuid

    path = path or f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(lambda df, k: each(df, k, path)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def run_late(stream: DataFrame, allowed_us: int, name: str) -> DataFrame:
    """Run a stream batch by batch; its rows with `late`: whether they are older than the latest stamp of the batches before,
    less what is allowed. That stamp is kept beside the output, so a restart goes on from it."""
    spark = stream.sparkSession

    def each(batch: DataFrame, k: int, path: str) -> None:
        before = spark.read.schema("batch int, top long").parquet(f"{path}/seen").filter(F.col("batch") < k).agg(F.max("top")).first()[0] if k else None
        good, late = split_late(batch, before, allowed_us) if before is not None else (batch, batch.limit(0))
        good.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
        batch.agg(F.max(F.unix_micros("ts")).alias("top")).write.mode("overwrite").parquet(f"{path}/seen/batch={k}")

    path = run_each(stream, name, each)
    return spark.read.parquet(f"{path}/rows").drop("batch")


def split_late(batch: DataFrame, seen_us: int, allowed_us: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a micro-batch, by the largest time stamp of the batches before."""
    late = F.coalesce(F.unix_micros("ts") < seen_us - allowed_us, F.lit(False))
    return batch.filter(~late), batch.filter(late)
