"""Anomaly scores: feature vectors, an isolation forest grown on Spark, and reasons for a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.ranking import numbered
from threatframe.functions.staging import staged
from threatframe.operators import indicators, joins
from threatframe.sources.security import severity_rank

TREES, SAMPLE, FLAG, SEED, LEAST_ROWS = 100, 256, 0.7, 42, 8

#: The features in their order, and the numbers of address kinds.
FEATURES = ("hour", "weekday", "msg_len", "src_port", "dst_port", "ioc_count", "pii_count", "risk", "severity", "suspicious", "intel_match", "geo_src_kind", "geo_dst_kind", "event_type_code", "status_code", "protocol_code")
KINDS = {"reserved": 1.0, "private": 2.0, "public": 3.0}
CATEGORIES = ("event_type", "status", "protocol")


def fitted_codes(events: DataFrame, columns: tuple = CATEGORIES) -> dict[str, DataFrame]:
    """For each column a table (column, code): the place of each different value in their order; one scan for all."""
    value = lambda c: F.coalesce(F.col(c) if c in events.columns else F.lit(None).cast("string"), F.lit(""))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), value(c).alias("value")) for c in columns))).alias("p")
    different = numbered(events.select(pairs).select("p.*").distinct(), [F.col("of"), F.col("value")], "n")
    first = different.groupBy("of").agg(F.min("n").alias("first"))
    table = staged(different.join(first, "of").select("of", "value", (F.col("n") - F.col("first")).cast("double").alias("code")), "codes")
    return {c: table.filter(F.col("of") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")) for c in columns}


def vectors(events: DataFrame, fitted: dict[str, DataFrame] | None = None, ranges: DataFrame | None = None, feed: DataFrame | None = None) -> DataFrame:
    """event_id and the sixteen FEATURES as doubles; values that the fitted codes do not know get the next code.

    An unknown time or port is -1. Geographic kinds come from the address ranges, the match from the feed's addresses.
    """
    spark = events.sparkSession
    ranges, feed = joins.range_table(spark) if ranges is None else ranges, joins.feed_table(spark) if feed is None else feed
    kind = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), c), F.lit(0.0))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
    have = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    text = F.coalesce("message", F.lit(""))
    out = events.select(
        "event_id", "src_ip", "dst_ip", *(F.coalesce(have(c), F.lit("")).alias(c) for c in CATEGORIES), F.coalesce(F.hour("ts").cast("double"), F.lit(-1.0)).alias("hour"), F.coalesce(F.weekday("ts").cast("double"), F.lit(-1.0)).alias("weekday"),
        F.length(text).cast("double").alias("msg_len"), (number("src_port") if "src_port" in events.columns else F.lit(-1.0)).alias("src_port"), number("dst_port").alias("dst_port"), F.size(indicators.iocs(text)).cast("double").alias("ioc_count"),
        F.size(F.array_distinct(F.transform(indicators.personal(text), lambda h: h.type))).cast("double").alias("pii_count"), F.coalesce(F.col("risk").cast("double"), F.lit(0.0)).alias("risk"), F.coalesce(severity_rank(F.col("severity")) + 1, F.lit(0)).cast("double").alias("severity"),
        (F.size(indicators.suspicious(text)) > 0).cast("double").alias("suspicious"),
    )
    known = staged(feed.select(F.col("value").alias("_v")).distinct().withColumn("_hit", F.lit(1.0)), "feed")  # its size is known to the planner
    places = joins.located(joins.both_ends(events), ranges)
    for c in ("src_ip", "dst_ip"):
        out = joins.geo_lookup(out, ranges, c, places).withColumn(f"geo_{c[:3]}_kind", kind(F.col("kind"))).drop("country", "kind")
        out = out.join(known, out[c] == known["_v"], "left").withColumn(f"_hit_{c}", F.coalesce("_hit", F.lit(0.0))).drop("_v", "_hit")
    out = out.withColumn("intel_match", F.greatest("_hit_src_ip", "_hit_dst_ip"))
    for c, table in (fitted or fitted_codes(events)).items():
        unseen = table.agg(F.count(F.lit(1)).cast("double").alias("_unseen"))  # one row
        out = out.join(table, c, "left").join(F.broadcast(unseen)).withColumn(f"{c}_code", F.coalesce(f"{c}_code", "_unseen")).drop("_unseen")
    return out.select("event_id", *FEATURES)


def _grow(x: np.ndarray, r: np.random.Generator) -> list[list[float]]:
    """One isolation tree as rows of [feature, threshold, left, right, path length at a leaf]."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    rows: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(rows)
        rows.append([-1, 0, 0, 0, depth + _normal(len(part))])
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and depth < limit else []
        if len(spread):
            f = int(r.choice(spread))
            cut = float(r.uniform(part[:, f].min(), part[:, f].max()))
            rows[at] = [f, cut, add(part[part[:, f] <= cut], depth + 1), add(part[part[:, f] > cut], depth + 1), 0]
        return at

    add(x, 0)
    return rows


def _normal(n: int) -> float:
    """The average path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[list[list[float]]]:
    """The forest: each tree is grown in its own task from a seeded sample of at most `sample` rows.

    A row is offered to as many trees as it must be for each to get about twice its sample: to all of a small table's, to
    one of a large table's. Its hash with the tree's number decides, so a rerun draws the same rows.
    """
    n = features.count()
    if n < LEAST_ROWS:
        return []
    share = min(1.0, 2.0 * sample / n)
    tries = int(np.ceil(trees * share))  # trees that a row is offered to; one where the table is large
    first = F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(trees))
    h = F.pmod(F.xxhash64(F.lit(seed), "event_id", "tree"), F.lit(1 << 30))
    drawn = features.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("tree", F.pmod(first + F.col("_k"), F.lit(trees)).cast("int"))
    drawn = drawn.withColumn("h", h).filter(F.col("h") < int(min(1.0, trees * share / tries) * (1 << 30)) + 1).drop("_k")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "event_id"]).head(sample)
        rows = _grow(pdf[list(FEATURES)].to_numpy(), np.random.default_rng(seed + int(key[0])))
        return pd.DataFrame({"tree": [key[0]], "nodes": [[list(map(float, x)) for x in rows]]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>").orderBy("tree").collect()  # trees * 2 * sample nodes at most
    return [r.nodes for r in grown]


def score(features: DataFrame, forest: list) -> DataFrame:
    """event_id, raw: 2 ** -(mean path length / normal path length) for every row."""
    shared = features.sparkSession.sparkContext.broadcast([np.array(t) for t in forest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(1 + k)) for k in range(len(FEATURES))], axis=1)
            total, every = np.zeros(len(x)), np.arange(len(x))
            for t in shared.value:
                at = np.zeros(len(x), np.int64)
                while True:
                    f = t[at, 0].astype(np.int64)
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[every, np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
                total += t[at, 4]
            raw = 2.0 ** (-total / max(1, len(shared.value)) / _normal(SAMPLE)) if shared.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw)], ["event_id", "raw"])

    return features.select("event_id", *FEATURES).mapInArrow(run, "event_id long, raw double")


def scaled(raw: DataFrame) -> DataFrame:
    """Adds score (0 to 1 over the table) and anomalous."""
    raw = staged(raw, "scores")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return raw.join(F.broadcast(ends)).select("event_id", s.alias("score"), (s >= FLAG).alias("anomalous"))


@dataclass
class Model:
    """A fitted forest with the codes and the score range of what it was fitted on."""

    forest: list
    codes: dict[str, DataFrame]
    low: float
    high: float

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(k, t) for k, t in enumerate(self.forest)], "tree int, nodes array<array<double>>").write.parquet(f"{path}/forest")
        spark.createDataFrame([(self.low, self.high)], "low double, high double").write.parquet(f"{path}/range")
        for c, table in self.codes.items():
            table.write.parquet(f"{path}/{c}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        low, high = spark.read.parquet(f"{path}/range").first()
        forest = [r.nodes for r in spark.read.parquet(f"{path}/forest").orderBy("tree").collect()]  # trees * 2 * sample nodes at most
        return cls(forest, {c: spark.read.parquet(f"{path}/{c}") for c in CATEGORIES}, low, high)

    def score_events(self, events: DataFrame) -> DataFrame:
        """event_id, score (on the scale of the fitted table, 0 to 1) and anomalous, for events of any table or batch."""
        raw = score(vectors(events, self.codes), self.forest)
        span = self.high - self.low
        s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("raw") - self.low) / span)) if span > 0 else F.lit(0.0)
        return raw.select("event_id", s.alias("score"), (s >= FLAG).alias("anomalous"))


def fit_model(events: DataFrame) -> Model:
    fitted = fitted_codes(events)
    v = staged(vectors(events, fitted), "vectors")
    forest = fit(v)
    low, high = score(v, forest).agg(F.min("raw"), F.max("raw")).first()
    return Model(forest, fitted, low or 0.0, high or 0.0)


def reasons(features: DataFrame, top: int = 3) -> DataFrame:
    """event_id, reasons: the features with the largest |z|, in the order of FEATURES on ties."""
    stats = features.agg(*(F.avg(f).alias(f"{f}_m") for f in FEATURES), *(F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES))
    z = lambda f: F.when(F.col(f"{f}_s") > 1e-9, F.round((F.col(f) - F.col(f"{f}_m")) / F.col(f"{f}_s"), 6)).otherwise(0.0)
    items = F.array(*(F.struct((-F.abs(z(f))).alias("o"), F.lit(k).alias("k"), F.lit(f).alias("f"), z(f).alias("z")) for k, f in enumerate(FEATURES)))
    best = F.filter(F.slice(F.array_sort(items), 1, top), lambda i: i.o < 0)
    phrase = F.transform(best, lambda i: F.concat(i.f, F.when(i.z > 0, F.lit(" above usual")).otherwise(" below usual")))
    return features.join(F.broadcast(stats)).select("event_id", F.array_join(phrase, ", ").alias("reasons"))
