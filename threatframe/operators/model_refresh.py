"""A forest that keeps up with its table: per tree the sample of smallest hashes, which merges over batches, and models by version.

An event stands at one place on a circle, by the hash of its id; tree t's sample are the `sample` events that follow the t-th
mark most closely. The samples of two batches together hold that of both, whatever the batches are, so after any number of
batches they are those of one pass over all events. A batch offers a tree only events closer than its farthest so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatframe.functions.staging import read_texts, removed, staged, write_text
from threatframe.operators import anomaly
from threatframe.operators.anomaly import FEATURES, SEED, TREES, Model

STEP = 1 << 20  #: places between the marks of neighbouring trees


def closest(features: DataFrame, trees: int, sample: int, seed: int, bound: int | None = None) -> DataFrame:
    """(tree, distance, event_id, FEATURES): for each tree the `sample` events that follow its mark most closely (ties: the least
    id), of those nearer than bound; without one, of all.

    Without a bound a tree's sample is first looked for within four times the distance that it should take, and only if some
    tree falls short, farther. So an event is offered to all trees of a small table, and to hardly one of a large one's.
    """
    circle = trees * STEP
    if bound is None:
        n = features.count()
        near = min(circle, -(-4 * sample * circle // max(1, n)))
        while near < circle:
            found = staged(closest(features, trees, sample, seed, near), "closest")
            full = found.groupBy("tree").count().filter(F.col("count") >= sample).count()
            if full == trees:
                return found
            near *= 8
        bound = circle
    place = F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(circle))
    rows = features.select("event_id", *FEATURES, place.alias("_at")).withColumn("_own", F.expr(f"_at div {STEP}")).withColumn("_d", F.col("_at") - F.col("_own") * STEP)
    back = F.least(F.lit(trees - 1), F.expr(f"({bound} - 1 - _d) div {STEP}"))
    rows = rows.filter(F.col("_d") < bound).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), back.cast("long"))))
    rows = rows.select(F.pmod(F.col("_own") - F.col("_j"), F.lit(trees)).cast("int").alias("tree"), (F.col("_d") + F.col("_j") * STEP).alias("distance"), "event_id", *FEATURES)
    return _least(rows, sample)


def _least(rows: DataFrame, sample: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("distance", "event_id"))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= sample).drop("_nth")


class ForestRefresh:
    """Samples and models of a stream of batches in one folder. Categories keep the codes that they were first given, so that
    vectors of all batches agree; later values share one code, as in a stored model."""

    def __init__(self, spark: SparkSession, path: str, trees: int = TREES, sample: int = anomaly.SAMPLE, seed: int = SEED):
        self.spark, self.path, self.trees, self.sample, self.seed = spark, path, trees, sample, seed

    def newest(self, at: int) -> int | None:
        """The last finished version of batch `at` or before."""
        return max((int(n) for n in read_texts(self.spark, f"{self.path}/finished") if int(n) <= at), default=None)

    def samples(self, at: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/samples/{self.newest(at)}")

    def model(self, at: int) -> Model:
        """The newest model of batch `at` or before."""
        return Model.load(self.spark, f"{self.path}/models/{self.newest(at)}")

    def update(self, number: int, events: DataFrame) -> None:
        """Merge a batch into the samples and fit a model of this version. Done again after a failure, it gives the same."""
        last = self.newest(number - 1)
        codes = anomaly.fitted_codes(events) if last is None else self.model(last).codes
        features = staged(anomaly.vectors(events, codes), "vectors")
        bound, old = None, None
        if last is not None:
            old = self.samples(last)
            far = old.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
            limit = far.agg(F.count(F.lit(1)).alias("trees"), F.min("n").alias("least"), F.max("far").alias("far")).first()
            bound = limit.far + 1 if limit.trees == self.trees and limit.least >= self.sample else self.trees * STEP
        new = closest(features, self.trees, self.sample, self.seed, bound)
        if old is not None:
            new = _least(old.unionByName(new).dropDuplicates(["tree", "event_id"]), self.sample)
        folder = f"{self.path}/samples/{number}"
        new.write.mode("overwrite").parquet(folder)
        kept = self.spark.read.parquet(folder)

        seed = self.seed

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["distance", "event_id"])
            rows = anomaly._grow(pdf[list(FEATURES)].to_numpy(), np.random.default_rng(seed + int(key[0])))
            return pd.DataFrame({"tree": [key[0]], "nodes": [[list(map(float, x)) for x in rows]]})

        forest = [r.nodes for r in kept.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>").orderBy("tree").collect()]  # trees * 2 * sample nodes at most
        scores = anomaly.score(kept.dropDuplicates(["event_id"]).select("event_id", *FEATURES), forest).agg(F.min("raw"), F.max("raw")).first()
        removed(self.spark, f"{self.path}/models/{number}")
        Model(forest, codes, scores[0] or 0.0, scores[1] or 0.0).save(self.spark, f"{self.path}/models/{number}")
        write_text(self.spark, f"{self.path}/finished/{number}", "")
