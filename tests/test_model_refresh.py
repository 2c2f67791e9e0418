"""Samples that merge over batches are those of one pass, and the scorer takes the newest model."""

from pyspark.sql import functions as F

from threatframe.operators import anomaly, model_refresh
from threatframe.sources.security import security_events


def table(df):
    return sorted((r.tree, r.distance, r.event_id) for r in df.collect())


def test_samples_of_a_large_table_are_the_closest(spark):
    n, trees, sample = 20_000, 10, 30
    features = spark.range(n).select(F.col("id").alias("event_id"), *(F.rand(k).alias(f) for k, f in enumerate(anomaly.FEATURES)))
    circle = trees * model_refresh.STEP
    places = {r.event_id: r.p for r in features.select("event_id", F.pmod(F.xxhash64(F.lit(5), "event_id"), F.lit(circle)).alias("p")).collect()}
    want = [x for t in range(trees) for x in sorted((t, (p - t * model_refresh.STEP) % circle, i) for i, p in places.items())[:sample]]
    assert table(model_refresh.closest(features, trees, sample, 5)) == want


def test_batches_give_the_samples_of_one_pass(spark, sf, tmp_path):
    e = security_events(spark, sf)
    state = model_refresh.ForestRefresh(spark, str(tmp_path / "f"), trees=8, sample=40)
    parts = [e.filter("event_id % 10 < 2"), e.filter("event_id % 10 between 2 and 6"), e.filter("event_id % 10 > 6")]
    for number, part in enumerate(parts):
        state.update(number, part)
    state.update(2, parts[2])  # again, after a failure
    codes = state.model(0).codes
    assert table(state.samples(2)) == table(model_refresh.closest(anomaly.vectors(e, codes), 8, 40, anomaly.SEED))
    assert state.newest(9) == 2 and state.newest(1) == 1 and state.newest(-1) is None
    assert state.model(2).forest != state.model(1).forest and len(state.model(2).forest) == 8
    scored = state.model(2).score_events(e)
    assert scored.count() == e.count() and scored.filter("score < 0 or score > 1").count() == 0
