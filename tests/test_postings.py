import random
import re

from pyspark.sql import functions as F

from threatframe.operators import search
from threatframe.operators.postings import TokenIndex


def test_phrases_equal_the_pattern_on_every_text(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "beta", "alpha beta", "Gamma-alpha", "beta.beta", "x1", "é", ""]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8)))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    ix = TokenIndex(spark, str(tmp_path / "p"), buckets=8)
    ix.add(0, df.filter("id < 100"), "id", F.col("t"))
    ix.add(1, df.filter("id >= 100"), "id", F.col("t"))
    ix.add(1, df.filter("id >= 100"), "id", F.col("t"))
    for phrase in ("alpha beta", "beta beta beta", "gamma alpha beta", "x1", "Beta  ALPHA", "absent beta", "beta alpha beta alpha"):
        want = sorted(r.id for r in df.filter(search.phrase(phrase, "t")).collect())
        assert sorted(r.key for r in ix.phrase(phrase, 1).collect()) == want, phrase
    assert ix.phrase("...", 1).count() == 0
    assert sorted(r.key for r in ix.phrase("x1", 0).collect()) == sorted(r.id for r in df.filter(search.phrase("x1", "t")).collect() if r.id < 100)


def test_a_search_reads_only_the_buckets_of_its_words(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("t"))
    ix = TokenIndex(spark, str(tmp_path / "p"), buckets=16)
    ix.add(0, df, "id", F.col("t"))
    plan = ix.phrase("word7", 0)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert scans and all(re.search(r"bucket#[0-9]+ = [0-9]+", x) or "bucket#" in x and " IN (" in x for x in scans)
    assert [r.positions for r in ix.of(["word7"], 0).collect()] == [[0]]
