"""Token search over an inverted index: postings with positions, written once, in place of a pattern over every text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedLog


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in small letters, in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


class TokenIndex:
    """Postings (token, key, positions) in files by token, added to batch by batch.

    A search reads the buckets of its own tokens only. It starts from the token that the fewest texts hold and keeps the
    places where the others stand at their distance; no text is read. A key stands for one text.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int = 64):
        self.log = KeyedLog(spark, path, f"token string, key {key_type}, positions array<int>", ("token",), buckets)
        self.spark = spark

    def add(self, number: int, texts: DataFrame, key: str, text: Column) -> None:
        """Batch `number`; written again after a failure, it is the same. A token that very many texts hold has a bucket of
        many files, as a bucket is split by size."""
        rows = texts.select(F.col(key).alias("key"), F.posexplode(tokens(text)).alias("at", "token"))
        self.log.append(number, rows.groupBy("token", "key").agg(F.array_sort(F.collect_list("at")).alias("positions")))

    def of(self, words: list[str], at: int) -> DataFrame:
        return self.log.of(self.spark.createDataFrame([(w,) for w in sorted(set(words))], "token string"), at)

    def phrase(self, text: str, at: int) -> DataFrame:
        """Keys of the texts, of batches up to `at`, in which the words follow one another as whole tokens. No words, no keys."""
        words = re.findall("[a-z0-9]+", text.lower())
        if not words:
            return self.of(["-"], at).select("key")
        found = self.of(words, at)
        counts = {r.token: r.n for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each word
        order = sorted(range(len(words)), key=lambda k: (counts.get(words[k], 0), k))
        places = lambda k: found.filter(F.col("token") == words[k])
        first = order[0]
        starts = places(first).select("key", F.filter(F.transform("positions", lambda p: p - first), lambda p: p >= 0).alias("starts"))

        def narrowed(now: DataFrame, k: int) -> DataFrame:
            other = places(k).select("key", F.transform("positions", lambda p: p - k).alias("_s"))
            return now.join(other, "key").select("key", F.array_intersect("starts", "_s").alias("starts")).filter(F.size("starts") > 0)

        return reduce(narrowed, order[1:], starts.filter(F.size("starts") > 0)).select("key")

    def any_of(self, text: str, at: int) -> DataFrame:
        """Keys of the texts that hold at least one of the words, with how many different ones."""
        words = re.findall("[a-z0-9]+", text.lower()) or ["-"]
        return self.of(words, at).groupBy("key").agg(F.count(F.lit(1)).alias("words"))
