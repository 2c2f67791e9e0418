"""Small document tables with the awkward cases, and brute-force versions to hold results against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


P = " ".join(f"p{i}" for i in range(70))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "en", None, 5),
    (6, "É é one two three four five six seven eight nine ten ÉÉ", None, "b", 3),
    (6, "É é one two three four five six seven eight nine ten ÉÉ", None, "b", 3),
    (7, "x " * 40, "de", "c", 80),
    (8, P + " tail one two", "en", "c", 3),
    (9, "head " + P, "en", "c", 3),
    (10, P[: len(P) // 2] + "\n" + P[: len(P) // 2] + " #*$%", "en", "c", 3),
    (11, LONG, "en", "a", 3),
    (12, LONG + " more", "fr", "a", 3),
    (None, "no id at all but some words in the text", "en", "a", 3),
    (None, "no id at all but some words in the text", "en", "a", 3),
    (13, "<|endoftext|> it's the 3rd café, don't  you see? 'tis İstanbul ΣΑΣ á {}", "en", "z", 3),
    (14, "x", "en", "z", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: Every name that a plan of ours gives a column of its own.
CLASH = """size row rank bucket length kept digest n_words h p slot key id none nth node label copies copy c0 c1 c2 part shard at text_hash anchors min_id
    keys source_size target taken key_rows centre head lang_pred score word mask _id _none _digest _nth _row _copies _copy _h _s _at _all _bucket _own _before _n _new
    _whole _full _weight _level _v _high""".split()


def odd(spark, extra=True):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "text", "source").collect()]
