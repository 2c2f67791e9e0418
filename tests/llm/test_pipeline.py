import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import docs_of, empty, odd, rows_of
from tests.llm.test_text_operators import brute_facts, near_classes
from threatframe.llm import quality_rules


def test_stages_against_brute_force(spark, sf):
    docs = docs_of(spark, sf)
    rows = rows_of(docs)
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    rows = [r for r in rows if verdict[r["doc_id"]]]
    assert not any(brute_facts(r["text"])[-1] for r in rows)
    last = {}
    for r in rows:
        key = hashlib.sha256((r["text"] or "").encode().lower()).digest()
        if key not in last or last[key]["doc_id"] < r["doc_id"]:
            last[key] = r
    rows = list(last.values())
    heads = {c for _, c, _ in near_classes(rows)}
    steps, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        steps.append([r.doc_id for r in now.select("doc_id").collect()])
    assert sorted(steps[1]) == sorted(r["doc_id"] for r in rows)
    assert set(steps[2]) == heads and len(steps[2]) == len(heads)
    taken = Counter(steps[3])
    assert set(taken) <= heads and max(taken.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).filter("piece = 0")
    assert Counter(r.doc_id for r in packed.select("doc_id").collect()) == taken


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    for k, docs in enumerate((odd(spark), empty(spark))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert all(0 < r.length <= 4096 for r in got)
    assert got == []


def test_queries_equal_their_sql(spark, sf):
    import glob
    import os

    import duckdb

    from threatframe.llm import queries

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(sql).df()
        plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).replace({"<NA>": "None", "nan": "None"}).values.tolist()))
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want), name
