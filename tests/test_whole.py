"""Registered queries over whole tables: on small rows, and against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from textquarry.operators import retrieval
from test_queries import DIR, TABLES, canonical

WHOLE = ["term_statistics", "df_idf", "macro_metrics", "judged_coverage", "set_complementarity", "fusion_gains", "best_setting", "trec_qrels", "permutation_test", "bootstrap_ci", "convex_fusion", "query_features", "rrf_fusion", "csv_rows", "strict_csv_rows", "jsonl_rows", "record_rows", "parquet_rows", "fresh_strata", "equivalence", "regression"]


@pytest.fixture
def small(spark, tmp_path):
    """Odd and even ids alike hold query terms; document 4 holds one of six, below a fifth."""
    docs = [(1, "red fox over the lazy dog"), (2, "red fox over the"), (3, "red fox over"), (4, "dog"), (5, "nothing here"), (7, "red fox over the lazy cat")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "red fox over the lazy dog")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_all_documents_are_judged(spark, small):
    lines = {r["value"] for r in entry.queries()["trec_qrels"](spark, small).collect()}
    assert lines == {"0 0 1 2", "0 0 2 1", "0 0 3 1", "0 0 7 2"}  # 4 and 5 are unjudged
    got = {r["run"]: (r["judged"], r["shown"]) for r in entry.queries()["judged_coverage"](spark, small).collect()}
    assert got == {"bm25": (4, 5), "overlap": (4, 5)}  # document 4 is shown and unjudged
    assert {r["recall_50"] for r in entry.queries()["ranking_metrics"](spark, small).collect()} == {1.0}


def test_statistics_of_all_terms(spark, small):
    import math

    got = {r["term"]: r for r in entry.queries()["term_statistics"](spark, small).collect()}
    df = {"red": 4, "fox": 4, "over": 4, "the": 3, "lazy": 2, "dog": 2, "cat": 1, "nothing": 1, "here": 1}
    assert {t: r["df"] for t, r in got.items()} == df
    assert all(r["idf"] == round(math.log(1 + (6 - df[t] + 0.5) / (df[t] + 0.5)), 6) and (r["n"], r["avgdl"], r["rare"]) == (6, round(22 / 6, 6), False) for t, r in got.items())
    docs = spark.createDataFrame([(i, "common once" if i == 0 else "common twice" if i < 3 else "common") for i in range(1000)], "doc_id long, text string")
    assert {r["term"]: r["rare"] for r in retrieval.term_statistics(docs).collect()} == {"common": False, "once": True, "twice": False}


def test_rounds_and_grid(spark, small):
    assert {r["alpha"] for r in entry.queries()["convex_fusion"](spark, small).collect()} == {n / 20 for n in range(1, 20)}
    p = entry.queries()["permutation_test"](spark, small).first()["p"]
    assert p == 1.0 or abs(p * 10_001 - round(p * 10_001)) < 0.01
    assert "range(10000)" in entry.oracle_sql()["permutation_test"] and "range(10000)" in entry.oracle_sql()["bootstrap_ci"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    if name not in entry.oracle_sql():
        pytest.skip("no SQL")
    df = entry.queries()[name](spark, DIR)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), names)
