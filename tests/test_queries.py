"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the driver compares all of them.
CHECKED = ["source_profile", "segmentation_profile", "structural_flags", "refined_summary", "class_metrics", "signature_counts", "candidate_reasons", "unicode_inventory", "batch_manifest", "overlay_decisions", "bm25_top10", "dense_top10", "ranking_metrics", "kappa", "holm_bh"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(rel.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
