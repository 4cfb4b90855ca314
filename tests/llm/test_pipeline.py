"""The pipeline on the smallest tables: every stage against its own input."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from textquarry.llm import decontaminate, neardup
from textquarry.llm.shared import settle

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, DIR), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= ids and after
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert neardup.near_duplicates(before).where("kept").count() == docs.count()
        if name == "decontamination":
            assert decontaminate.hits(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).count() == 0
        ids = after
    assert {"start", "n_tokens", "ids_crc32"} <= set(docs.columns)
    total = docs.selectExpr("max(start + n_tokens) as e", "sum(n_tokens) as n").first()
    assert total["e"] == total["n"]


def test_short_items_count_in_the_leak_stage(spark, tmp_path):
    rows = [(0, "who wrote the tale of two towns", "en", "s", 1)]
    spark.createDataFrame(rows, "item_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "asked: Who wrote the tale of two towns? nobody knew"), (2, "who wrote the tale of two cities"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()) == [2, 3]


def test_stages_take_odd_rows(spark, docs, nothing, tmp_path):
    """Null ids, texts and sources, empty and long texts, repeated rows, columns with clashing names; and empty tables."""
    r = random.Random(1)
    base = [x["text"] for x in docs.select("text").collect()]
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([("a", leak), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    more = spark.createDataFrame([(900, f"{base[0]} {leak}", "en", "s1", 1), (901, " ".join(r.choice(base[1].split()) for _ in range(50)), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.unionByName(more, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        after, empty = stage(spark, odd, str(tmp_path)), stage(spark, nothing, f"{tmp_path}/none")
        assert empty.count() == 0
        if name == "tokens":
            assert after.count() == odd.count()
            continue
        assert after.columns == odd.columns and empty.columns == nothing.columns
        rows = after.collect()
        assert all(x["score"] in ("x", None) and x["kept"] in ("x", None) for x in rows)
        texts = [x["text"] for x in rows]
        if name == "quality":
            assert len(texts) <= odd.count()
        if name == "near_duplicates":
            assert len(texts) == len({x["component_id"] for x in neardup.near_duplicates(odd).where("n_shingles > 0 and component_id is not null").collect()}) + sum(not (x["text"] or "").split() for x in odd.collect())
        if name == "decontamination":
            assert sorted(t or "" for t in texts) == sorted(x["text"] or "" for x in odd.collect() if leak not in (x["text"] or ""))
        if name == "mixing":
            assert set(texts) <= {x["text"] for x in odd.collect()}
