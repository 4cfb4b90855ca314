"""Readers and writers round trips."""

from __future__ import annotations

import bz2
import json

import pytest

from textquarry.operators.assemble import IntegrityError
from textquarry.plans import pipelines
from textquarry.plans.config import DiscoveryConfig, ProfileConfig
from textquarry.sources import readers, sinks
from textquarry.streaming import profile as stream

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">
<page><title>A</title><ns>0</ns><id>1</id><revision><text bytes="3">  Hello [[B|there]].
* x</text></revision></page>
<page><title>R</title><ns>0</ns><id>2</id><redirect title="A"/><revision><text>#REDIRECT</text></revision></page>
<page><title>T</title><ns>1</ns><id>3</id><revision><text>talk</text></revision></page>
<page><title>N</title><ns>0</ns><id></id><revision><text></text></revision></page>
</mediawiki>"""


def test_pages(spark, tmp_path):
    path = tmp_path / "d.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    pages = readers.read_pages(spark, str(path))
    rows = {r["page_id"]: r for r in pages.collect()}
    assert set(rows) == {"1", "2", "3", "N"} and rows["2"]["is_redirect"] and rows["1"]["raw"].startswith("  Hello")
    docs = readers.read_wikipedia(spark, str(path)).collect()
    assert [(d["doc_id"], d["text"]) for d in docs] == [("1", "Hello there.\n* x")]
    candidates = pipelines.structural_discovery(pages, str(tmp_path / "out"), DiscoveryConfig(baseline=5, rare_pages=1))
    assert candidates.count() == 1


def test_txt(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("\n Title \n\nbody one\nbody two\n")
    (tmp_path / "c/b.txt").write_text("only line")
    (tmp_path / "c/e.txt").write_text("  \n")
    rows = {r["id"]: (r["title"], r["text"], r["category"]) for r in readers.read_records(spark, str(tmp_path)).collect()}
    assert rows == {"c/a.txt": ("Title", "body one\nbody two", "c"), "c/b.txt": ("", "only line", "c")}


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿id;text\n1;"a;b"\n2;"say ""hi"""\n')
    assert [(r["id"], r["text"]) for r in readers.read_csv(spark, str(p)).collect()] == [("1", "a;b"), ("2", 'say "hi"')]
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n1,2,3\n")
    for bad in ("twice", "ragged"):
        with pytest.raises(IntegrityError):
            readers.read_csv_strict(spark, str(tmp_path / f"{bad}.csv"))


def test_json(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"id": 1, "body": "x"}, {"id": 2, "body": "y"}]}))
    (tmp_path / "l.jsonl").write_text('{"id": 3, "body": "z"}\n\n')
    assert sorted(r["id"] for r in readers.read_records(spark, str(tmp_path)).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        readers.read_records(spark, str(tmp_path / "none"))


def test_batches_and_cache(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/batch_001.jsonl").write_text('{"candidate_id": "UZWP-7"}\n{"page_id": "8"}\n')
    rows = readers.read_batches(spark, str(tmp_path / "b")).orderBy("line").collect()
    assert [(r["batch"], r["line"], r["page_id"]) for r in rows] == [(1, 1, "7"), (1, 2, "8")]
    docs = readers.demo_documents(spark)
    sinks.write_sample_cache(docs, spark.createDataFrame([("news", 9)], "source string, total_seen long"), str(tmp_path / "c"))
    back, counts = readers.read_sample_cache(spark, str(tmp_path / "c"))
    assert back.count() == 6 and {r["source"]: r["total_seen"] for r in counts.collect()} == {"news": 9, "legal": 2, "wikipedia": 2}


def test_deterministic_outputs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", ["x", "y"]), (1, None, [])], "k int, v string, a array<string>")
    assert sinks.csv_bytes(df, ["k"], ["k"]) == sinks.csv_bytes(df.repartition(3), ["k"], ["k"]) == b"k,a,v\n1,,\n2,x|y,b\n"
    sinks.write_parquet(df.drop("a"), str(tmp_path / "p"))
    (tmp_path / "in").write_text("1")
    m = sinks.write_manifest(tmp_path / "m.json", {}, {}, {"in": str(tmp_path / "in")})
    assert m["inputs"]["in"] == sinks.sha256_file(tmp_path / "in")


def test_profile_pipeline(spark, tmp_path):
    docs = readers.demo_documents(spark)
    got = pipelines.corpus_profile(docs, str(tmp_path / "o"), ProfileConfig(word_limits=(20, 40)))
    assert got["source_profile"].count() == 3 and (tmp_path / "o/recommendation").exists()
    with pytest.raises(ValueError):
        ProfileConfig(word_limits=(0,))
    pipelines.classification(docs, str(tmp_path / "k"))


def test_streams(spark, tmp_path):
    docs = readers.demo_documents(spark)
    docs.write.parquet(str(tmp_path / "s"))
    counts = stream.running_counts(stream.read_stream(spark, str(tmp_path / "s"), docs.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["source"]: r["documents"] for r in spark.table("running").collect()} == {"wikipedia": 2, "news": 2, "legal": 2}
    stream.write_flags(stream.read_stream(spark, str(tmp_path / "s"), docs.schema), str(tmp_path / "f"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == 6
