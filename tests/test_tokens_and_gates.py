"""Token counts against the libraries, and the checks that fail closed."""

from __future__ import annotations

import pytest

from textquarry.functions import tokenizers
from textquarry.operators import assemble, profile, refine
from textquarry.operators.assemble import IntegrityError
from textquarry.sources import readers

public = pytest.importorskip("public_tokenizers")
TEXTS = ["", "One two three. Four five!", "Über Straße 日本 😀", "word " * 700, None]


@pytest.mark.parametrize("name, kind", [("piece_bpe_32k.model", "sentencepiece"), ("byte_bpe_50k.json", "tokenizers")])
def test_counts_are_the_libraries(spark, name, kind):
    import sentencepiece
    from tokenizers import Tokenizer

    path = public.path(name)
    own = sentencepiece.SentencePieceProcessor(model_file=path) if kind == "sentencepiece" else Tokenizer.from_file(path)
    size = (lambda t: len(own.encode(t, out_type=int)) + 2) if kind == "sentencepiece" else (lambda t: len(own.encode(t).ids))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(3)
    for c in tokenizers.counters(path, path, kind=kind):
        for document, before in ((True, c.before_document), (False, c.before_query)):
            got = {r["i"]: r["n"] for r in df.select("i", c.count(df["text"], document).alias("n")).collect()}
            assert got == {i: None if t is None else size(before + t) for i, t in enumerate(TEXTS)}


def test_token_profile(spark):
    path = public.path("piece_bpe_32k.model")
    small = [tokenizers.TokenCounter("e5", path, 12, before_document="passage: ")]
    docs = spark.createDataFrame([("a", "One two three. Four five six. Seven!"), ("a", "x"), ("b", None)], "source string, text string")
    rows = {(r["source"], r["word_limit"]): r for r in profile.token_profile(docs, [3, 50], small).collect()}
    units = {3: ["One two three.", "Four five six.", "Seven!", "x"], 50: ["One two three. Four five six. Seven!", "x"]}
    for limit, texts in units.items():
        n = [tokenizers.lengths(path, "sentencepiece", ["passage: " + t])[0] for t in texts]
        r = rows["a", limit]
        assert (r["units"], r["e5_tokens_n"], r["e5_tokens_max"], r["e5_overflow_units"]) == (len(n), len(n), max(n), sum(x > 12 for x in n))
        assert r["e5_overflow_pct"] == 100 * sum(x > 12 for x in n) / len(n) and r["e5_p99_headroom"] == pytest.approx(12 - r["e5_tokens_p99"])
    bare = profile.token_profile(docs, [3, 50], tokenizers.counters(None, None, skip=True))
    assert profile.screen_limits(bare).first()["status"] == "tokenizers_not_run"
    assert profile.screen_limits(profile.token_profile(docs.where("source = 'a'"), [3, 50], small), 0.0, 12).first()["status"] == "screening_only_not_a_scientific_freeze"
    with pytest.raises(ValueError):
        tokenizers.counters(path, None)


def test_excluded_ids_and_the_key(spark):
    rows = spark.createDataFrame([("s", "A", f"i{n}") for n in range(10)], "source string, label string, sample_id string")
    first = refine.stratified_sample(rows, 4, 1)
    second = refine.stratified_sample(rows, 10, 1, excluded=first)
    assert second.count() == 6 and second.join(first, "sample_id").count() == 0
    blind, key = refine.blind_and_key(first, (), ("source", "label"))
    assert refine.judged_rows(blind, key).count() == 4
    for bad in (key.limit(3), key.unionAll(key)):
        with pytest.raises(IntegrityError):
            refine.judged_rows(blind, bad)


def test_batches(spark):
    def broken(rows, **more):
        return {tuple(r) for r in assemble.batch_violations(spark.createDataFrame(rows, "batch int, order int"), 2, **more).collect()}

    assert broken([(1, 1), (1, 2), (2, 3)]) == set()
    assert broken([(1, 1), (2, 2), (2, 3)]) == {(1, "size"), (2, "order")}
    assert broken([(1, 1), (1, 2), (2, 3), (3, 5)], last=2) == {(2, "order")} - {(2, "order")} | {(3, "range"), (3, "size")}
    assert broken([(1, 1), (1, 1)]) == {(1, "order")}


def test_preflight(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, sha256 string")
    gate = spark.createDataFrame([(21, 5, 5)], "batch int, rows int, decided int")
    gates = {"batch 21": (gate, "rows = decided")}
    assemble.preflight(found, found, gates)
    for files, own in ((found.limit(1), gates), (found, {"open": (gate, "rows < decided")}), (found, {"none": (gate.limit(0), "true")}), (found.withColumn("sha256", found["file"]), gates)):
        with pytest.raises(IntegrityError):
            assemble.preflight(files, found, own)


def test_older_diagnostics(spark):
    rows = spark.createDataFrame([("x", 1, "new"), ("y", 2, "own"), ("z", 1, None)], "id string, batch int, note string")
    legacy = spark.createDataFrame([("x", "old"), ("y", "never")], "id string, note string")
    assert sorted(map(tuple, assemble.with_diagnostics(rows, legacy, "id", ["note"]).collect())) == [("x", 1, "old"), ("y", 2, "own"), ("z", 1, None)]


def test_one_text_file_is_one_record(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title\nBody of a")
    (tmp_path / "b.txt").write_text("Other\nBody of b")
    assert [tuple(r)[:3] for r in readers.read_records(spark, str(tmp_path / "a.txt")).collect()] == [("a.txt", "Title", "Body of a")]
    assert readers.read_records(spark, str(tmp_path)).count() == 2


def test_header_with_a_line_break(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,"two\nlines"\n1,a\n')
    assert readers.read_csv_strict(spark, str(tmp_path / "t.csv")).columns == ["id", "two\nlines"]
