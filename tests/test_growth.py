"""What must not grow faster than the input, and texts that hold nothing."""

from __future__ import annotations

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import canonical
from textquarry.operators import evaluation, retrieval


def lexical_tables(spark):
    docs = spark.createDataFrame([(i, " ".join(["common"] * (i % 7 + 1) + [f"own{i}", "rare"][: 1 + (i % 50 == 0)])) for i in range(2000)] + [(2000, None), (2001, "")], "doc_id long, text string")
    return docs.repartition(4, "doc_id"), spark.createDataFrame([(0, "common"), (1, "common rare"), (2, "own5 common")], "qid long, text string")


def test_tasks_send_only_their_best(spark):
    docs, queries = lexical_tables(spark)
    (block,) = retrieval.blocks(docs, queries)
    assert (block.n, round(block.avgdl, 6)) == (2002, round(sum(i % 7 + 2 + (i % 50 == 0) for i in range(2000)) / 2001, 6))
    for name, scores in (("bm25", retrieval.bm25_scores(docs, queries)), ("overlap", retrieval.overlap_scores(docs, queries))):
        sent = retrieval.lexical_scores(block, [name], 5)
        assert sent.count() <= 4 * 3 * 5 < scores.count()
        best = retrieval.ranked(scores, 5, name).select("qid", "doc_id", "score", "rank")
        assert sorted(retrieval.ranked_runs(sent, 5).select(*best.columns).collect()) == sorted(best.collect())


def test_terms_are_counted_without_a_shuffle(spark):
    docs, _ = lexical_tables(spark)
    assert "HashAggregate" not in retrieval.term_counts(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    got = {r["term"]: (r["df"], r["tf"]) for r in retrieval.term_sums(docs).collect()}
    assert got["rare"] == (40, 40) and got["common"] == (2000, sum(i % 7 + 1 for i in range(2000)))


def test_ideal_gains_from_counts(spark):
    qrels = spark.createDataFrame([(0, i, 2 if i < 3 else 1 if i < 6 else 0) for i in range(20)] + [(1, 0, 0)], "qid long, doc_id long, grade int")
    got = {r["qid"]: r["idcg_5"] for r in evaluation.ideal_gains(qrels, 5).collect()}
    import math

    assert abs(got[0] - sum(g / math.log2(i + 2) for i, g in enumerate([3, 3, 3, 1, 1]))) < 1e-12 and got[1] == 0


@pytest.mark.parametrize("name", ["csv_rows", "unicode_inventory", "signature_counts", "frequent_signatures", "rare_signatures", "signature_examples", "candidate_reasons", "review_batches", "text_features"])
def test_texts_that_hold_nothing(spark, tmp_path, name):
    """As the SQL has them: 0 / 0 passes every bound, an empty text is one empty string, CSV keeps it apart from null and trims nothing."""
    texts = ["", None, "", " led and trailed ", "word", "a b", "l1\nl1\nl1", "12 " * 30, "x" * 50]
    docs = [(i, t, "en", "src01", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')" + (" where doc_id <> 5" if name == "text_features" else ""))  # RE2's white space is ASCII
    df = entry.queries()[name](spark, str(tmp_path))
    df = df.where("doc_id <> 5") if name == "text_features" else df
    rel = con.execute(entry.oracle_sql()[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])


#: White space that Python knows and RE2 doesn't, lines that trim() keeps, other digits, and letters, digits, signs of Unicode 14 and 15.
ODD = [f"{w} x".join("ab") * 8 for w in "\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u3000"] + ["\t\nb\n\t\nb", "b \x85\nb\n\xa0b", "⁴⁵①a", "٣" * 20 + " " + "٣" * 9, "\U00011f51" * 3, "\u1b7d" * 3 + "a", "\u0870", "\U0001fae8", "\x80", "a" + "\xa0b" * 1600]


@pytest.mark.parametrize("name", ["signature_counts", "rare_signatures", "signature_examples", "frequent_signatures", "candidate_reasons", "review_batches", "text_features", "top_token_share"])
def test_characters_count_as_in_sql(spark, tmp_path, name):
    docs = [(i, t, "en", "src01", len(t)) for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df, rel = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])


def test_no_rare_signature_is_left_out(spark):
    from textquarry.operators import discovery

    counts = spark.createDataFrame([("signature", f"s{i}", 1 + i % 12) for i in range(300)], "axis string, signature string, pages long")
    assert discovery.rare_signatures(counts, 10, None, 1).count() == 250 and discovery.rare_signatures(counts, 10, 120, 1).count() == 120


def test_classes_are_not_searched_by_their_negation(spark):
    """A search for a negated class of many ranges took 20 times as long as the cut at the class."""
    from textquarry.functions import text as T
    from textquarry.functions.unicode import nfc

    odd = ["", " ", "a", " a  b c\u0085", "é", "x ", " ", None, "　 ", "a\n\nb "]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    got = df.select(T.tokens(F.col("t")), T.word_count(F.col("t")), T.spaces(F.col("t")), nfc(F.col("t"))).collect()
    for t, (tokens, words, spaces, normal) in zip(odd, got, strict=True):
        assert (tokens, words, spaces, normal) == ((None,) * 4 if t is None else (t.split(), len(t.split()), sum(c.isspace() for c in t), unicodedata.normalize("NFC", t)))
    plan = df.select(T.tokens(F.col("t")), T.word_count(F.col("t")), T.spaces(F.col("t")), nfc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in plan


def test_tokens_are_counted_by_words():
    """A text has the tokens of its words; a text with spaces that a model keeps is encoded whole."""
    public = pytest.importorskip("public_tokenizers")
    from textquarry.functions import tokenizers

    path = public.path("piece_bpe_32k.model")
    model = tokenizers.loaded(path, "sentencepiece")
    texts = ["", " ", "a  b", " a", "a ", "one two two", "one\n two", "▁ a▁", "x　y", "word " * 50 + "end", "😀 é ́ one"]
    assert tokenizers.lengths(path, "sentencepiece", texts) == [len(model.encode(t)) + 2 for t in texts]
    assert tokenizers.known_words(path)["two"] == len(model.encode("two"))  # remembered


def test_dense_search_sends_the_best_of_each_task(spark):
    rows = spark.createDataFrame([(i, [float(i % 13), 1.0, float(i % 7)]) for i in range(25_000)], "vec_id long, embedding array<double>").coalesce(1)
    q = rows.where("vec_id < 3")
    sent = retrieval.dense_top_k(rows, q, 5)
    assert sent.count() == 3 * 5  # one task, however many batches


def many_queries(spark, n=300):
    return spark.createDataFrame([(i, f"common rare own{i} own{i} own{i + 1} w{i % 3}") for i in range(n)], "qid long, text string")


def test_queries_share_a_vocabulary_and_rare_terms_have_lists(spark, monkeypatch):
    """Before, each block cut all texts again, and held a matrix of its queries by all their terms."""
    docs, _ = lexical_tables(spark)
    queries, kept = many_queries(spark), []
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 130)
    blocks = retrieval.blocks(docs, queries, keep=lambda df: kept.append(df) or df.cache())
    assert [len(b.ids) for b in blocks] == [130, 130, 40] and len(kept) == 1
    assert all(b.matrix.shape[1] < 10 < len(b.terms) for b in blocks[:2])
    made = [retrieval.lexical_scores(b, ["bm25", "overlap"], more=True) for b in blocks]
    got = {(r["run"], r["qid"], r["doc_id"]): r for r in retrieval.over_blocks(made, None).collect()}
    tf = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    known = [len(t) for r, t in tf.items() if r != 2000]
    import math

    for q in (0, 5, 131, 299):
        asked = [t for t in f"common rare own{q} own{q} own{q + 1} w{q % 3}".split()]
        for d in (0, 5, 6, 50, 131, 300, 2000, 2001):
            both = set(asked) & set(tf[d])
            row = got.get(("bm25", q, d))
            assert (row is None) == (not both)
            if not both:
                continue
            idf = {t: math.log(1 + (len(tf) - n + 0.5) / (n + 0.5)) for t in both for n in [sum(t in x for x in tf.values())]}
            room = 1.2 * (0.25 + 0.75 * len(tf[d]) / (sum(known) / len(known)))
            want = sum(asked.count(t) * idf[t] * tf[d].count(t) * 2.2 / (tf[d].count(t) + room) for t in both)
            norm = math.prod(math.sqrt(sum(x.count(t) ** 2 for t in set(x))) for x in (asked, tf[d]))
            cosine = sum(asked.count(t) * tf[d].count(t) for t in both) / norm
            assert row["score"] == row["bm25"] and abs(row["bm25"] - want) < 1e-6 and abs(row["overlap"] - cosine) < 1e-6
            assert row["part"] == len(both) / len(set(asked)) and got["overlap", q, d]["score"] == row["overlap"]


def test_tasks_are_few_where_many_queries_are_asked(spark, monkeypatch):
    docs, _ = lexical_tables(spark)
    monkeypatch.setattr(retrieval, "SENT", 10)
    (block,) = retrieval.blocks(docs.repartition(20, "doc_id"), many_queries(spark))
    assert retrieval.lexical_scores(block, ["bm25"], 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 20


def test_judgements_are_counted_and_not_written(spark, tmp_path, monkeypatch):
    """Before, all judgements were written or shuffled, a row for each pair."""
    from textquarry.plans import queries_evaluation as plans

    docs, _ = lexical_tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    many_queries(spark, 40).withColumnRenamed("qid", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels, written = [], plans.written
    monkeypatch.setattr(plans, "written", lambda df, label: labels.append(label) or written(df, label))
    for name in ("ranking_metrics", "judged_coverage", "set_complementarity", "fusion_gains", "best_setting", "convex_fusion"):
        entry.queries()[name](spark, str(tmp_path)).collect()
    assert set(labels) == {"counts", "runs", "grades"}
    c = plans.collection(spark, str(tmp_path))
    qrels, runs = c.qrels(), c.runs()
    assert sorted(map(tuple, c.grades().collect())) == sorted(map(tuple, evaluation.grades(qrels).collect()))
    assert sorted(map(str, evaluation.judged(runs.drop("grade"), qrels).select("run", "qid", "rank", "grade").collect())) == sorted(map(str, runs.select("run", "qid", "rank", "grade").collect()))


def test_rounds_are_dealt_over_the_cores(spark):
    """The few values lie in one partition; before, one task drew all rounds of them."""
    import hashlib

    from textquarry.operators import stats

    values = [((i * 37) % 11 - 4) / 10 for i in range(30)]
    diffs = spark.createDataFrame(list(enumerate(values)), "qid long, diff double").coalesce(1)
    permuted, drawn = stats.permutation_test(diffs, 200, 5), stats.bootstrap_interval(diffs, 200, 5)
    for df in (permuted, drawn):
        assert f"splits=Some({4 * spark.sparkContext.defaultParallelism})" in df._jdf.queryExecution().optimizedPlan().toString()
    sums = [sum(v if hashlib.md5(f"5|{r}|{i}".encode()).hexdigest()[0] < "8" else -v for i, v in enumerate(values)) for r in range(200)]
    real = abs(sum(values))
    assert abs(permuted.first()["p"] - (sum(abs(s) >= real - 1e-9 for s in sums) + 1) / 201) < 1e-12
    means = sorted(sum(values[int(hashlib.md5(f"5|{r}|{i + 1}".encode()).hexdigest()[:8], 16) % 30] for i in range(30)) / 30 for r in range(200))
    low = means[4] + (means[5] - means[4]) * (0.025 * 199 - 4)
    assert abs(drawn.first()["low"] - low) < 1e-9


def test_few_texts_are_python_strings_at_once(spark):
    """An Arrow batch may hold 10,000 pages; before, all of them and their results were Python objects together."""
    import pyarrow as pa

    from textquarry.functions import unicode

    seen = []
    texts = pa.array([f"{i}" + "x" * 100_000 for i in range(50)] + ["y" * 3_000_000, None, ""])
    out = unicode.in_slices(texts, lambda part: seen.append(sum(len(t or "") for t in part)) or pa.array([t and t[:3] for t in part], pa.string()))
    assert out.to_pylist() == [t and t[:3] for t in texts.to_pylist()] and max(seen[:3]) < 2 * unicode.SLICE and len(seen) > 5
    assert unicode.in_slices(texts.slice(0, 0), lambda part: pa.array(part, pa.string())).to_pylist() == []
    raws = ["<b>a</b> [[x|y]]", None, "", "{{t}}é"]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(unicode.strip_markup(F.col("raw")).alias("p")).collect()
    assert [tuple(r["p"]) for r in got] == [(None,) * 4 if r is None else unicode.plain_text(r) for r in raws]
