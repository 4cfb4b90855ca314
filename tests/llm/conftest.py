from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, and odd rows: null ids, texts and sources, empty and long texts, repeated rows."""
    r = random.Random(4)
    base = [words(r, 120) for _ in range(8)]
    passage = words(r, 60)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    for i in range(8, 40):
        t = base[i % 8].split()
        for _ in range(r.choice([0, 1, 3, 12])):
            t[r.randrange(len(t))] = words(r, 1)
        rows.append((i, " ".join(t), None, f"s{i % 4}", None))
    rows += [(i, f"{words(r, 30)} {passage} {words(r, 20)}", "en", None, 0) for i in range(40, 46)]
    rows += [(50, None, None, None, None), (51, "", "en", "s1", 0), (52, " \t\n", "en", "s1", 3), (53, "one", "en", "s1", 3), (54, "One", "en", "s1", 3), (None, base[0], "en", "s1", 1), (None, None, None, None, None)]
    rows += [(55, "é" * 300 + "😀", "fr", "s2", 301), (55, "é" * 300 + "😀", "fr", "s2", 301), (56, words(r, 30_000), "en", "s0", 1), (57, "Σ 日本 don't İ.", "xx", "s0", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names clash with those that operators make."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("node", "value", "size", "shard", "score", "start", "key", "target", "copies", "text_hash", "found", "kept"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
