"""Text functions against Python's own semantics."""

from __future__ import annotations

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions import unicode as U
from textquarry.operators import discovery, refine

STRINGS = ["", " ", "a b c\u001cd  e", "é", "Straße", "²٤٥", "×÷ʻ", "a😀b", "'’‘ʻʼ`´ʹʽ", "Привет", "abc Привет", "a\nb\tc", "İstanbul ΑΣ", "x1 2y", "\r\n a \r b \n\n\n c"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "i int, t string").coalesce(1)


def values(frame, column):
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_words_follow_unicode_white_space(frame):
    assert values(frame, T.word_count(F.col("t"))) == [len(s.split()) for s in STRINGS]
    assert values(frame, T.tokens(F.col("t"))) == [s.split() for s in STRINGS]


def test_normalisation_and_folding(frame):
    norm = [" ".join(unicodedata.normalize("NFC", s).split()) for s in STRINGS]
    assert values(frame, T.normalize_text(F.col("t"))) == norm
    assert values(frame, U.casefold(F.col("t"))) == [s.casefold() for s in STRINGS]
    assert values(frame, T.exact_hash(F.col("t"))) == [hashlib.sha256(s.casefold().encode()).hexdigest() for s in norm]


def test_character_classes(frame):
    assert values(frame, T.digits(F.col("t"))) == [sum(c.isdigit() for c in s) for s in STRINGS]
    assert values(frame, T.letters(F.col("t"))) == [sum(c.isalpha() for c in s) for s in STRINGS]
    assert values(frame, T.spaces(F.col("t"))) == [sum(c.isspace() for c in s) for s in STRINGS]
    assert values(frame, T.latin_letters(F.col("t")))[6] == 2


def test_scripts(frame):
    found = values(frame, T.script_class(F.col("t")))
    assert found[4] == "LATIN" and found[9] == "CYRILLIC" and found[10] == "MIXED_BALANCED" and found[5] == "NO_LATIN_CYR"
    assert values(frame, T.apostrophe_variants(F.col("t")))[8] == "".join(sorted("'’‘ʻʼ`´ʹʽ"))


def test_layout(frame):
    assert values(frame, T.layout_text(F.col("t")))[-1] == "a\nb\n\nc"


def test_stable_scores(spark):
    row = spark.range(1).select(U.stable_score(7, "s", F.lit("k"))).first()[0]
    assert bytes(row) == hashlib.blake2b(b"7|s|k", digest_size=8).digest()


def test_excerpts():
    assert U.excerpt("short", 10) == "short"
    long_ = "a " * 500 + "x" * 60 + " b" * 500
    cut = U.excerpt(long_, 400)
    assert cut.startswith(long_[:133]) and cut.endswith(long_[-100:]) and "x" * 40 in cut


def test_plain_text():
    text, templates, tags, links = U.plain_text("== H ==\n{{a|{{b}}}}[[X|y]] '''z''' <b>w</b> &amp;")
    assert (templates, tags, links) == (2, 2, 1) and text.split() == ["H", "y", "z", "w", "&"]


def test_excerpt_has_its_marks():
    long_ = "a " * 500 + "x" * 60 + " b" * 500
    cut = U.excerpt(long_, 400)
    focus = 400 - 133 - 100 - 80
    assert cut == f"{long_[:133]}\n\n[...FOCUS AROUND LONGEST TOKEN / MIDDLE...]\n\n{long_[1030 - focus // 2 :][:focus]}\n\n[...TAIL...]\n\n{long_[-100:]}"
    assert U.excerpt("a\r\nb\rc", 10) == "a\nb\nc"
    blank = U.excerpt(" " * 1000, 400)
    assert len(blank) == 133 + focus + 100 + len(U.FOCUS_MARK) + len(U.TAIL_MARK)


def test_apostrophes_in_a_given_order(frame):
    assert values(frame, T.apostrophe_variants(F.col("t"), T.APOSTROPHES))[8] == "'’‘ʻʼ`´ʹʽ"


def test_markup_is_found_where_the_patterns_say(spark):
    strings = ["", None, "plain", "HTTPS://x", "LINK=x", "lınk=x", "100x200PX", "50%aF", "5 % of", "THUMB|", "frameleſſ", "________", "____＿＿＿＿", "＿" * 8, "alt=x", "www.x", "UPLOAD.WIKIMEDIA", "İmage:", "px", "Fayl:a"]
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    for pattern in (T.WIKI_MARKUP, T.URL_MARKUP, refine.RAW_MARKUP):
        assert all(a == b for a, b in df.select(T.has_markup(F.col("t"), pattern), F.col("t").rlike(pattern)).collect())
    for r in df.select("t", refine.clean_markup(F.col("t")).alias("c"), refine.clean_markup(F.concat("t", F.lit(" |"))).alias("d")).collect():
        assert r["t"] is None or r["d"].removesuffix("|").rstrip() == r["c"] or "|" in r["t"]


def test_nfc_leaves_only_settled_text_in_the_jvm(spark):
    strings = ["é", "é", "“quoted” – …", "Å", "각", "각", "ạ̈", "क़", "ỵ̣", "𝅗𝅥", "ο᾽", "ʼ", "日本", "ಲಲಲೋ", "豈"]
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    assert [r[0] for r in df.select(U.nfc(F.col("t"))).collect()] == [unicodedata.normalize("NFC", s) for s in strings]
    assert [r[0] for r in spark.createDataFrame([("STRAẞE ß",), ("İΣ ς",), ("ŉ ﬁ",)], "t string").select(U.casefold(F.col("t"))).collect()] == [s.casefold() for s in ("STRAẞE ß", "İΣ ς", "ŉ ﬁ")]


def test_buckets_have_the_labels_of_the_discovery(spark):
    df = spark.createDataFrame([*enumerate((0.0, 0.01, 0.04, 0.05, 0.299, 0.3, 0.9, 1.1, 1.11))], "i long, v double")
    assert values(df, discovery.ratio_bucket(F.col("v"), (0.01, 0.05, 0.15, 0.30))) == ["<0.01", "<0.05", "<0.05", "<0.15", "<0.3", ">=0.3", ">=0.3", ">=0.3", ">=0.3"]
    assert values(df, discovery.compression_bucket(F.col("v"))) == ["<0.05", "<0.05", "<0.05", "0.05-0.15", "0.15-0.35", "0.15-0.35", "0.90-1.10", "0.90-1.10", ">1.10"]
    counts = spark.createDataFrame([*enumerate((-1, 0, 1, 2, 3, 9, 10))], "i long, v long")
    assert values(counts, discovery.count_bucket(F.col("v"), (1, 3, 9))) == ["0", "0", "1", "2-3", "2-3", "4-9", "10+"]


def test_residue_counts(spark):
    text = "{{a}} {|x|} a = b == c\n* item\nk = v | https://x.y link=z"
    row = discovery.residue_features(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row["residue_double_braces"], row["residue_table_markers"], row["residue_pipes"], row["residue_equals"]) == (2, 2, text.count("|"), text.count("="))
    assert (row["residue_urls"], row["residue_wiki"], row["residue_list_lines"]) == (1, 1, 1)


def test_classes_hold_what_they_say():
    """Each settled character is its own NFC whatever stands before it, and folds as the JVM lowers it."""
    import re

    seconds = {chr(int(d[1], 16)) for c in range(0x110000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<"}
    settled = [chr(c) for c in range(0x10000) if re.match(f"[{U.SETTLED}]", chr(c))]
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in seconds for c in settled)
    assert all(c.casefold() == c.lower().replace("ß", "ss") for c in map(chr, range(0x10000)) if re.match(f"[{U.FOLDS_TO_LOWER}]", c))
