"""Rule classes after cleanup, blinded samples, and scores against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.unicode import stable_score

from .assemble import key_violations, require

# The cleanup rules in order, each replaced by a space.
CLEANUP = (
    r"(?iu)https?://\S+",
    r"(?iu)\bwww\.\S+",
    r"(?iu)\blink=//upload\.wikimedia\.org/\S+",
    r"(?iu)\blink=Fayl:[^\s]+",
    r"(?iu)\bFayl:[^\s]+",
    r"(?iu)\b(?:right|left|center)\|thumb\|[0-9]{2,4}x[0-9]{2,4}px\|",
    r"(?iu)\bthumb\|[0-9]{2,4}x[0-9]{2,4}px\|",
    r"(?iu)\b(?:frameless|thumb|right|left|center)\|",
    r"(?iu)\balt=[^|\s]*\|",
    r"(?iu)\b[0-9]{2,4}x[0-9]{2,4}px\|",
    r"[_＿]{8,}",
)
RAW_MARKUP = r"(?iu)(?:\blink=|\bFayl:|upload\.wikimedia|wikimedia\.org|\bframeless\b|\bthumb\b|\balt=|[0-9]{2,4}x[0-9]{2,4}px|https?://|\bwww\.|[_＿]{8,})"
CLASSES = ("SEVERE_STRUCTURAL", "CLEANABLE_MARKUP", "PROSE_LIKE")


def clean_markup(text: Column) -> Column:
    """The text after the rules; a text that none of them can match isn't searched by each."""
    ruled = text
    for rule in CLEANUP:
        ruled = F.regexp_replace(ruled, rule, " ")
    may = text.contains("|") | text.contains("//") | text.rlike("(?iu)www\\.|fayl:|[_＿]{8}")
    return T.strip(F.regexp_replace(F.regexp_replace(F.when(may, ruled).otherwise(text), "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def refined_labels(units: DataFrame, text: str = "unit") -> DataFrame:
    """units with the cleaned text's counts and one of CLASSES as label."""
    units = units.withColumn("cleaned", clean_markup(F.col(text)))
    units = units.withColumn("_all", T.tokens(F.col("cleaned")))
    long_ones = F.filter("_all", lambda t: F.length(t) >= 30)
    kept = F.transform(long_ones, lambda t: F.struct(F.length(t).alias("len"), T.matches(t, T.LETTER_DIGIT).alias("turns"), (T.digits(t) / F.greatest(F.lit(1), F.length(t))).alias("digits")))
    units = units.withColumn("_tokens", kept)

    def some(test) -> Column:
        return F.exists("_tokens", test)

    def many(test) -> Column:
        return F.size(F.filter("_tokens", test)).cast("long")

    glued = many(lambda t: ((t["len"] >= 50) & (t["turns"] >= 3)) | ((t["len"] >= 40) & (t["digits"] >= 0.35) & (t["turns"] >= 2)))
    cleaned = F.col("cleaned")
    units = units.withColumns(
        {
            "words": F.size("_all").cast("long"),
            "raw_words": T.word_count(F.col(text)),
            "max_word_len": T.longest(F.transform("_all", F.length)),
            "digit_ratio": T.digits(cleaned) / F.greatest(F.lit(1), F.length(cleaned)),
            "transitions": T.letter_digit_turns(cleaned),
            "digit_runs": T.matches(cleaned, T.LONG_DIGIT_RUN),
            "long40": many(lambda t: t["len"] >= 40),
            "long80": many(lambda t: t["len"] >= 80),
            "glued": glued,
            "_mixed30": some(lambda t: (t["len"] >= 30) & (t["turns"] >= 2)),
            "markup": T.has_markup(F.col(text), RAW_MARKUP) | (cleaned != T.strip(F.col(text))),
        }
    )
    severe = (F.col("long80") > 0) | (F.col("glued") > 0) | ((F.col("long40") >= 2) & (F.col("digit_ratio") >= 0.08)) | ((F.col("digit_runs") >= 2) & F.col("_mixed30"))
    label = F.when(severe, CLASSES[0]).when(F.col("markup"), CLASSES[1]).otherwise(CLASSES[2])
    return units.withColumn("label", label).drop("_all", "_tokens", "_mixed30", "cleaned")


def refined_summary(labels: DataFrame, most_words: int) -> DataFrame:
    """A row for each source and limit: units of each class, raw overflow, and what overflow is left among units that aren't severe."""
    n = F.count(F.lit(1))
    mild = F.col("label") != CLASSES[0]
    over = F.col("words") > most_words
    shares = [x for c in CLASSES for x in (F.count_if(F.col("label") == c).alias(c.lower()), (100 * F.count_if(F.col("label") == c) / F.greatest(F.lit(1), n)).alias(f"{c.lower()}_pct"))]
    return labels.groupBy("source", "word_limit").agg(n.alias("units"), *shares, F.count_if(F.col("raw_words") > most_words).alias("raw_overflow"), F.count_if(mild & over).alias("residual_overflow"), (100 * F.count_if(mild & over) / F.greatest(F.lit(1), F.count_if(mild))).alias("residual_overflow_pct"))


def residual_rows(labels: DataFrame, most_words: int) -> DataFrame:
    return labels.where((F.col("label") != CLASSES[0]) & (F.col("words") > most_words))


def label_examples(labels: DataFrame, cap: int) -> DataFrame:
    """The first `cap` units of each label within each source and limit."""
    w = Window.partitionBy("source", "word_limit", "label").orderBy("doc_id", "chunk_index")
    return labels.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)


def stratified_sample(rows: DataFrame, per_stratum: int, seed: int, keys: tuple[str, ...] = ("source", "label"), id_column: str = "sample_id", excluded: DataFrame | None = None) -> DataFrame:
    """Up to per_stratum rows of each stratum, by hash: the same rows whatever the partitioning. excluded: ids of an earlier sample, which don't come again."""
    if excluded is not None:
        rows = rows.join(excluded.select(id_column).distinct(), id_column, "left_anti")
    scored = rows.withColumn("_score", stable_score(seed, F.concat_ws("|", *keys), F.col(id_column)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_score", id_column))
    return scored.withColumn("_nth", nth).where(F.col("_nth") <= per_stratum).drop("_nth", "_score")


def blind_and_key(sample: DataFrame, shown: tuple[str, ...], hidden: tuple[str, ...], id_column: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """What an annotator sees, with empty columns to fill, and the key with the predictions."""
    blind = sample.select(id_column, *shown, F.lit("").alias("human_label"), F.lit("").alias("human_notes"))
    return blind, sample.select(id_column, *hidden)


def judged_rows(blind: DataFrame, key: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """The blind rows with what the key says of them. An id that the key lacks, or that stands twice on a side, is an error and no row is dropped for it."""
    require(key_violations(blind, id_column), "blind ids")
    require(key_violations(key, id_column), "ids of the key")
    require(blind.join(key, id_column, "left_anti").select(id_column), "ids without a key")
    return blind.join(key, id_column)


def confusion(pairs: DataFrame, predicted: str, human: str, classes: tuple = CLASSES) -> DataFrame:
    """A row for each class: how often it was predicted for each human label."""
    wide = pairs.where(F.col(human).isin(*classes)).groupBy(F.col(predicted).alias("predicted")).pivot(human, list(classes)).count()
    return wide.select("predicted", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"human_{c}") for c in classes])


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval within [0, 1]; NaN without trials."""
    p = successes / n
    scale = 1 + z * z / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    nan = F.lit(float("nan"))
    return F.when(n > 0, F.greatest(F.lit(0.0), (middle - half) / scale)).otherwise(nan), F.when(n > 0, F.least(F.lit(1.0), (middle + half) / scale)).otherwise(nan)


def class_metrics(pairs: DataFrame, predicted: str, human: str, classes: tuple = CLASSES) -> DataFrame:
    """A row for each class: tp, fp, fn, precision, recall, f1, and the precision's interval; NaN where undefined."""
    known = pairs.where(F.col(human).isin(*classes))
    each = known.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    p, h = F.col(predicted) == F.col("class"), F.col(human) == F.col("class")
    sums = each.groupBy("class").agg(F.count_if(p & h).alias("tp"), F.count_if(p & ~h).alias("fp"), F.count_if(~p & h).alias("fn"))
    nan = F.lit(float("nan"))

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(nan)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    low, high = wilson(tp, tp + fp)
    scored = sums.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "precision_low": low, "precision_high": high})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(F.isnan(both) | (both == 0), nan).otherwise(2 * F.col("precision") * F.col("recall") / both))
