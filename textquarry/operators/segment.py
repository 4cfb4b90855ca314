"""Retrieval units: sentences packed greedily up to a word limit, without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import PARAGRAPH_BREAK, SENTENCE_END, SPACE, layout_text, normalize_text, strip, tokens, word_count


def sentences(body: Column) -> Column:
    """Paragraphs first, then sentence ends; blank pieces are dropped. body is layout text."""
    paragraphs = F.filter(F.transform(F.split(body, PARAGRAPH_BREAK), strip), lambda p: p != "")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.split(p, f"(?<={SENTENCE_END})[{SPACE}]+")))
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def pieces(words: Column, capacity: Column) -> Column:
    """Slices of `capacity` words, each joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.size(words), capacity), lambda i: F.array_join(F.slice(words, i, capacity), " "))


def packed_counts(counts: Column, capacity: Column) -> Column:
    """The words of each unit, from the words of each sentence."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] > 0, F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    def step(acc: Column, n: Column) -> Column:
        whole = F.array_repeat(capacity.cast("long"), F.floor(n / capacity).cast("int"))
        split = F.concat(closed(acc), whole, F.when(n % capacity > 0, F.array((n % capacity).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        return (
            F.when(n > capacity, F.struct(split.alias("out"), F.lit(0).cast("long").alias("open")))
            .when(acc["open"] + n > capacity, F.struct(closed(acc).alias("out"), n.alias("open")))
            .otherwise(F.struct(acc["out"].alias("out"), (acc["open"] + n).alias("open")))
        )

    return F.aggregate(counts, start, step, closed)


def packed_texts(units: Column, capacity: Column) -> Column:
    """The texts of the units, from sentences as struct<text, words>."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("text"), F.lit(0).cast("long").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] > 0, F.concat(acc["out"], F.array(acc["text"]))).otherwise(acc["out"])

    def state(out: Column, text: Column, n: Column) -> Column:
        return F.struct(out.alias("out"), text.alias("text"), n.cast("long").alias("open"))

    def step(acc: Column, u: Column) -> Column:
        joined = F.when(acc["open"] > 0, F.concat_ws(" ", acc["text"], u["text"])).otherwise(u["text"])
        return (
            F.when(u["words"] > capacity, state(F.concat(closed(acc), pieces(tokens(u["text"]), capacity)), F.lit(""), F.lit(0)))
            .when(acc["open"] + u["words"] > capacity, state(closed(acc), u["text"], u["words"]))
            .otherwise(state(acc["out"], joined, acc["open"] + u["words"]))
        )

    return F.aggregate(units, start, step, closed)


def with_capacity(docs: DataFrame, title: str, limit: str | Column) -> DataFrame:
    """Columns `head` (the title, cut to a quarter of the limit if it alone reaches it) and `capacity` (words left for the body)."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    docs = docs.withColumn("_title", normalize_text(F.col(title)))
    cut = F.array_join(F.slice(tokens(F.col("_title")), 1, F.greatest(F.lit(1), F.floor(limit / 4).cast("int"))), " ")
    docs = docs.withColumn("head", F.when(word_count(F.col("_title")) >= limit, cut).otherwise(F.col("_title"))).drop("_title")
    return docs.withColumn("capacity", F.greatest(F.lit(1), limit.cast("int") - word_count(F.col("head")).cast("int")))


def at_limits(docs: DataFrame, limits: list[int]) -> DataFrame:
    return docs.withColumn("word_limit", F.explode(F.array(*[F.lit(n) for n in limits])))


def retrieval_units(docs: DataFrame, limits: list[int], text: str = "text", title: str | None = None) -> DataFrame:
    """The columns of docs but text and title, and word_limit, chunk_index (from 1), unit."""
    body = docs.withColumn("_title", F.col(title) if title else F.lit(""))
    body = body.withColumn("_units", F.transform(sentences(layout_text(F.col(text))), lambda s: F.struct(s.alias("text"), word_count(s).alias("words"))))
    body = with_capacity(at_limits(body.drop(*[c for c in (text, title) if c]), limits), "_title", "word_limit")
    cut = body.select("*", F.posexplode(packed_texts(F.col("_units"), F.col("capacity"))).alias("_place", "_chunk"))
    unit = normalize_text(F.when(F.col("head") != "", F.concat_ws("\n", "head", "_chunk")).otherwise(F.col("_chunk")))
    return cut.withColumn("chunk_index", F.col("_place") + 1).withColumn("unit", unit).drop("_title", "_units", "head", "capacity", "_place", "_chunk")


def unit_sizes(docs: DataFrame, limits: list[int], text: str = "text", title: str | None = None) -> DataFrame:
    """The columns of docs but text and title, and word_limit, sizes: the words of each unit, without building the units."""
    body = docs.withColumn("_title", F.col(title) if title else F.lit(""))
    body = body.withColumn("_counts", F.transform(sentences(layout_text(F.col(text))), word_count))
    body = with_capacity(at_limits(body.drop(*[c for c in (text, title) if c]), limits), "_title", "word_limit")
    head = word_count(F.col("head"))
    return body.withColumn("sizes", F.transform(packed_counts(F.col("_counts"), F.col("capacity")), lambda n: n + head)).drop("_title", "_counts", "head", "capacity")
