"""A training-data pipeline over `documents`: quality, near duplicates, benchmark leaks, source mix, token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; every one but the last returns the
columns of its input, whatever their names, and adds none. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontaminate, mixing, neardup, quality, tokens
from textquarry.llm.shared import new_path, settle, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above.

    Each row is scored by its text alone, a null one as the empty text; equal texts stay or go together, ids don't matter. Without
    labels every score is 0.5 and nothing stays.
    """
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.good_ones(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8.

    The row with the smallest id stays, the first of those that share it, one without an id only if no other has any. Null, empty and blank
    texts are in no group, so all of them stay. Texts of fewer words are grouped if their words are the same.
    """
    return neardup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without eight consecutive words of any benchmark item, or all words in a row of a shorter one.

    Null and empty texts stay, items without words are ignored, equal rows stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null sources are a source of their own, and rows without an id are placed by their text. Rows without words count nothing and are taken
    as often as their place says.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and a row for each document read back from them.

    Null and empty texts have the end id alone; rows without an id come first, equal ids by their text.
    """
    folder = new_path(spark, "pipeline-shards")
    return tokens.read_token_shards(tokens.write_token_shards(docs, folder), folder)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The first and the last stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
