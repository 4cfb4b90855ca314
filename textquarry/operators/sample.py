"""Deterministic samples: replays of order-dependent samplers by position, and hash samples that no partitioning changes.

The replays are for parity with samples drawn elsewhere: their generator must be asked once for each row, which the
driver does one after the other. hash_sample is the one for large tables.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.unicode import stable_score


def reservoir_positions(n: int, k: int, seed: int) -> list[int]:
    """The positions that Algorithm R with this seed keeps of n items, in slot order: it depends on n, k and seed alone."""
    draw, slots = random.Random(seed), list(range(min(n, k)))
    for i in range(k, n):
        j = draw.randint(0, i)
        if j < k:
            slots[j] = i
    return slots


def path_positions(n: int, k: int, seed: int) -> list[int]:
    """Which of n sorted paths a plain random sample of k takes, ascending."""
    return list(range(n)) if k >= n else sorted(random.Random(seed).sample(range(n), k))


def at_positions(df: DataFrame, positions: list[int], order: str) -> DataFrame:
    """The rows at the given positions (from 0) of df ordered by a unique column, with their slot. k rows are broadcast."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(p, s) for s, p in enumerate(positions)], "position long, slot int")
    # A range sort and zipWithIndex number the rows without bringing them into one task.
    keys = df.select(order).orderBy(order).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(f"{order} {df.schema[order].dataType.simpleString()}, position long")
    return df.join(F.broadcast(keys.join(F.broadcast(wanted), "position")), order)


def reservoir_sample(df: DataFrame, k: int, seed: int, order: str) -> DataFrame:
    """What Algorithm R would keep of df, read in this order."""
    return at_positions(df, reservoir_positions(df.count(), k, seed), order)


def hash_sample(df: DataFrame, k: int, seed: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of each group that come first by hash."""
    scored = df.withColumn("_score", stable_score(seed, "sample", F.col(key)))
    if not by:
        return scored.orderBy("_score", key).limit(k).drop("_score")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_score", key))
    return scored.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth", "_score")
