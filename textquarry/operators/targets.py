"""Targeted extraction: find the pages that review batches ask for, and account for every one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_members(batches: DataFrame, key: str = "page_id") -> DataFrame:
    """batches (key, batch, line) as one row a key: first batch and line, global position, all batches in order, times."""
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each batch
    ahead = batches.groupBy(F.col("batch").alias("_batch")).agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("_batch", "batch")
    ahead = ahead.select(F.col("batch").alias("_batch"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_ahead"))
    inside = batches.withColumn("_nth", F.row_number().over(Window.partitionBy("batch").orderBy("line")))
    placed = inside.join(ahead, F.col("batch").eqNullSafe(F.col("_batch"))).withColumn("_place", (F.col("_ahead") + F.col("_nth")).cast("int"))
    merged = placed.groupBy(key).agg(F.min(F.struct("_place", "batch", "line")).alias("f"), F.array_sort(F.collect_set("batch")).alias("batches"), F.count(F.lit(1)).alias("times"))
    return merged.select(key, F.col("f._place").alias("global_position"), F.col("f.batch").alias("batch"), F.col("f.line").alias("line"), "batches", "times")


def found(pages: DataFrame, targets: DataFrame, key: str = "page_id", order: str | None = None) -> DataFrame:
    """The pages asked for; of several with one key the first by `order`."""
    hits = pages.join(targets.select(key).distinct(), key, "left_semi")
    return hits.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order or key))).where("_nth = 1").drop("_nth")


def missing(targets: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    return targets.join(pages.select(key), key, "left_anti")


def index(targets: DataFrame, pages: DataFrame, columns: list[str], key: str = "page_id") -> DataFrame:
    """Every target with a found flag and the page's columns (null where missing)."""
    own = pages.select(key, *columns, F.lit(True).alias("_hit"))
    return targets.join(own, key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def batch_manifest(indexed: DataFrame) -> DataFrame:
    """batch, asked, found, complete."""
    return indexed.groupBy("batch").agg(F.count(F.lit(1)).alias("asked"), F.count_if("found").alias("found")).withColumn("complete", F.col("asked") == F.col("found"))
