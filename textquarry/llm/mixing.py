"""Mixing sources to target weights.

Every row gets a hash-random key; within each source rows are ordered by that key, a two-level prefix sum (key bucket,
then row) gives the words before each row, and each source is cut where its budget ends. Whole epochs come first, the
last one is partial. Everything is built-in DataFrame work on (id, source, size); texts are read once, for their size.

Rows without an id are keyed by their text, null texts have size 0, null sources form the last source. Rows that share an id follow each
other and are taken one by one; equal rows are interchangeable. An empty table gives an empty result. Columns of the input beside
the ones named are not looked at; mix() passes them through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACED_WORD, settle, table, whole_text

#: Hex digits of the key that name its bucket: 4,096 buckets a source, whatever the input's size.
BUCKET_DIGITS = 3


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words, key (32 hex digits) and its bucket; more: further columns to keep."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(whole_text().cast("binary")))).cast("binary"))
    return docs.select(*more, "doc_id", "source", F.regexp_count(whole_text(), F.lit(SPACED_WORD)).cast("long").alias("size"), key.alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def source_targets(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: the level t with sum(min(t * weight, most * size)) = share * all sizes.

    Sources are taken in ascending order of most * size / weight; those before the first that stays below its ceiling
    are at their ceiling. The windows without a key run over one row for each source.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * float(most)).withColumn("reach", F.col("ceiling") / F.col("weight"))
    order = Window.orderBy("reach", "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    free = F.when(F.col("reach") > F.col("level"), F.col("level"))
    # Later sources are free too and share one level, so any free one's will do; the first is the exact figure.
    return ranked.withColumn("final", F.first(free, ignorenulls=True).over(everything)).select("source", "source_size", F.when(F.col("reach") > F.col("level"), F.col("weight") * F.col("final")).otherwise(F.col("ceiling")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, more: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken: how often the mix takes each row (0 to most); more: further columns to keep."""
    rows = settle(sized(docs, *more), "mix-sizes").withColumn("has", F.col("source").isNotNull()).withColumn("named", F.coalesce("source", F.lit("")))
    group = ["has", "named"]
    targets = source_targets(rows, weights, share, most).select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target")
    buckets = rows.groupBy(*group, "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).join(targets, group).drop("in_bucket")
    within = Window.partitionBy(*group, "bucket").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(buckets, [*group, "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("ahead") + F.col("upto") - F.col("size") / 2.0
    rows = rows.withColumn("copies", (F.col("epochs") + F.when((rest > 0) & (middle <= rest), 1).otherwise(0)).cast("long"))
    return rows.select(*more, "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix_plan takes it."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = settle(docs.select(every.alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows", "zstd")
    plan = mix_plan(rows.select("row", *[F.col("doc").getField(c).alias(c) for c in ("doc_id", "source", "text")]), more=["row"], **options)
    taken = rows.join(plan.where("copies > 0").select("row", "copies"), "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM by_source),
weighted AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS ceiling FROM ranked),
reached AS (SELECT *, ceiling / weight AS reach FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY reach, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY reach, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM reached),
final AS (SELECT arg_min(level, rnk_order) AS final FROM (SELECT level, row_number() OVER (ORDER BY reach, rnk) AS rnk_order FROM levels WHERE reach > level)),
targets AS (SELECT source, source_size, CASE WHEN reach > level THEN weight * (SELECT final FROM final) ELSE ceiling END AS target FROM levels),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM rows),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs, s.upto - s.size / 2.0::DOUBLE AS middle
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
