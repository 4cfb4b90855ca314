"""Graded-relevance metrics, pools, and set measures of two runs. qrels have qid, doc_id, grade (0, 1, 2); unjudged isn't 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grade: null where a document is unjudged. The run's own judgements are taken first, so that a small run is sent to the judgements and not these to it."""
    own = qrels.select("qid", "doc_id", "grade").join(run.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    return run.join(own, ["qid", "doc_id"], "left")


def grades(qrels: DataFrame) -> DataFrame:
    """qid, grade_0, grade_1, grade_2: how many judgements of each grade a query has."""
    return qrels.groupBy("qid").agg(*[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in (0, 1, 2)])


def ideal_gain(k: int) -> Column:
    """The gain of the best k of a row of grades."""
    twos, some = F.col("grade_2"), F.col("grade_2") + F.col("grade_1")
    return sum((F.when(twos >= n, 3.0).when(some >= n, 1.0).otherwise(0.0) / F.log2(F.lit(n + 1.0)) for n in range(2, k + 1)), F.when(twos >= 1, 3.0).when(some >= 1, 1.0).otherwise(0.0))


def ideal_gains(qrels: DataFrame, k: int) -> DataFrame:
    return grades(qrels).select("qid", ideal_gain(k).alias(f"idcg_{k}"))


def metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run, qid, ndcg_10, ndcg_5, recall_50, ap_100, rr_10, bpref, judged_10; null for queries without relevant documents."""
    return graded_metrics(judged(run, qrels), grades(qrels))


def graded_metrics(run: DataFrame, counts: DataFrame) -> DataFrame:
    """metrics of a run with grades, and the counts of all judgements as `grades` gives them."""
    per = counts.select("qid", (F.col("grade_1") + F.col("grade_2")).alias("relevant"), F.col("grade_0").alias("nonrelevant"), ideal_gain(10).alias("idcg_10"), ideal_gain(5).alias("idcg_5"))
    w = Window.partitionBy("run", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    relevant, bad = F.coalesce(F.col("grade") >= 1, F.lit(False)), F.coalesce(F.col("grade") == 0, F.lit(False))
    seen = run.withColumns({"hits": F.sum(relevant.cast("int")).over(w), "misses": F.sum(bad.cast("int")).over(w)}).join(per, "qid")
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)

    def within(k: int, value: Column) -> Column:
        return F.when(F.col("rank") <= k, value).otherwise(0.0)

    few = F.least("relevant", "nonrelevant")
    penalty = F.when(few > 0, 1 - F.least("misses", few) / few).otherwise(1.0)
    sums = seen.groupBy("run", "qid").agg(
        *[F.first(c).alias(c) for c in ("relevant", "idcg_10", "idcg_5")],
        F.sum(within(10, gain)).alias("dcg_10"),
        F.sum(within(5, gain)).alias("dcg_5"),
        F.sum(within(50, relevant.cast("double"))).alias("found_50"),
        F.sum(within(100, F.when(relevant, F.col("hits") / F.col("rank")).otherwise(0.0))).alias("precisions"),
        F.coalesce(F.max(F.when(relevant & (F.col("rank") <= 10), 1 / F.col("rank"))), F.lit(0.0)).alias("rr_10"),
        F.sum(F.when(relevant, penalty).otherwise(0.0)).alias("prefers"),
        F.count_if(F.col("grade").isNotNull() & (F.col("rank") <= 10)).alias("judged"),
        F.count_if(F.col("rank") <= 10).alias("first_10"),
    )
    some = F.col("relevant") > 0

    def value(x: Column) -> Column:
        return F.when(some, F.round(x, 6))

    return sums.select(
        "run", "qid", value(F.col("dcg_10") / F.col("idcg_10")).alias("ndcg_10"), value(F.col("dcg_5") / F.col("idcg_5")).alias("ndcg_5"), value(F.col("found_50") / F.col("relevant")).alias("recall_50"),
        value(F.col("precisions") / F.col("relevant")).alias("ap_100"), value(F.col("rr_10")).alias("rr_10"), value(F.col("prefers") / F.col("relevant")).alias("bpref"), F.round(F.col("judged") / F.greatest(F.lit(1), F.col("first_10")), 6).alias("judged_10"),
    )


def macro_average(per_query: DataFrame, names: list[str]) -> DataFrame:
    """run and the mean of each metric over the queries that have it."""
    return per_query.groupBy("run").agg(F.count(names[0]).alias("queries"), *[F.avg(n).alias(n) for n in names])


def pool(runs: DataFrame, depth: int) -> DataFrame:
    return runs.where(F.col("rank") <= depth).select("qid", "doc_id").distinct()


def coverage(runs: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """run, judged, shown, coverage at a depth."""
    return graded_coverage(judged(runs.where(F.col("rank") <= depth), qrels), depth)


def graded_coverage(runs: DataFrame, depth: int) -> DataFrame:
    """coverage of runs with grades."""
    return runs.where(F.col("rank") <= depth).groupBy("run").agg(F.count("grade").alias("judged"), F.count(F.lit(1)).alias("shown")).withColumn("coverage", F.round(F.col("judged") / F.col("shown"), 6))


def complementarity(a: DataFrame, b: DataFrame, qrels: DataFrame, depth: int = 50) -> DataFrame:
    """qid and counts of relevant documents that only a, only b or both find within depth, Jaccard, set change, union recall, headroom."""
    first, pairs = F.col("rank") <= depth, qrels.select("qid", "doc_id", "grade")
    return graded_complementarity(judged(a.where(first), pairs), judged(b.where(first), pairs), grades(pairs), depth)


def graded_complementarity(a: DataFrame, b: DataFrame, counts: DataFrame, depth: int = 50) -> DataFrame:
    """complementarity of runs with grades; counts of all judgements as `grades` gives them."""

    def hits(run: DataFrame, name: str) -> DataFrame:
        return run.where((F.col("rank") <= depth) & (F.col("grade") >= 1)).groupBy("qid").agg(F.collect_set("doc_id").alias(name))  # at most depth ids

    relevant = counts.select("qid", (F.col("grade_1") + F.col("grade_2")).alias("relevant")).where("relevant > 0")
    per = relevant.join(hits(a, "a"), "qid", "left").join(hits(b, "b"), "qid", "left")
    none = F.array().cast("array<bigint>")
    per = per.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    best = F.greatest(F.size("a"), F.size("b"))
    counts = {"only_a": F.size(F.array_except("a", "b")), "only_b": F.size(F.array_except("b", "a")), "overlap": both, "found": either}
    ratios = {"jaccard": F.when(either > 0, both / either), "set_change": (either - both) / F.greatest(F.lit(1), either), "union_recall": either / F.col("relevant"), "headroom": (either - best) / F.col("relevant")}
    return per.select("qid", "relevant", *[v.cast("long").alias(k) for k, v in counts.items()], *[F.round(v, 6).alias(k) for k, v in ratios.items()])


def gains(per_query: DataFrame, metric: str, system: str, baselines: list[str]) -> DataFrame:
    """qid, gain over each baseline, and over the one with the best mean (the first of equals)."""
    wide = per_query.where(F.col("run").isin(system, *baselines)).groupBy("qid").pivot("run", [system, *baselines]).agg(F.first(metric))
    means = wide.agg(*[F.avg(b).alias(b) for b in baselines]).first() if len(baselines) > 1 else {baselines[0]: None}
    best = max(baselines, key=lambda b: (means[b] if means[b] is not None else float("-inf"), -baselines.index(b)))
    return wide.select("qid", *[F.round(F.col(system) - F.col(b), 6).alias(f"gain_{b}") for b in baselines], F.round(F.col(system) - F.col(best), 6).alias("gain_best"), F.lit(best).alias("best"))


def select_setting(scored: DataFrame, setting: list[str], metric: str, tolerance: float = 0.0) -> DataFrame:
    """The setting with the best mean; among those within tolerance of it the first in order of the setting columns."""
    means = scored.groupBy(*setting).agg(F.avg(metric).alias("mean"))
    top = means.withColumn("_top", F.max("mean").over(Window.partitionBy(F.lit(1))))  # a row for each setting
    return top.where(F.col("mean") >= F.col("_top") - tolerance).orderBy(*setting).limit(1).drop("_top")
