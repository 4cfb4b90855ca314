"""Paired tests, intervals, corrections for many tests, agreement, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def dealt_rounds(spark: SparkSession, rounds: int) -> DataFrame:
    """round, over all cores: the few values that a round draws from may lie in one partition."""
    return spark.range(0, rounds, 1, 4 * spark.sparkContext.defaultParallelism).toDF("round")


def permutation_test(diffs: DataFrame, rounds: int, seed: int, key: str = "qid", value: str = "diff") -> DataFrame:
    """n, mean, p: two-sided paired test with hash-drawn signs, so any partitioning gives the same result."""
    known = diffs.where(F.col(value).isNotNull()).select(key, value)
    signs = dealt_rounds(diffs.sparkSession, rounds).crossJoin(F.broadcast(known))  # a row for each query
    sign = F.when(_hex_number(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string")), 1) < 8, 1.0).otherwise(-1.0)
    sums = signs.groupBy("round").agg(F.round(F.sum(sign * F.col(value)), 9).alias("s"))
    real = known.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.round(F.abs(F.sum(value)), 9).alias("real"))
    return sums.crossJoin(F.broadcast(real)).groupBy("n", "mean", "real").agg(F.count_if(F.abs("s") >= F.col("real")).alias("extreme")).select("n", "mean", ((F.col("extreme") + 1) / (rounds + 1)).alias("p"))


def bootstrap_interval(diffs: DataFrame, rounds: int, seed: int, key: str = "qid", value: str = "diff", level: float = 0.95) -> DataFrame:
    """n, mean, low, high: the percentile interval of the mean over hash-drawn resamples. Values are numbered by key."""
    known = diffs.where(F.col(value).isNotNull()).select(F.row_number().over(Window.orderBy(key)).alias("nth"), F.col(value).alias("v"))  # a row for each query
    n = known.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    draws = dealt_rounds(diffs.sparkSession, rounds).crossJoin(F.broadcast(known.select("nth"))).crossJoin(F.broadcast(n))
    pick = _hex_number(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("nth").cast("string")), 8) % F.col("n") + 1
    means = draws.withColumn("pick", pick).select("round", "pick", "n", "mean").join(F.broadcast(known.select(F.col("nth").alias("pick"), F.col("v").alias("drawn"))), "pick").groupBy("round", "n", "mean").agg(F.avg("drawn").alias("m"))
    tail = (1 - level) / 2
    return means.groupBy("n", "mean").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def holm_and_bh(tests: DataFrame, family: str = "family", p: str = "p", name: str = "test") -> DataFrame:
    """tests with holm (within each family) and bh (over all): adjusted p values, at most 1."""
    up = Window.partitionBy(family).orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    stepped = tests.withColumn("_h", F.col(p) * (m - F.row_number().over(up) + 1))
    holm = F.least(F.lit(1.0), F.max("_h").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    stepped = stepped.withColumn("holm", holm)
    every = Window.partitionBy(F.lit(1)).orderBy(p, name)  # a row for each test
    stepped = stepped.withColumn("_b", F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) / F.row_number().over(every))
    return stepped.withColumn("bh", F.least(F.lit(1.0), F.min("_b").over(every.rowsBetween(0, Window.unboundedFollowing)))).drop("_h", "_b")


def weighted_kappa(pairs: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """n, agreement, kappa (quadratic weights), alpha (Krippendorff's for nominal data and two raters)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("c").alias("ra")), cells.groupBy("b").agg(F.sum("c").alias("cb"))

    def weight(x: str, y: str) -> Column:
        return F.pow((F.col(x) - F.col(y)) / float(max(1, levels - 1)), F.lit(2.0))

    seen = cells.agg(F.sum(weight("a", "b") * F.col("c")).alias("seen"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    chance = rows.crossJoin(cols).agg(F.sum(weight("a", "b") * F.col("ra") * F.col("cb")).alias("chance"))  # levels squared
    use = cells.select(F.col("a").alias("v"), "c").unionAll(cells.select("b", "c")).groupBy("v").agg(F.sum("c").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("within"))
    one = n.crossJoin(seen).crossJoin(chance).crossJoin(use)
    kappa = F.when(F.col("chance") > 0, 1 - F.col("seen") * F.col("n") / F.col("chance"))
    total = 2.0 * F.col("n")
    expected = 1 - F.col("within") / (total * (total - 1))
    alpha = F.when(expected > 0, 1 - (1 - F.col("same") / F.col("n")) / expected)
    return one.select("n", F.round(F.col("same") / F.col("n"), 6).alias("agreement"), F.round(kappa, 6).alias("kappa"), F.round(alpha, 6).alias("alpha"))


def average_rank(value: str, by: Column | None = None) -> Column:
    """Ranks from 1; equal values share their mean rank."""
    part = Window.partitionBy(by if by is not None else F.lit(1))
    return F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*([by] if by is not None else [F.lit(1)]), value)) - 1) / 2.0


def frequency_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, rank: mean ranks from the distinct values' counts, so only distinct values are ordered."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(value, (before + (F.col("c") + 1) / 2.0).alias(f"{value}_rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho over the rows that have both values."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    both = known.join(frequency_ranks(known, x), x).join(frequency_ranks(known, y), y)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(f"{x}_rank", f"{y}_rank"), 6).alias("rho"))


def standardised_regression(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients of standardised predictors, from the correlation matrix that one aggregation gives."""
    import numpy as np

    names = [*xs, y]
    known = df.dropna(subset=names)
    row = known.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]).first()
    r = np.eye(len(names))
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            r[i, j] = r[j, i] = row[f"{i}_{j}"]
    k = len(xs)
    return dict(zip(xs, np.linalg.lstsq(r[:k, :k], r[:k, k], rcond=None)[0].tolist(), strict=True))


def equivalence_test(diffs: DataFrame, margin: float, value: str = "diff", level: float = 0.9) -> DataFrame:
    """n, mean, low, high, equivalent: two one-sided tests by the normal interval of the mean."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf((1 + level) / 2)
    one = diffs.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    low, high = F.col("mean") - z * F.col("se"), F.col("mean") + z * F.col("se")
    return one.select("n", "mean", low.alias("low"), high.alias("high"), ((low > -margin) & (high < margin)).alias("equivalent"))


def stratified_split(rows: DataFrame, strata: list[str], key: str, dev: int, total: int, seed: int) -> DataFrame:
    """rows with part: dev for dev of every total rows of a stratum in hash order, else test."""
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key))
    return rows.withColumn("part", F.when((nth - 1) % total < dev, "dev").otherwise("test"))
