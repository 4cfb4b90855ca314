"""Queries that write a table with a sink and read it back with a source, and counts of tokens."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.tokenizers import TokenCounter, counters
from textquarry.operators import profile, refine, stats
from textquarry.sources import readers, sinks

from .queries import LIMITS, SEED, query, read, rounded
from .tables import shared_dir

VOCABULARY = "piece_bpe_32k.model"


def place(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, lang, md5(text) AS text_md5 FROM documents")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks as CSV and back."""
    path = place(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), path)
    return readers.read_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def strict_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table under a strict header."""
    path = place(spark, "strict")
    sinks.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return readers.read_csv_strict(spark, path)


@query("SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines and back."""
    path = place(spark, "jsonl")
    sinks.write_jsonl(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    return readers.read_jsonl(spark, path).select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS text_md5 FROM benchmark")
def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a folder, found by their files' suffix."""
    path = place(spark, "records")
    sinks.write_csv(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text"), path)
    return readers.read_records(spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def parquet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as strings in Parquet, read back and compared by the sink."""
    path = place(spark, "parquet")
    sinks.write_parquet(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    return readers.read_parquet(spark, path)


@query("SELECT source, lang, count(*) AS available, least(count(*), 5) AS selected FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY ALL")
def fresh_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample without the ids that were judged before; what each stratum had and gave."""
    rows = read(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("sample_id"))
    judged = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    picked = refine.stratified_sample(rows, 5, SEED, ("source", "lang"), excluded=judged).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("selected"))
    return rows.join(judged, "sample_id", "left_anti").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("available")).join(picked, ["source", "lang"])


@query("""WITH d AS (SELECT CAST(quality AS DOUBLE) - toxic AS diff FROM labels), one AS (SELECT count(diff) AS n, avg(diff) AS mean, stddev_samp(diff) / sqrt(count(diff)) AS se FROM d)
SELECT n, round(mean, 6) AS mean, round(mean - 1.6448536269514722::DOUBLE * se, 6) AS low, round(mean + 1.6448536269514722::DOUBLE * se, 6) AS high, mean - 1.6448536269514722::DOUBLE * se > -0.9 AND mean + 1.6448536269514722::DOUBLE * se < 0.9 AS equivalent FROM one""")
def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two one-sided tests of a mean difference."""
    pairs = read(spark, sf_dir, "labels").select((F.col("quality").cast("double") - F.col("toxic")).alias("diff"))
    return rounded(stats.equivalence_test(pairs, 0.9))


@query("""WITH w AS (SELECT n_chars AS y, len(regexp_extract_all(text, '\\S+')) AS a, len(regexp_extract_all(text, '[.]')) AS b FROM documents), r AS (SELECT corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM w)
SELECT 'words' AS predictor, round((ya - yb * ab) / (1 - ab * ab), 6) AS beta FROM r UNION ALL SELECT 'stops', round((yb - ya * ab) / (1 - ab * ab), 6) FROM r""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised coefficients of words and full stops for characters."""
    from textquarry.functions.text import matches, word_count

    s = F.col("text")
    betas = stats.standardised_regression(read(spark, sf_dir, "documents").select(F.col("n_chars").alias("y"), word_count(s).alias("words"), matches(s, "[.]").alias("stops")), "y", ["words", "stops"])
    return rounded(spark.createDataFrame(sorted(betas.items()), "predictor string, beta double"))


def public_counters() -> list[TokenCounter]:
    """Both encoders' limits under one public vocabulary; none where no public vocabularies are installed."""
    if importlib.util.find_spec("public_tokenizers") is None:
        return counters(None, None, skip=True)
    import public_tokenizers

    return counters(public_tokenizers.path(VOCABULARY), public_tokenizers.path(VOCABULARY))


@query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents, as passages and as queries."""
    s = F.col("text")
    each = [c.count(s, document).alias(f"{c.name}_{kind}") for c in public_counters() for document, kind in ((True, "passage"), (False, "query"))]
    return read(spark, sf_dir, "documents").select("doc_id", *each)


@query()
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 with F09-F11: units, their words and tokens, overflow and headroom at each limit."""
    return rounded(profile.token_profile(read(spark, sf_dir, "documents"), LIMITS, public_counters()))


@query()
def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest limit whose units fit by tokens, or the status that tokens weren't counted."""
    return profile.screen_limits(profile.token_profile(read(spark, sf_dir, "documents"), LIMITS, public_counters()))
