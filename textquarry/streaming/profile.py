"""A profile that is kept up to date as files of documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions import text as X
from textquarry.operators import profile


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(docs: DataFrame) -> DataFrame:
    """Documents, words and mixed-script documents of each source; the state is a row for each source."""
    latin, cyrillic = X.latin_letters(F.col("text")), X.cyrillic_letters(F.col("text"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(X.word_count(F.col("text"))).alias("words"), F.count_if((latin > 0) & (cyrillic > 0)).alias("mixed_docs"))


def write_flags(docs: DataFrame, path: str, checkpoint: str):
    """Surface flags of each arriving document, appended to Parquet once; stateless."""
    flags = profile.structural_flags(docs.select("doc_id", "source", X.normalize_text(F.col("text")).alias("unit"))).drop("unit")
    return flags.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events of each type in windows of event time; state for windows older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
