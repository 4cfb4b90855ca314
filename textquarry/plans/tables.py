"""Tables that several parts of a plan read: written once in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each core below which rows are dealt anew: a Parquet row group isn't split, so a small table would keep one core busy.
SMALL = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textquarry-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder, for plans that read it more than once."""
    path = f"{shared_dir(df.sparkSession)}/textquarry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a small table over all cores by a key, which later groupings by it can use; a large one as it is."""
    spark = df.sparkSession
    cores, conf, size = spark.sparkContext.defaultParallelism, spark._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
        if size >= SMALL * cores:
            return df
    return df.repartition(cores, key)
