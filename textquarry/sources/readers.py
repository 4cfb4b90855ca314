"""Readers of JSON lines, CSV, Parquet, plain text, MediaWiki XML, sample caches and review batches, as DataFrames."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import layout_text, strip
from textquarry.functions.unicode import strip_markup
from textquarry.operators.assemble import IntegrityError

#: Bytes of a CSV file that its delimiter is guessed from, and the delimiters that it may have.
SNIFFED, DELIMITERS = 8192, ",;\t|"
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".txt": "txt", ".json": "json"}
#: What blank cells are read as, and then as null: no text of a quoted cell, as Spark takes an empty one for null if this is empty.
BLANK = "\ufdd0blank\ufdd1"
#: Keys of a JSON object whose list holds the records.
WRAPPERS = ("data", "records", "items")
BATCH_FILE = r"(?i)batch_(\d+)\.jsonl$"
ID_PREFIX = "UZWP-"

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType()), T.StructField("_VALUE", T.StringType())])),
        T.StructField("revision", T.ArrayType(T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_bytes", T.StringType())]))]))),
    ]
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Objects, one a line; blank lines don't count, a malformed line fails the read. bz2 and gzip are decompressed."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def sniff(head: str) -> str:
    """The delimiter of a CSV text, a comma where it can't be told."""
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter
    except csv.Error:
        return ","


def _head(spark: SparkSession, path: str) -> str:
    """The first SNIFFED characters of the first file, without reading the rest."""
    file = next(f for f in list_files(spark, path) if not f.rpartition("/")[2].startswith(("_", ".")))
    if file.lower().endswith((".gz", ".bz2")):
        data = "\n".join(r[0] for r in spark.read.text(file).limit(SNIFFED).collect())
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
        try:
            data = bytes(stream.readNBytes(4 * SNIFFED)).decode("utf-8", "ignore")
        finally:
            stream.close()
    return data.removeprefix("﻿")[:SNIFFED]


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """Strings under a header, blank ones as null and quoted empty ones as empty; the delimiter is guessed unless given."""
    sep = delimiter or sniff(_head(spark, path if isinstance(path, str) else path[0]))
    df = spark.read.options(header=True, sep=sep, multiLine=True, quote='"', escape='"', nullValue=BLANK, emptyValue="", inferSchema=False).csv(path)
    return df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns if c.startswith("﻿")})


def read_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    """As read_csv with commas; a header that repeats a name, or a row of another length, is an error."""
    header = next(csv.reader(io.StringIO(_head(spark, path), newline="")), [])
    if len(set(header)) != len(header):
        raise IntegrityError(f"{path}: a column stands twice in {header}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField("_bad", T.StringType())])
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True).csv(path)
    if bad := df.where("_bad is not null").take(1):
        raise IntegrityError(f"{path}: a row doesn't fit the header: {bad[0]['_bad']!r}")
    return df.drop("_bad")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Of a .txt file or all below a folder: id (path below the folder, or the file's name), title (first non-empty line), text (the rest), category (parent folder). A file of one line has no title; empty files are dropped."""
    root = path.rstrip("/").rpartition("/")[0] if path.endswith(".txt") else path.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path.rstrip("/"), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    below = F.regexp_replace(F.url_decode("file"), f"^.*?{re.escape(root.split('://')[-1].removeprefix('file:'))}/", "")
    lines = F.transform(F.split(layout_text(F.regexp_replace("value", "^\\ufeff", "")), "\\n"), strip)
    rows = files.select(below.alias("id"), lines.alias("lines"))
    body = layout_text(F.array_join(F.slice("lines", 2, F.greatest(F.lit(1), F.size("lines"))), "\n"))
    alone = body == ""
    parent = F.regexp_extract("id", "([^/]+)/[^/]+$", 1)
    first = F.col("lines")[0]
    return rows.where(first != "").select("id", F.when(alone, "").otherwise(first).alias("title"), F.when(alone, first).otherwise(body).alias("text"), parent.alias("category"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, or of the list under data, records or items of an object."""
    df = spark.read.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.inline(key))
    return df


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files below a path by Hadoop's file systems, sorted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder by suffix; in a folder Parquet comes before text files, these before the other kinds."""
    files = [f for f in list_files(spark, path) if not f.rpartition("/")[2].startswith(("_", "."))]
    kinds = {}
    for f in files:
        base = re.sub(r"\.(bz2|gz)$", "", f.lower())
        kind = SUFFIXES.get("." + base.rpartition(".")[2])
        if kind:
            kinds.setdefault(kind, []).append(f)
    if "parquet" in kinds:
        return read_parquet(spark, path)
    if "txt" in kinds:
        return read_txt(spark, path)
    # One read for all files of a kind that look alike: the plan doesn't grow with their number.
    parts = [read_jsonl(spark, kinds["jsonl"])] if "jsonl" in kinds else []
    alike: dict[tuple[str, str], list[str]] = {}
    for f in kinds.get("csv", []):
        head = _head(spark, f)
        alike.setdefault((sniff(head), head.split("\n")[0]), []).append(f)
    parts += [read_csv(spark, own, delimiter) for (delimiter, _), own in alike.items()]
    parts += [read_json_document(spark, f) for f in kinds.get("json", [])]
    if not parts:
        raise ValueError(f"{path}: no readable file")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every page of a MediaWiki dump: page_id (the title where missing), title, namespace, is_redirect, redirect_title, has_revision, has_text_node, raw. Text keeps its white space."""
    df = spark.read.format("xml").options(rowTag="page", ignoreSurroundingSpaces="false", mode="PERMISSIVE", ignoreNamespace="true").schema(PAGE).load(path)
    body = F.col("revision")[0]["text"]
    title = F.coalesce("title", F.lit(""))
    return df.select(
        F.coalesce(F.when(F.trim("id") != "", F.trim("id")), title).alias("page_id"),
        title.alias("title"),
        F.trim(F.coalesce("ns", F.lit(""))).alias("namespace"),
        F.col("redirect").isNotNull().alias("is_redirect"),
        F.coalesce("redirect._title", F.lit("")).alias("redirect_title"),
        F.col("revision").isNotNull().alias("has_revision"),
        body.isNotNull().alias("has_text_node"),
        F.coalesce(body["_VALUE"], F.lit("")).alias("raw"),
    )


def main_pages(pages: DataFrame, blank_is_main: bool = False) -> DataFrame:
    """Articles: main namespace (blank too, if asked), no redirects, with text. Filters come before any markup is parsed."""
    main = F.col("namespace") == "0"
    return pages.where((main | (F.col("namespace") == "") if blank_is_main else main) & ~F.col("is_redirect") & (strip(F.col("raw")) != ""))


def read_wikipedia(spark: SparkSession, path: str, source: str = "wikipedia") -> DataFrame:
    """Articles of a dump as documents, markup stripped; those left empty are dropped."""
    pages = main_pages(read_pages(spark, path), blank_is_main=True)
    text = layout_text(strip_markup(F.col("raw"))["text"])
    docs = pages.select(F.lit(source).alias("source"), F.col("page_id").alias("doc_id"), "title", text.alias("text"), F.lit("").alias("category"), F.lit(path).alias("provenance"))
    return docs.where("text != ''")


def read_sample_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a cache, and for each source the rows sampled and seen; a total that isn't known is the number sampled."""
    docs = spark.read.json(f"{path}/documents")
    totals = spark.read.schema("source string, total_seen long").json(f"{path}/meta")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("sampled")).join(totals, "source", "left")
    return docs, counts.withColumn("total_seen", F.coalesce("total_seen", "sampled"))


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of batch_N.jsonl with batch, line (from 1) and page_id, taken from candidate_id where it is missing."""
    files = spark.read.option("pathGlobFilter", "batch_*.jsonl").text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = files.where("trim(value) != ''").withColumn("batch", F.regexp_extract("file", BATCH_FILE, 1).cast("int")).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("batch").orderBy("block", "_at")))
    schema = schema or T.StructType([T.StructField(c, T.StringType()) for c in ("page_id", "candidate_id", "title", "raw_signature", "extracted_signature", "joint_signature")])
    rows = rows.withColumn("r", F.from_json("value", schema)).select("batch", "line", "r.*")
    if "candidate_id" in rows.columns:
        rows = rows.withColumn("page_id", F.coalesce(F.when(F.col("page_id") != "", F.col("page_id")), F.regexp_replace("candidate_id", f"^{ID_PREFIX}", "")))
    if rows.where("page_id is null or page_id = ''").take(1):
        raise IntegrityError(f"{path}: a row has no page id")
    return rows


def candidate_id(page_id: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), page_id)


def demo_documents(spark: SparkSession) -> DataFrame:
    """Six small documents of three sources."""
    rows = [
        ("wikipedia", "w1", "Tashkent", "Tashkent is a city. It has many parks.\n\nIts metro opened in 1977.", "city", "demo"),
        ("wikipedia", "w2", "Short", "One line only.", "", "demo"),
        ("news", "n1", "Rain", "Rain fell all day. Roads were closed! Trains ran late…", "weather", "demo"),
        ("news", "n2", "Market", "Prices rose by 3 percent. Traders were calm.", "economy", "demo"),
        ("legal", "l1", "Article 1", " ".join(f"Clause {i} applies to all parties." for i in range(1, 60)), "law", "demo"),
        ("legal", "l2", "Article 2", "This law is in force from its publication.", "law", "demo"),
    ]
    return spark.createDataFrame(rows, "source string, doc_id string, title string, text string, category string, provenance string")
