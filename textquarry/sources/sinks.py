"""Writers: CSV, JSON lines, batches, deterministic single files, manifests with hashes, reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Every column as CSV can hold it: arrays joined by |, flags as 0 and 1, structs and maps as JSON."""
    made = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.AtomicType):
            made.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            made.append(F.to_json(f.name).alias(f.name))
        else:
            made.append((F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)).alias(f.name))
    return df.select(*made)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; nulls are blank, empty texts are quoted, and no white space is trimmed."""
    flat(df).write.mode("overwrite").options(header=True, nullValue="", emptyValue='""', quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All parts under the columns of any, in the order in which they are first seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_sample_cache(docs: DataFrame, totals: DataFrame, path: str) -> None:
    """Documents, and (source, total_seen) beside them."""
    write_jsonl(docs, f"{path}/documents")
    write_jsonl(totals, f"{path}/meta")


def write_batches(rows: DataFrame, path: str, batch: str = "batch") -> None:
    """One folder for each batch."""
    rows.repartition(F.col(batch)).sortWithinPartitions(batch).write.mode("overwrite").partitionBy(batch).json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """All columns as strings, uncompressed: equal content, read back and compared."""
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    as_text.write.mode("overwrite").option("compression", "none").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if not (as_text.exceptAll(back).isEmpty() and back.exceptAll(as_text).isEmpty()):
        raise ValueError(f"{path} doesn't hold what was written")


def csv_bytes(df: DataFrame, first: list[str], order: list[str], most: int = 1_000_000) -> bytes:
    """One CSV file's bytes, the same each time: `first` columns, then the others by name; LF, UTF-8. For tables of decisions, checked to have `most` rows or fewer."""
    columns = [*first, *sorted(set(df.columns) - set(first))]
    rows = flat(df.select(*columns)).orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one file")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue().encode()


def namespace_rows(counts: DataFrame) -> list[dict]:
    return [r.asDict() for r in counts.orderBy("place").collect()]


def feature_schema(df: DataFrame) -> dict:
    """A description of the columns."""
    return json.loads(df.schema.json())


def sha256_file(path: str | Path, block: int = 8 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def hashes(spark, path: str) -> DataFrame:
    """file, bytes, sha256 of every file below a path, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(path: str | Path, parameters: dict, outputs: dict[str, str], inputs: dict[str, str]) -> dict:
    """A JSON manifest with the hashes of outputs and inputs; inputs are hashed before and after writing and must not change."""
    before = {k: sha256_file(v) for k, v in inputs.items()}
    manifest = {"parameters": parameters, "outputs": {k: sha256_file(v) for k, v in outputs.items()}, "inputs": before}
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    if before != {k: sha256_file(v) for k, v in inputs.items()}:
        raise ValueError("an input changed while outputs were written")
    return manifest


def shown(value, digits: int = 2) -> str:
    return "NA" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(title: str, sections: dict[str, DataFrame], most: int = 500) -> str:
    """A report of small result tables, at most `most` rows of each."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(shown(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(most).collect()] + [""]
    return "\n".join(out)
