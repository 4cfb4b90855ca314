"""Fail-closed assembly of reviewed decisions: violations as rows, guarded corrections, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes that decisions may use.
LABELS = ("INCLUDE", "EXCLUDE", "UNCERTAIN")
GATES = ("YES", "NO", "UNCLEAR")
EXCLUSION_CODES = tuple(f"TA{i}" for i in range(1, 8))
UNCERTAIN_CODE = "TA8"


class IntegrityError(ValueError):
    """An input breaks a rule that results depend on."""


def require(violations: DataFrame, message: str) -> None:
    """Raises if there is any violation, naming the first few."""
    if rows := violations.take(5):
        raise IntegrityError(f"{message}: {[r.asDict() for r in rows]}")


def blank(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col).cast("string")), F.lit("")) == ""


def key_violations(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or stand more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where(blank(key) | (F.col("times") > 1))


def set_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one side has, with the side."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def column_mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys missing on a side, and columns whose values differ, of a 1:1 join."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    tests = [F.when(F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull(), F.lit(key)), *[F.when(F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]]
    found = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array(*tests)).alias("column"))
    return found.where("column is not null")


def order_violations(rows: DataFrame, order: str, expected: int) -> DataFrame:
    """One row if the order column isn't 1 to expected, each once."""
    sums = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.countDistinct(order).alias("distinct"), F.count(F.lit(1)).alias("rows"))
    return sums.where((F.col("low") != 1) | (F.col("high") != expected) | (F.col("distinct") != expected) | (F.col("rows") != expected))


def batch_violations(rows: DataFrame, size: int, batch: str = "batch", order: str = "order", first: int = 1, last: int | None = None) -> DataFrame:
    """batch, rule: batches outside first to last, of another size than `size` (the last one may be smaller), or whose orders aren't the ones that follow those of the batches before."""
    sums = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("low"), F.max(order).alias("high"), F.countDistinct(order).alias("distinct"))
    end = F.lit(last) if last is not None else sums.agg(F.max(batch)).first()[0]  # one row
    begin = (F.col(batch) - first) * size + 1
    rules = {
        "range": F.col(batch).isNull() | (F.col(batch) < first) | (F.col(batch) > end),
        "size": F.when(F.col(batch) == end, (F.col("rows") < 1) | (F.col("rows") > size)).otherwise(F.col("rows") != size),
        "order": (F.col("low") != begin) | (F.col("high") != begin + F.col("rows") - 1) | (F.col("distinct") != F.col("rows")),
    }
    found = sums.select(batch, F.explode(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()])).alias("rule"))
    return found.where("rule is not null")


def preflight(found: DataFrame, checkpoint: DataFrame, gates: dict[str, tuple[DataFrame, str]], file: str = "file", digest: str = "sha256") -> None:
    """What must hold before anything is loaded: every file of the checkpoint is there with its hash and no other, and each gate's condition holds for all rows of its summary, which has some."""
    require(column_mismatches(found.select(file, digest), checkpoint.select(file, digest), file, [digest]), "files differ from the checkpoint")
    for name, (summary, condition) in gates.items():
        if summary.isEmpty():
            raise IntegrityError(f"{name}: the summary is missing")
        require(summary.where(~F.coalesce(F.expr(condition), F.lit(False))), f"{name} isn't closed")


def with_diagnostics(rows: DataFrame, legacy: DataFrame, key: str, columns: list[str], batches: tuple[int, ...] = (1,), batch: str = "batch") -> DataFrame:
    """rows with the columns that older batches keep in a table of their own; rows of other batches keep theirs, and no row is lost or doubled."""
    require(key_violations(legacy, key), "older diagnostics")
    old = legacy.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = rows.join(old, (F.col(key) == F.col("_k")) & F.col(batch).isin(*batches), "left")
    own = {c: F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in rows.columns else F.col(f"_{c}") for c in columns}
    return both.withColumns(own).drop("_k", *[f"_{c}" for c in columns])


def decision_violations(rows: DataFrame, key: str = "canonical_id") -> DataFrame:
    """key, rule: every rule that a decision breaks."""
    label, code = F.col("screening_label"), F.coalesce(F.col("screening_reason_code"), F.lit(""))
    known, gate = label.isin(*LABELS), list(GATES)
    rules = {
        "unknown_label": F.coalesce(~known, F.lit(True)),
        "unknown_gate": F.coalesce(~(F.col("q1_retrieval").isin(gate) & F.col("q2_morphology").isin(gate) & F.col("q3_retrieval_component").isin([*gate, "NOT_APPLICABLE"])), F.lit(True)),
        "include_without_gates": (label == "INCLUDE") & F.coalesce((F.col("q1_retrieval") != "YES") | (F.col("q2_morphology") != "YES"), F.lit(True)),
        "include_with_reason": (label == "INCLUDE") & (code != ""),
        "uncertain_without_code": (label == "UNCERTAIN") & (code != UNCERTAIN_CODE),
        "exclude_without_code": (label == "EXCLUDE") & ~code.isin(*EXCLUSION_CODES),
        "no_rationale": blank("screening_reason_text"),
        "no_reviewer": blank("reviewer"),
        "bad_date": ~F.coalesce(F.col("review_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
    }
    found = rows.select(key, F.explode(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()])).alias("rule"))
    return found.where("rule is not null")


def normalize_decisions(variants: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Decision tables of different schemas as one: each comes with {wanted column: its own column}."""
    made = [df.select("*", *[F.col(own).alias(wanted) for wanted, own in names.items() if own != wanted]).drop(*[own for wanted, own in names.items() if own != wanted]) for df, names in variants]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def overlay_violations(rows: DataFrame, ledger: DataFrame, key: str = "canonical_id") -> DataFrame:
    """key, rule: corrections that stand twice, hit no row, or whose old values or batch don't match. Applying twice breaks the last."""
    twice = ledger.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("rule"))
    own = rows.select(F.col(key).alias("_k"), F.col("screening_label").alias("_label"), F.coalesce("screening_reason_code", F.lit("")).alias("_code"), F.col("batch").alias("_batch"))
    both = ledger.join(own, F.col(key) == F.col("_k"), "left")
    rules = [
        F.when(F.col("_k").isNull(), F.lit("unknown")),
        F.when((F.col("_label") != F.col("old_label")) | (F.col("_code") != F.coalesce("old_reason_code", F.lit(""))), F.lit("old_value")),
        F.when(F.col("_batch") != F.col("batch"), F.lit("batch")),
    ]
    found = both.select(key, F.explode(F.array(*rules)).alias("rule")).where("rule is not null")
    return twice.unionAll(found)


def apply_overlay(rows: DataFrame, ledger: DataFrame, key: str = "canonical_id", check: bool = True) -> DataFrame:
    """rows with corrected labels and codes where the ledger has them, and the provenance of each decision."""
    if check:
        require(overlay_violations(rows, ledger, key), "corrections don't fit")
    fix = ledger.select(F.col(key).alias("_k"), F.col("new_label").alias("_label"), F.col("new_reason_code").alias("_code"))
    both = rows.join(fix, F.col(key) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    return both.withColumns({"screening_label": F.when(hit, F.col("_label")).otherwise(F.col("screening_label")), "screening_reason_code": F.when(hit, F.col("_code")).otherwise(F.col("screening_reason_code")), "provenance": F.when(hit, "overlay").otherwise("finalized")}).drop("_k", "_label", "_code")


def decision_counts(rows: DataFrame) -> DataFrame:
    """batch, label, rows: each batch and label, with totals (null) over both."""
    return rows.rollup("screening_label", "batch").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("screening_label", "label")


def gate_value(text: Column, question: int) -> Column:
    """The value of Qn=VALUE in a text; null if it stands not once."""
    found = F.regexp_extract_all(text, F.lit(f"Q{question}=(YES|NO|UNCLEAR|NOT_APPLICABLE)"), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def canonical_json(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})


def first_by_priority(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """A cascade of duplicate rules: of rows that agree on a key (nulls don't), the first by order stays; the next key sees what is left."""
    for n, key in enumerate(keys):
        marked = rows.withColumn("_key", key)
        first = marked.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
        rows = marked.join(first, "_key", "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(order))).drop("_key", "_first")
        del n
    return rows
