"""Benchmark decontamination by winnowing, with built-in functions only.

Both sides are cut into words. Of each run of `w` consecutive k-grams the one with the least hash is kept, so two texts
that share k + w - 1 words keep the same k-gram at the same place of the shared words. The kept k-grams (about a
third of all) meet the benchmark's; each hit is extended to the full window and compared word by word.

A window is 8 consecutive words of an item; an item of fewer words is one window, for which k and w shrink to fit.
Null texts have no words, as have texts of separators only; items without words are ignored; equal items, rows and
windows count once; empty tables give no hits. Rows are told apart by (doc_id, hash of the text). Only the five columns
named by the contract leave the operator, so columns of any other name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, lower_ascii, settle, table, whole_text

WINDOW, GRAM = 8, 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words of a text that isn't lower-cased yet; for counting.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The low bits of a fingerprint hold its place; a string has fewer words than this.
PLACE_BITS = 30
#: Fingerprints of the benchmark up to this many are broadcast (about 20 MB); more are joined by a shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def shape(length: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = length."""
    k = min(GRAM, length)
    return k, length - k + 1


def winnow(split: Column, length: int) -> Column:
    """The kept k-grams of an array of words: longs with the hash in the high bits, the place in the low ones."""
    k, w = shape(length)
    high = F.lit(-(1 << PLACE_BITS))

    def grams(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - k), lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(k)]).bitwiseAND(high).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:
        if w == 1:
            return g
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)])))

    nothing = F.array().cast("array<bigint>")
    return F.when(F.size(split) >= length, let(split, lambda x: let(grams(x), least))).otherwise(nothing)


def windows(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct window: its words joined by spaces, its length, and the items that have it."""
    items = benchmark.select("item_id", words(whole_text()).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    each = items.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))).alias("window"))
    return each.groupBy("length", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_hit, items: for the documents that hold a window."""
    known = settle(windows(benchmark), "benchmark-windows")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # 8 at most
    if not lengths:
        return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    mask, place = F.lit(-(1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1)

    def labelled(split: Column, n: int) -> Column:
        return F.transform(winnow(split, n), lambda f: F.struct(F.lit(n).alias("length"), f.bitwiseAND(mask).alias("gram"), f.bitwiseAND(place).cast("int").alias("place")))

    def kept(split: Column) -> Column:
        return F.flatten(F.array(*[labelled(split, n) for n in lengths]))

    prints = None
    for n in lengths:
        own = known.where(F.col("length") == n).select("window", "items", F.explode(labelled(F.split("window", " "), n)).alias("f"))
        own = own.select("f.length", "f.gram", F.col("f.place").alias("offset"), "window", "items")
        prints = own if prints is None else prints.unionAll(own)
    prints = settle(prints, "benchmark-prints")
    few = prints.count() <= MOST_BROADCAST
    text = whole_text()
    found = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(let(words(text), kept)).alias("f"))
    found = found.select("doc_id", "text_hash", "f.length", "f.gram", "f.place").join(F.broadcast(prints) if few else prints, ["length", "gram"]).where("place >= offset")
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct((F.col("place") - F.col("offset")).alias("start"), "length", "window", "items")).alias("found"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "found")
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    both = texts.join(found, F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    whole = let(words(F.col("text")), lambda x: F.filter("found", lambda f: F.array_join(F.slice(x, f["start"] + 1, f["length"]), " ") == f["window"]))
    both = both.select("doc_id", "text_hash", whole.alias("whole"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("whole", lambda f: F.sequence(f["start"], f["start"] + f["length"] - 1)))))
    return both.where(F.size("whole") > 0).select("doc_id", "text_hash", covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("whole", lambda f: f["items"])))).alias("items")).dropDuplicates(["doc_id", "text_hash"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """A row for each row of docs: n_words, n_hit, n_items, items_sha256, contaminated (least_items items or more)."""
    text = whole_text()
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    known = hits(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_hit", "items")
    both = base.join(known, F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_items = F.size(items).cast("long")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, shortest: int = WINDOW) -> DataFrame:
    """The rows of docs that hold windows of fewer than least_items items; items of fewer than `shortest` words don't count."""
    long_enough = benchmark.where(F.regexp_count(whole_text(), F.lit(WORD_ANY_CASE)) >= shortest)
    bad = hits(docs, long_enough).where(F.size("items") >= least_items).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).eqNullSafe(F.col("_hash")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(0, len(w) - least(len(w), 8) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
