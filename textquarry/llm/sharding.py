"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id). A sample drawn in proportion to size gives quantile boundaries, which cut
that order into many fine ranges of near-equal bytes. A range that is overfull because one text alone spans several
quantiles is subdivided by id; elsewhere a boundary stands before the whole group of equal texts. Exact sizes of the
fine ranges, and prefix sums within each, give every row its place in the order.

Law: bytes. Groups of equal texts above LARGE of a shard's share, of which there are fewer than shards / LARGE, are placed whole first, the
largest on the emptiest shard; only a group above a whole share is cut, into shares and a rest. The shards are then filled up with the other
rows to one level, in order, each group whole. Only (id, size, crc, key) is
shuffled. Null texts have no bytes, null ids sort first, equal rows are interchangeable, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, table, whole_text

LAW = "bytes"
#: Sampled rows for each fine range; the driver holds these (for 10 billion rows 160,000) and no others.
SAMPLED = 16
#: Fine ranges: so many a shard at least, and about so many rows each.
RANGES_A_SHARD, RANGE_ROWS = 8, 1_000_000
#: A group of equal texts above this part of a shard's share is placed by itself.
LARGE = 0.02


def sized(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("at"))


def splitters(rows: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (key, id), ascending: the weighted quantiles of a sample whose draws are proportional to size."""
    share = F.col("size") * (SAMPLED * ranges / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit("draw"), "at", "key"), F.lit(1 << 53)) / float(1 << 53)
    drawn = rows.where(draw < share).select("key", "at", F.greatest(F.lit(1.0), share).alias("weight")).toPandas().sort_values(["key", "at"])
    if drawn.empty:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    reached = drawn["weight"].cumsum().to_numpy()
    picked = np.unique(np.searchsorted(reached, np.arange(1, ranges) / ranges * reached[-1]).clip(max=len(drawn) - 1))
    keys, ids = drawn["key"].to_numpy()[picked], drawn["at"].to_numpy()[picked]
    alone = np.bincount(np.searchsorted(np.unique(keys), keys))[np.searchsorted(np.unique(keys), keys)] == 1
    return keys, np.where(alone, np.iinfo(np.int64).min, ids)


def range_of(keys: np.ndarray, ids: np.ndarray):
    """A column function: how many boundaries are at or below (key, id)."""

    @F.pandas_udf("int")
    def place(key: pd.Series, at: pd.Series) -> pd.Series:
        k, i = key.to_numpy(np.int64), at.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for a in np.unique(low[high > low]):
            own = (low == a) & (high > low)
            out[own] = a + np.searchsorted(ids[a : high[own][0]], i[own], "right")
        return pd.Series(out.astype(np.int32))

    return place


def placed_groups(sizes: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, list[tuple[int, int]]], np.ndarray]:
    """For each large group (key, size) the ends of its pieces and their shards; and the bytes of small rows up to each shard's end.

    Groups within a share stay whole; the emptiest shard takes the largest piece that is left. Small rows fill all shards to one level.
    """
    share, loads = max(1.0, total / shards), np.zeros(shards)
    parts = []
    for key, size in sizes:
        whole = int(size / share) if size > share else 0
        cuts = [round((i + 1) * share) for i in range(whole)]
        ends = [*cuts, size] if not cuts or cuts[-1] < size else cuts
        parts += [(end - begin, key, end) for begin, end in zip([0, *ends], ends, strict=False)]
    pieces: dict[int, list[tuple[int, int]]] = {}
    for size, key, end in sorted(parts, key=lambda p: (-p[0], p[1], p[2])):
        to = int(loads.argmin())
        loads[to] += size
        pieces.setdefault(key, []).append((end, to))
    rest, order = total - sum(size for _, size in sizes), np.sort(loads)
    levels = (rest + np.cumsum(order)) / np.arange(1, shards + 1)
    level = levels[np.flatnonzero(levels >= order)[-1]] if shards else 0.0
    return {k: sorted(v) for k, v in pieces.items()}, np.cumsum(np.maximum(0.0, level - loads))


def shard_of(pieces: dict[int, list[tuple[int, int]]], starts: dict[int, int], sizes: dict[int, int], filled: np.ndarray):
    """A column function: the shard of a row from its key and the middle of its bytes (of a small group: the group's) in the order."""
    keys = np.array(sorted(pieces), np.int64)
    begin = np.array([starts[k] for k in keys.tolist()], np.float64)
    before = np.concatenate([[0], np.cumsum([sizes[k] for k in keys.tolist()])]).astype(np.float64)

    @F.pandas_udf("int")
    def place(key: pd.Series, middle: pd.Series) -> pd.Series:
        k, at = key.to_numpy(np.int64), middle.to_numpy(np.float64)
        ahead = np.searchsorted(keys, k, "left")
        out = np.searchsorted(filled, at - before[ahead], "right").clip(max=len(filled) - 1)
        large = (ahead < len(keys)) & (keys[np.minimum(ahead, max(0, len(keys) - 1))] == k) if len(keys) else np.zeros(len(k), bool)
        for i in np.unique(ahead[large]):
            own = large & (ahead == i)
            ends, to = (np.array(x) for x in zip(*pieces[int(keys[i])], strict=True))
            out[own] = to[np.searchsorted(ends, at[own] - begin[i], "right").clip(max=len(ends) - 1)]
        return pd.Series(out.astype(np.int32))

    return place


def shard_plan(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot: slots of a shard run from 0 in (key, id) order."""
    rows = settle(sized(docs), "shard-sizes")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    ranges = max(RANGES_A_SHARD * shards, -(-count // RANGE_ROWS))
    rows = rows.withColumn("range", range_of(*splitters(rows, total, ranges))("key", "at"))
    inside = Window.partitionBy("range").orderBy("key", "at", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("range", "key")
    rows = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside))
    rows = rows.withColumn("group_size", F.sum("size").over(same)).withColumn("group_start", F.min(F.col("upto") - F.col("size")).over(same))
    rows = settle(rows.drop("at"), "shard-ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    offsets = rows.groupBy("range").agg(F.sum("size").alias("bytes_in"))
    offsets = offsets.select("range", F.coalesce(F.sum("bytes_in").over(ahead), F.lit(0)).alias("bytes_ahead"))
    rows = rows.join(F.broadcast(offsets), "range")  # a row for RANGE_ROWS rows
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.min(F.col("bytes_ahead") + F.col("group_start")).alias("start"))
    large = groups.where(F.col("bytes") > LARGE * total / shards).collect()  # fewer than shards / LARGE
    sizes, starts = {g["key"]: g["bytes"] for g in large}, {g["key"]: g["start"] for g in large}
    pieces, filled = placed_groups(sorted(sizes.items()), shards, total)
    is_large = F.col("key").isin(*sizes) if sizes else F.lit(False)
    own, group = F.col("upto") - F.col("size") / 2.0, F.col("group_start") + F.col("group_size") / 2.0
    middle = F.col("bytes_ahead") + F.when(is_large, own).otherwise(group)
    rows = rows.withColumn("shard", shard_of(pieces, starts, sizes, filled)("key", middle))
    rows = settle(rows.select("doc_id", "size", "text_crc32", "key", "range", "nth", "shard"), "shard-places")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range and shard
    firsts = rows.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("many")).withColumn("first", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    inner = F.row_number().over(Window.partitionBy("range", "shard").orderBy("nth")) - 1
    return rows.withColumn("inner", inner).join(F.broadcast(firsts), ["range", "shard"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("inner")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The rows of docs as Parquet, in one folder for each shard and in slot order; equal rows go to the first one's shard."""
    places = shard_plan(docs, shards).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.min(F.struct("shard", "slot")).alias("_place"))
    placed = docs.join(places, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_key")))
    placed = placed.select(*[docs[c] for c in docs.columns], F.col("_place.shard").alias("_shard"), F.col("_place.slot").alias("_slot"))
    placed.repartitionByRange(shards * 4, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    plan = shard_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
