"""MinHash near-duplicates: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

One hash function gives every shingle a value. The values of a set A are ordered by how many sets hold them, then by the value,
and A retains its first |A| - ceil(t * |A|) + 1: under any common order two sets of similarity t or more share one of
theirs, so the inverted lists of retained values lose no pair, and ordering by counts keeps them short.

1. Equal sets become one node. Counts come from blocks of texts: each sends its sorted values to the ranges they lie in, and
   a range tells every block which of them stand nowhere else. A node whose retained values all do is done; the others, the
   open nodes, are counted again among themselves, which gives order and lists.
2. In every list the node with the fewest values of its own (such as the original of many edited copies) is the hub, and each
   node is compared with the hub that it meets most. Verified pairs merge into components, and lists within one are done.
3. Lists that still hold different components give the pairs that pass the bounds from sizes and places: what precedes the common
   value is in one set only. Values of its own come first in a node's order, so copies edited beyond the similarity are dropped
   from a list before pairs are made, however many there are.

A candidate pair must pass an estimate from the bottom SKETCH values of the union of two uniform sketches, then both full sets
are compared. The estimate may fall SLACK standard deviations short: a pair of similarity t = 0.8 fails it with
odds of 1e-11 (a binomial tail), one above t with less. Values are 64-bit hashes of shingles: a set of 10,000 holds two equal ones with odds of 3e-12.
Counts use the top bits of values, so that two values in 16,000 may be taken for one; that only makes lists longer.

Null, empty and blank texts have no shingles and are linked with nothing. Fewer words than a shingle has make one shingle. Each row
is a document of its own: rows with equal sets are linked whatever their ids, others that share an id or have none
aren't linked by that. A component's id is its smallest doc_id, null if none has one. Very long texts are hashed in pieces. An
empty table gives an empty result. Only doc_id and text are read; other columns pass through drop_near_duplicates.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, settle, table

#: Default shingle and similarity (in hundredths) of near-duplicate stages.
WIDTH, SIMILAR = 5, 80
#: Values in the uniform sketch; the estimate may fall short by so many standard deviations.
SKETCH, SLACK = 64, 7
#: Rounds of comparing with hubs before lists give their pairs.
HUB_ROUNDS = 2
#: Texts in a block: 2 to this power. Values that a range of values has on average.
BLOCK_BITS, RANGE_VALUES = 9, 2_000_000
#: Bits of a value beyond the logarithm of how many there are.
MORE_BITS = 14
#: Bytes hashed at once.
BLOCK = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_RANDOM = np.random.default_rng(1)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_STEP, _JOIN, _SALT = (np.uint64(int(x) | 1) for x in _RANDOM.integers(1, 1 << 63, 3))


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased data, and where they start."""
    codes = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[codes], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    firsts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(inside[1:-1])
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    values = _BYTE[codes[at]] * powers[np.arange(len(at)) - np.repeat(firsts, sizes)]
    return _mix(np.add.reduceat(values, firsts) + sizes.astype(np.uint64)), starts


def words_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, computed for BLOCK bytes at once; a longer text in pieces cut at white space."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            hashes, starts = word_hashes(b"\n".join(held))
            ends = np.cumsum([len(d) + 1 for d in held])
            yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))
            held.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        if size + len(data) > BLOCK:
            yield from flush()
            size = 0
        if len(data) > BLOCK:
            parts, a = [], 0
            while a < len(data):
                b = min(len(data), a + BLOCK)
                while b < len(data) and not _SPACE[data[b]]:
                    b += 1
                parts.append(word_hashes(data[a:b])[0])
                a = b
            yield np.concatenate(parts)
            continue
        held.append(data)
        size += len(data)
    yield from flush()


def shingle_values(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a text's words, ascending."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    h = np.full(n - k + 1, _SALT * np.uint64(k) if k < width else np.uint64(0), np.uint64)
    for j in range(k):
        h = h * _JOIN + words[j : n - k + 1 + j]
    return np.unique(_mix(h))


def retained(size: str, similar: int) -> str:
    """SQL: how many values a set of this size retains."""
    return f"{size} - ({similar} * {size} + 99) div 100 + 1"


def measure(width: int):
    """A column function: the size of a text's set, and its digest."""

    @F.pandas_udf("n long, digest binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        out = [(len(v), hashlib.blake2b(v.tobytes(), digest_size=16).digest()) for v in (shingle_values(w, width) for w in words_of(texts.tolist()))]
        return pd.DataFrame(out, columns=["n", "digest"])

    return sets


def bottom(width: int):
    """A column function: the uniform sketch."""

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_values(w, width)[:SKETCH].view(np.int64) for w in words_of(texts.tolist())])

    return sketch


def packed(values: np.ndarray, places: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending values as differences, with 16-bit arrays beside them, byte by byte so that equal high bytes compress."""
    planes = [np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)]
    planes += [np.ascontiguousarray(x.astype(np.uint16).view(np.uint8).reshape(-1, 2).T) for x in (places, *more)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(values)) + b"".join(p.tobytes() for p in planes))


def unpacked(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n = struct.unpack_from("<I", data)[0]
    planes = np.frombuffer(data, np.uint8, offset=4).reshape(-1, n) if n else np.empty((8, 0), np.uint8)
    out = [np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)]
    return out + [np.ascontiguousarray(planes[k : k + 2].T).view(np.uint16).ravel() for k in range(8, len(planes), 2)]


#: The place of a value that several texts of one block hold.
SEVERAL = 1 << BLOCK_BITS


def spreader(width: int, bits: int, ranges: int, every: bool):
    """(part, block, body): the values of each block of texts by range; every: for each text that holds them, else once a block."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: int | None = None
        held: list[np.ndarray] = []
        places: list[int] = []

        def flush() -> pd.DataFrame:
            values = np.concatenate(held) >> np.uint64(64 - bits)
            place = np.repeat(np.array(places, np.int64), [len(v) for v in held])
            order = np.argsort(values, kind="stable")
            values, place = values[order], place[order]
            if not every:
                first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                single = np.diff(np.r_[first, len(values)]) == 1
                values, place = values[first], np.where(single, place[first], SEVERAL)
            part = (values * np.uint64(ranges)) >> np.uint64(bits)
            parts, first = np.unique(part, return_index=True)
            last = np.r_[first[1:], len(part)]
            out = [(int(p), block, packed(values[a:b], place[a:b])) for p, a, b in zip(parts, first, last, strict=True)]
            held.clear()
            places.clear()
            return pd.DataFrame(out, columns=["part", "block", "body"])

        for rows in batches:
            for nth, words in zip(rows["nth"].tolist(), words_of(rows["text"].tolist()), strict=True):
                if nth >> BLOCK_BITS != block and held:
                    yield flush()
                block = nth >> BLOCK_BITS
                values = shingle_values(words, width)
                if len(values):
                    held.append(values)
                    places.append(nth & (SEVERAL - 1))
        if held:
            yield flush()

    return spread


def counted(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, values, places, how many hold each) for every block of a range."""
    bodies = [unpacked(b) for b in rows["body"]]
    every = np.concatenate([v for v, _ in bodies])
    _, group, times = np.unique(every, return_inverse=True, return_counts=True)
    times, a = times[group], 0
    for block, (values, places) in zip(rows["block"], bodies, strict=True):
        yield block, values, places, times[a : a + len(values)]
        a += len(values)


def whole_part(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [rows for rows in batches if len(rows)]
    return pd.concat(parts, ignore_index=True) if parts else None


def singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, body): the places of the block's texts that hold a value alone, one for each such value."""
    if (rows := whole_part(batches)) is not None:
        out = [(block, zstandard.ZstdCompressor(level=1).compress(np.sort(places[(times == 1) & (places < SEVERAL)]).tobytes())) for block, _, places, times in counted(rows)]
        yield pd.DataFrame(out, columns=["block", "body"])


def shared_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, body): values that several texts hold, the places of the block's texts, the counts (up to 65,535, as the order asks for no more)."""
    if (rows := whole_part(batches)) is not None:
        out = [(block, packed(values[several], places[several], np.minimum(times[several], 65_535))) for block, values, places, times in counted(rows) if (several := times > 1).any()]
        yield pd.DataFrame(out, columns=["block", "body"])


def own_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """(nth, own): how many values each text of a block holds alone."""
    places = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint16) for b in rows["body"]])
    own = np.bincount(places, minlength=SEVERAL)
    at = np.flatnonzero(own)
    return pd.DataFrame({"nth": (int(rows["block"].iloc[0]) << BLOCK_BITS) + at, "own": own[at]})


def lister(similar: int):
    def entries(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """(value, node, n, at, own) of a block: the retained values that others hold too, and their place in the node's order."""
        names = ["value", "node", "n", "at", "own"]
        if not len(nodes) or not len(rows):
            return pd.DataFrame(columns=names).astype("int64")
        values, places, times = (np.concatenate(x) for x in zip(*(unpacked(b) for b in rows["body"]), strict=True))
        order = np.lexsort((values, times, places))
        values, places = values[order], places[order].astype(np.int64)
        size, node = np.zeros(SEVERAL, np.int64), np.zeros(SEVERAL, np.int64)
        at = nodes["nth"].to_numpy() & (SEVERAL - 1)
        size[at], node[at] = nodes["n"], nodes["node"]
        many = np.bincount(places, minlength=SEVERAL)
        own = size - many
        rank = own[places] + np.arange(len(places)) - (np.cumsum(many) - many)[places]
        kept = rank < (size + 1 - (similar * size + 99) // 100)[places]
        places = places[kept]
        return pd.DataFrame({"value": values[kept].view(np.int64), "node": node[places], "n": size[places], "at": rank[kept], "own": own[places]})

    return entries


def verifier(width: int, similar: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            linked = []
            for a, b in zip(rows["text_u"], rows["text_v"], strict=True):
                x, y = (shingle_values(next(words_of([t])), width) for t in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= similar * (len(x) + len(y) - both))
            yield rows[["u", "v"]][np.array(linked, bool)]

    return verify


def estimated(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) whose union sketch allows the similarity."""
    t = similar / 100
    sketches = nodes.select("node", "bottom")
    both = pairs.join(sketches.select(F.col("node").alias("u"), F.col("bottom").alias("a")), "u").join(sketches.select(F.col("node").alias("v"), F.col("bottom").alias("b")), "v")
    # Order by the values as unsigned numbers, as the sketches are.
    unsigned = F.transform(F.array_union("a", "b"), lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    union = F.transform(F.slice(F.array_sort(unsigned), 1, SKETCH), lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    both = both.withColumn("union", union).withColumn("shared", F.size(F.array_intersect(F.array_intersect("a", "b"), "union"))).withColumn("size", F.size("union"))
    return both.where(F.col("shared") >= t * F.col("size") - SLACK * F.sqrt(t * (1 - t) * F.col("size"))).select("u", "v")


def confirmed(pairs: DataFrame, nodes: DataFrame, width: int, similar: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    texts = nodes.select("node", "text")
    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    return both.mapInPandas(verifier(width, similar), "u long, v long")


def widest(n: str, at: str, similar: int) -> Column:
    """The largest set that a set can be similar to whose first common value with it is at this place, as what precedes it is in one set only."""
    return F.expr(f"({100 + similar} * ({n} - {at})) div {similar} - {n}")


def placed(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """The lists with each node's component."""
    if found is None:
        return lists.withColumn("component", F.col("node"))
    return lists.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def still_open(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with their hub and their smallest set."""
    hub = F.min(F.struct("own", "node", "n", "wide", "component"))
    heads = lists.groupBy("value").agg(hub.alias("hub"), F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").drop("low", "high")
    # Settled, so that nothing but exchanges stands below the join and a list that many nodes share is split.
    return lists.join(settle(heads, "hubs"), "value")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Each node with the hub that it meets in most lists."""
    meet = lists.where("component != hub.component and n <= hub.wide and hub.n <= wide").groupBy(F.col("node").alias("u"), F.col("hub.node").alias("v")).agg(F.count(F.lit(1)).alias("met"))
    best = meet.groupBy("u").agg(F.max(F.struct("met", (-F.col("v")).alias("v"))).alias("best")).select("u", (-F.col("best.v")).alias("v"))
    return best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def cross_pairs(lists: DataFrame) -> DataFrame:
    """Every pair of a list that lies in different components and can be similar."""
    some = lists.where("least <= wide").drop("hub")
    a, b = some.alias("x"), some.alias("y")
    both = a.join(b, F.expr("x.value = y.value and x.node > y.node and x.component != y.component and x.n <= y.wide and y.n <= x.wide"))
    return both.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()


def grouped(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """A row for each row of docs: row, doc (all its columns), n, component (rows with the same one belong together)."""
    spark = docs.sparkSession
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = settle(named.withColumn("sets", measure(width)("doc.text")).select("doc", "sets.n", "sets.digest", F.monotonically_increasing_id().alias("row")), "rows", "zstd")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return rows.select("row", "doc", "n", F.col("row").alias("component"))
    bits = total.bit_length() + MORE_BITS
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counts(texts: DataFrame, values: int, every: bool) -> DataFrame:
        ranges = max(usual, -(-values // RANGE_VALUES))
        return texts.mapInPandas(spreader(width, bits, ranges, every), "part int, block long, body binary").repartitionById(ranges, "part").mapInPandas(shared_values if every else singles, "block long, body binary")

    own = counts(rows.where("n > 0").select(F.col("row").alias("nth"), F.col("doc.text").alias("text")), total, False).groupBy("block").applyInPandas(own_counts, "nth long, own long")
    heads = settle(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n")), "heads")
    left = heads.join(own.withColumnRenamed("nth", "row"), "row", "left").where(F.expr(f"coalesce(own, 0) < {retained('n', similar)}")).select("row")
    nodes = rows.select("row", "n", F.col("doc.text").alias("text")).join(left, "row").withColumnRenamed("row", "node")
    nodes = settle(nodes.withColumn("bottom", bottom(width)("text")).withColumn("nth", F.monotonically_increasing_id()), "nodes", "zstd")

    values = counts(nodes.select("nth", "text"), nodes.agg(F.sum("n")).first()[0] or 0, True)
    block = F.shiftright("nth", BLOCK_BITS).alias("block")
    lists = nodes.select("nth", "node", "n", block).groupBy("block").cogroup(values.groupBy("block")).applyInPandas(lister(similar), "value long, node long, n long, at long, own long")
    lists = settle(lists.withColumn("wide", widest("n", "at", similar)).drop("at"), "lists")

    def tested(pairs: DataFrame, label: str) -> DataFrame:
        return settle(confirmed(settle(estimated(pairs, nodes, similar), f"{label}-likely"), nodes, width, similar), f"{label}-links")

    links = found = done = None
    for _ in range(HUB_ROUNDS):
        before, lists = lists, settle(still_open(placed(lists, found)), "open-lists")
        discard(before)
        lists, pairs = lists.drop("least"), hub_pairs(lists)
        pairs = settle(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "hub-pairs")
        done = pairs if done is None else done.unionAll(pairs)
        more = tested(pairs, "hub")
        links = more if links is None else links.unionAll(more)
        found = components(links)
        lists = lists.drop("hub")
    cross = settle(cross_pairs(still_open(placed(lists, found))).join(done, ["u", "v"], "left_anti"), "cross-pairs")
    more = tested(cross, "cross")
    if not more.isEmpty():
        found = components(links.unionAll(more))
    discard(nodes)
    same = rows.select("row", "digest", "n").join(heads.select("digest", F.col("row").alias("node")), "digest").join(found, "node", "left")
    same = settle(same.select("row", F.coalesce("component", "node").alias("component")), "row-components")
    return rows.join(same, "row", "left").select("row", "doc", "n", F.coalesce("component", "row").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    every = grouped(docs.select("doc_id", "text"), width, similar).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n", "component")
    every = settle(every, "documents")
    least = settle(every.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")  # a table, so that a large component's join is split
    return every.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """One row of each group: the one with the smallest id, the first of those that share it; rows without an id come last."""
    every = grouped(docs, width, similar)
    at = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    stay = every.select("component", at.alias("at")).groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.row").alias("row"))
    return every.join(stay, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, similar=80)
