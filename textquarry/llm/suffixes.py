"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else are removed.

Only suffixes that can matter are sorted. Of the GRAM-byte grams in each 200-byte window the one with the least hash is its
anchor, so equal windows have equal anchors at equal offsets; a text has an anchor for about 70 bytes, and each anchor stands
for the run of windows that chose it. An anchor whose gram stands nowhere else has no repeated window and is left out; all others
are compared by their suffixes:

- each task sorts the suffixes behind its anchors into runs and front-codes them (common-prefix length, rest);
- runs are exchanged by ranges of the gram's hash, with splitters from a sample, and merged with a loser tree whose nodes keep the
  prefix a loser has in common with the winner, so no known prefix is compared again;
- common prefixes of neighbours in merged order tell which anchors share the bytes behind them for each offset, and the same
  for the reversed bytes before; a window is repeated if another anchor shares both for its offset.

Hashes only decide where to look; every removal is proved by bytes. Anchors of one slice of texts (SLICE_BYTES) whose run is the same,
bytes and offsets, are repeats of each other; one of them goes on for all, so a passage that a third of all texts share sends a row for
each slice. Texts are read as UTF-8; matches don't cross texts. Null and empty texts have no
bytes; texts below 200 bytes keep everything; rows with equal id and text are repeats of each other; long texts are cut into
overlapping blocks. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, table, whole_text

LENGTH, GRAM = 200, 64
#: Grams in a window, and the largest offset of an anchor in it.
WIDTH = LENGTH - GRAM + 1
BLOCK = 1 << 20
#: Bytes of texts whose anchors are made at once.
SLICE_BYTES = 4 << 20
#: Suffixes sorted into one run, and suffixes merged by one task on average.
RUN_ROWS, MERGE_ROWS = 50_000, 40_000
#: Sampled grams for each splitter.
SAMPLED = 32
_STEP = np.uint64(int(np.random.default_rng(7).integers(1, 1 << 63)) | 1)
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64)
_PLACE = np.uint64((1 << 30) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes at each place, by doubling."""
    h, size, step = _BYTE[data], 1, _STEP
    while size < GRAM:
        h = h[:-size] * step + h[size:]
        step, size = step * step, size * 2
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, base: int = 0) -> tuple[np.ndarray, ...]:
    """(gram hash, place, least offset, greatest offset) of the anchors of data's windows; places count from -base."""
    h = gram_hashes(np.frombuffer(data, np.uint8))
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WIDTH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = WIDTH - size
    chosen = (np.minimum(least[: len(least) - rest], least[rest:]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    at = chosen[first]
    return h[at].view(np.int64), at + base, at - last, at - first


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Slices of (doc, mark, place, bytes): blocks of texts that overlap by a window less a byte."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for rows in batches:
        for doc, mark, text in zip(rows["doc"], rows["mark"], rows["text"], strict=True):
            data = text.encode("utf-8", "replace")
            for a in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
                held.append((doc, mark, a, data[a : a + BLOCK + LENGTH - 1]))
                size += len(held[-1][3])
                if size >= SLICE_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of each text; kind 1: another one of the slice has the same run and goes on for it."""
    with np.errstate(over="ignore"):
        for held in pieces(batches):
            parts: list[tuple] = []
            first: dict[tuple[bytes, int, int], int] = {}
            run: list[int] = []
            for doc, mark, a, data in held:
                gram, at, low, high = anchors(data, a)
                run += [first.setdefault((data[p - y - a : p - x - a + LENGTH], x, y), len(first)) for p, x, y in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]
                parts.append((gram, np.full(len(at), doc), np.full(len(at), mark), at, low, high))
            gram, doc, mark, at, low, high = (np.concatenate(p) for p in zip(*parts, strict=True))
            _, lead, group, times = np.unique(np.array(run), return_index=True, return_inverse=True, return_counts=True)
            follows = np.ones(len(gram), bool)
            follows[lead] = False
            # Followers travel by their own place, not by the gram that they share.
            key = np.where(follows, gram ^ (doc * 1_000_003 + at) * np.int64(0x1E3779B97F4A7C15), gram)
            yield pd.DataFrame({"gram": key, "kind": follows.astype(np.int32), "settled": times[group] > 1, "doc": doc, "mark": mark, "at": at.astype(np.int32), "low": low.astype(np.int16), "high": high.astype(np.int16)})


ANCHOR = "gram long, kind int, settled boolean, doc long, mark long, at int, low short, high short"


def interesting(texts: DataFrame) -> DataFrame:
    """The anchors that are repeated within their slice (settled), or whose gram stands elsewhere too (compared)."""
    rows = texts.where(F.octet_length("text") >= LENGTH).mapInPandas(anchor_rows, ANCHOR)
    many = F.count(F.lit(1)).over(Window.partitionBy("kind", "gram"))
    rows = rows.withColumn("compared", (F.col("kind") == 0) & (many > 1))
    return rows.where(F.col("settled") | F.col("compared")).select("doc", "mark", "gram", "at", "low", "high", "settled", "compared")


def gram_splitters(found: DataFrame, tasks: int, compared: int) -> np.ndarray:
    """Where ranges of grams begin: quantiles of a sample of SAMPLED grams a task, so that a frequent gram doesn't share its range with many others."""
    rate = min(1.0, SAMPLED * tasks / max(1, compared))
    drawn = found.where(F.col("compared") & (F.pmod(F.xxhash64("gram", "doc", "mark", "at"), F.lit(1 << 40)) < int(rate * (1 << 40)))).select("gram").toPandas()["gram"].to_numpy(np.int64)
    grams = np.sort(drawn.view(np.uint64))
    return np.unique(grams[np.arange(1, tasks) * len(grams) // tasks]) if len(grams) else grams


def common(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix of a and b, of which k bytes are known."""
    end = min(len(a), len(b))
    while k < end and a[k : k + 32] == b[k : k + 32]:
        k += 32
    if k >= end:
        return end
    while k < end and a[k] == b[k]:
        k += 1
    return k


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    lcps = [0, *(common(a, b, 0) for a, b in zip(keys, keys[1:], strict=False))][: len(keys)]
    return lcps, [k[n:] for k, n in zip(keys, lcps, strict=True)]


def runs(batches: Iterator[pd.DataFrame], splitters: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sorted, front-coded runs of suffixes, one blob for each task they go to."""
    press, held = zstandard.ZstdCompressor(level=1), []

    def flush() -> pd.DataFrame:
        held.sort(key=lambda r: r[0])
        out, a = [], 0
        to = np.searchsorted(splitters, np.frombuffer(b"".join(r[0][:8] for r in held), ">u8").astype(np.uint64), "right").tolist()
        while a < len(held):
            b = a
            while b < len(held) and to[b] == to[a]:
                b += 1
            keys, before, doc, mark, at, low, high, settled = zip(*held[a:b], strict=True)
            out.append((to[a], press.compress(pickle.dumps((*front_coded(list(keys)), before, np.array(doc), np.array(mark), np.array(at), np.array(low), np.array(high), np.array(settled))))))
            a = b
        held.clear()
        return pd.DataFrame(out, columns=["task", "run"])

    for rows in batches:
        for doc, mark, body, *found in zip(*(rows[c] for c in ("doc", "mark", "body", "gram", "at", "low", "high", "settled")), strict=True):
            data = zstandard.ZstdDecompressor().decompress(body)
            for gram, at, low, high, settled in zip(*(x.tolist() for x in found), strict=True):
                key = (gram % (1 << 64)).to_bytes(8, "big") + data[at + GRAM : at - low + LENGTH]
                held.append((key, data[at - high : at][::-1], doc, mark, at, low, high, settled))
                if len(held) >= RUN_ROWS:
                    yield flush()
    if held:
        yield flush()


class LoserTree:
    """Merges front-coded runs; a node's loser keeps the prefix that it has in common with what passed it."""

    def __init__(self, sources: list[tuple[list[int], list[bytes]]]):
        self.sources, n = sources, 1
        while n < len(sources):
            n *= 2
        self.n, self.nth = n, [0] * n
        self.keys: list[bytes | None] = [s[1][0] if s[1] else None for s in sources] + [None] * (n - len(sources))
        self.losers: list[tuple[int, int]] = [(0, 0)] * n
        self.winner = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.n:
            return 0, node - self.n
        winner, self.losers[node] = self.duel(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def duel(self, a: tuple[int, int], b: tuple[int, int]):
        """(winner, loser): each is (prefix in common with the last one out, source)."""
        x, y = self.keys[a[1]], self.keys[b[1]]
        if y is None or x is not None and a[0] > b[0]:
            return a, b
        if x is None or b[0] > a[0]:
            return b, a
        k = common(x, y, a[0])
        if k == len(x) or k < len(y) and x[k] < y[k]:
            return a, (k, b[1])
        return b, (k, a[1])

    def __iter__(self):
        """(source, index in it, key, prefix in common with the one before)."""
        while True:
            lcp, s = self.winner
            key = self.keys[s]
            if key is None:
                return
            i = self.nth[s]
            yield s, i, key, lcp
            lcps, rests = self.sources[s]
            self.nth[s] = i = i + 1
            if i < len(rests):
                self.keys[s] = key[: lcps[i]] + rests[i]
                now = lcps[i], s
            else:
                self.keys[s] = None
                now = 0, s
            node = (s + self.n) // 2
            while node:
                now, self.losers[node] = self.duel(now, self.losers[node])
                node //= 2
            self.winner = now


def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges a task's runs and yields the repeated stretches of anchors that their slice hasn't settled."""
    open_ = zstandard.ZstdDecompressor()
    loaded = [pickle.loads(open_.decompress(r)) for rows in batches for r in rows["run"]]
    if not loaded:
        return
    source, index, lcps, heads = [], [], [], []
    for s, i, key, lcp in LoserTree([(r[0], r[1]) for r in loaded]):
        source.append(s)
        index.append(i)
        lcps.append(lcp)
        heads.append(key[:8])
    offsets = np.cumsum([0, *(len(r[0]) for r in loaded)])
    place = offsets[np.array(source)] + np.array(index)
    before = [b for r in loaded for b in r[2]]
    doc, mark, at, low, high, settled = (np.concatenate([r[k] for r in loaded])[place] for k in range(3, 9))
    del loaded
    n, ahead = len(place), np.array(lcps)
    back_keys = [h + before[p] for h, p in zip(heads, place, strict=True)]
    back_order = sorted(range(n), key=back_keys.__getitem__)
    behind = np.array([0, *(common(back_keys[a], back_keys[b], 0) for a, b in zip(back_order, back_order[1:], strict=False))])[:n]
    back_order = np.array(back_order)
    repeated = np.zeros((n, WIDTH + 1), np.int8)
    back = np.empty(n, np.int64)
    for o in range(WIDTH):
        use = np.flatnonzero((low <= o) & (high >= o))
        if len(use) < 2:
            continue
        front = np.cumsum(ahead < 8 + LENGTH - GRAM - o)
        back[back_order] = np.cumsum(behind < 8 + o)
        _, group, count = np.unique(front[use] * (n + 1) + back[use], return_inverse=True, return_counts=True)
        repeated[use[count[group] > 1], o] = 1
    repeated[settled.astype(bool)] = 0
    turns = np.diff(repeated, axis=1, prepend=0)
    (who, first), (_, stop) = np.nonzero(turns == 1), np.nonzero(turns == -1)
    yield pd.DataFrame({"doc": doc[who], "mark": mark[who], "start": at[who] - stop + 1, "end": at[who] - first + LENGTH})


def stretches(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    open_ = zstandard.ZstdDecompressor()
    for rows in batches:
        out = []
        for doc, body, starts, ends, more in zip(*(rows[c] for c in ("doc", "body", "starts", "ends", "more")), strict=True):
            data = open_.decompress(body)
            gone = stretches([*zip(starts.tolist(), ends.tolist(), strict=True), *((x["start"], x["end"]) for x in (more if more is not None else ()))])
            ends = [0, *(p for s in gone for p in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def packer():
    """A column function: compressed UTF-8 bytes."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: None if t is None else press.compress(t.encode("utf-8", "replace")))

    return pack


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    spark, nobody = docs.sparkSession, -(2**63)
    texts = docs.select(F.coalesce("doc_id", F.lit(nobody)).cast("long").alias("doc"), F.xxhash64(whole_text()).alias("mark"), whole_text().alias("text"))
    found = settle(interesting(texts), "anchors")
    compared = found.where("compared").count()
    by_doc = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "at", "low", "high", "settled", "compared")).alias("found"))
    joined = texts.join(by_doc, ["doc", "mark"], "left")
    # One join with the texts: those without anchors are done, of the others the bytes are kept beside their anchors.
    text, hit = F.col("text"), F.col("found").isNotNull()
    state = joined.select("doc", "mark", packer()(F.when(hit, text)).alias("body"), "found", F.octet_length(text).cast("long").alias("n_bytes"), F.when(~hit, F.sha2(text.cast("binary"), 256)).alias("sha"))
    state = settle(state, "texts")
    touched = state.where("found is not null")
    zero = F.lit(0).cast("long")
    whole = state.where("found is null").select("doc", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-compared // MERGE_ROWS))
    splitters = gram_splitters(found, tasks, compared)
    compare = touched.withColumn("x", F.filter("found", lambda x: x["compared"])).where(F.size("x") > 0)
    sent = compare.select("doc", "mark", "body", *[F.col(f"x.{c}").alias(c) for c in ("gram", "at", "low", "high", "settled")]).mapInPandas(lambda it: runs(it, splitters), "task int, run binary")
    more = sent.repartitionById(tasks, "task").mapInPandas(merged, "doc long, mark long, start long, end long")
    more = more.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    done = F.filter("found", lambda x: x["settled"])
    starts, ends = F.transform(done, lambda x: x["at"] - x["high"]), F.transform(done, lambda x: x["at"] - x["low"] + LENGTH)
    parts = touched.join(more, ["doc", "mark"], "left").select("doc", "body", starts.alias("starts"), ends.alias("ends"), "more").mapInPandas(cut, RESULT)
    every = parts.unionAll(whole)
    return every.select(F.when(F.col("doc") != nobody, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
