"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes sets the boundaries, normalised: few bits must vanish after the usual chunk
size, more before it, so sizes gather around it. Within the first OPENING bytes chunks may be smaller and end more often, so that a text of
some words has several too. A fingerprint is the set of 64-bit chunk digests with their lengths; since
boundaries depend on nearby bytes alone, an edit or a shift changes the chunks around it and no others. Likeness is
containment: the bytes of the shared chunks over those of the smaller set.

Null texts are empty; an empty text has the empty fingerprint, which is like itself only. Equal texts have equal
fingerprints. "Next" is the next row by (id, text), null ids first, after the last the first; a table of one row is its own
next; an empty table gives an empty result. Texts are streamed in that order, one partition a range of ids (more of them for more
rows), each range followed by a copy of the next one's first row. Rows that share an id stay in one partition.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, whole_text

LEAST, USUAL, MOST = 8, 24, 96
#: Where a text opens, and the least size there.
OPENING, LEAST_THERE = 96, 4
#: Hash bits that must be 0 at a boundary, before and after the usual size, and in the opening.
STRICT_BITS, LOOSE_BITS, OPEN_BITS = 6, 3, 2
#: Rows in a partition, about.
PART_ROWS = 20_000
LAG = 32
#: The gear table: 256 fixed random values, from a seed.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def boundaries_at(data: np.ndarray, opening: int) -> tuple[list[int], list[int], list[int]]:
    """Places after which the strict, the loose and (in the first bytes) the opening's rule allow a boundary."""
    h = GEAR[data]
    for lag in (1, 2, 4, 8, 16):
        h[lag:] += h[:-lag] << np.uint32(lag)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0]
    return (strict + 1).tolist(), (loose + 1).tolist(), (np.flatnonzero(h[: max(0, opening)] >> np.uint32(32 - OPEN_BITS) == 0) + 1).tolist()


def cuts(data: bytes, done: list[int] | None = None) -> list[int]:
    """The ends of the chunks of data; done: ends that are known to stand."""
    out, n = list(done or ()), len(data)
    pos = out[-1] if out else 0
    skip = max(0, pos - LAG)
    strict, loose, early = boundaries_at(np.frombuffer(data, np.uint8)[skip:], OPENING - skip)
    while pos < n:
        near, far = pos + USUAL - skip, min(pos + MOST, n)
        i = bisect_left(early, pos + LEAST_THERE - skip)
        if pos < OPENING and i < len(early):
            pos = early[i] + skip
            out.append(pos)
            continue
        i = bisect_left(strict, pos + LEAST - skip)
        if i < len(strict) and strict[i] < near:
            pos = strict[i] + skip
        else:
            i = bisect_left(loose, near)
            pos = min(far, loose[i] + skip) if i < len(loose) else far
        out.append(pos)
    return out


def chunk_set(data: bytes, ends: list[int]) -> dict[int, int]:
    """digest: length."""
    out, a = {}, 0
    for b in ends:
        out[xxhash.xxh3_64_intdigest(data[a:b])] = b - a
        a = b
    return out


def written(chunks: dict[int, int]) -> str:
    return base64.b64encode(b"".join(struct.pack(">QB", d, n) for d, n in sorted(chunks.items()))).decode()


def read_back(fingerprint: str) -> dict[int, int]:
    return dict(struct.iter_unpack(">QB", base64.b64decode(fingerprint)))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(n for d, n in small.items() if d in large) / min(sum(a.values()), sum(b.values()))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "replace")
    return written(chunk_set(data, cuts(data)))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame) -> DataFrame:
    """at, known, text, tail: partitions hold ascending ranges of ids, each with the next range's first id (tail) behind it."""
    at = F.coalesce("doc_id", F.lit(-(2**63))).cast("long")
    rows = docs.select(at.alias("at"), F.col("doc_id").isNotNull().alias("known"), whole_text().alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    low, marks = rows.agg(F.min("at"), F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()
    if low is None:
        return rows.withColumn("tail", F.lit(0))
    edges = np.unique(np.array([low, *marks], np.int64))

    @F.pandas_udf("int")
    def nth(at: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(edges, at.to_numpy(np.int64), "right") - 1).astype(np.int32))

    @F.pandas_udf("boolean")
    def leads(at: pd.Series) -> pd.Series:
        return pd.Series(np.isin(at.to_numpy(np.int64), edges))

    n = len(edges)
    own, before = F.struct(F.col("nth").alias("part"), F.lit(0).alias("tail")), F.struct(((F.col("nth") + n - 1) % n).alias("part"), F.lit(1).alias("tail"))
    rows = rows.withColumn("nth", nth("at")).withColumn("to", F.explode(F.when(leads("at"), F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("at", "known", "text", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    return rows.repartitionById(n, "part").sortWithinPartitions("tail", "at", "known", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of SCHEMA for each row that isn't a tail, from the rows of a partition in order."""
    held = None  # doc_id, text, bytes, ends, chunks of the row that waits for its next
    for rows in batches:
        out = []
        for at, known, text, tail in zip(rows["at"], rows["known"], rows["text"], rows["tail"], strict=True):
            if tail and held is None:
                continue
            data = text.encode("utf-8", "replace")
            ends = cuts(data)
            chunks = chunk_set(data, ends)
            if held is not None:
                out.append(row(*held, text, chunks))
            held = None if tail else (int(at) if known else None, text, data, ends, chunks)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def row(doc_id, text, data, ends, chunks, following, next_chunks) -> tuple:
    new = edited(text, following)
    new_data = new.encode("utf-8", "replace")
    same = len(text[: len(text) - len(text) // 4].encode("utf-8", "replace"))
    stand = ends[: bisect_left(ends, same)]  # a boundary depends on no later byte
    new_chunks = chunk_set(new_data, cuts(new_data, stand))
    return doc_id, len(text), hashlib.sha256(new_data).hexdigest(), written(chunks), written(new_chunks), likeness(chunks, new_chunks), likeness(chunks, next_chunks)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return in_order(table(spark, sf_dir, "documents")).mapInPandas(compare, SCHEMA)
