"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of its UTF-8 bytes, which together cover all of it. Learned filters run over the
embedded bytes of each chunk and are max-pooled within it; the mean and the maximum over all chunks go into one logistic
unit. Chunks of many texts are scored together, so memory is bounded by the block and not by the longest text.

Learning uses a bounded sample of rows, the SAMPLE labelled ones that come first by hash of the id, with all their chunks, as in
scoring. Every byte of every text is scored. Null and empty texts are one chunk of padding and get a score like
any other; null labels and labels without a document are left out, repeated labels count as often as they stand; without
labels every score is 0.5; equal texts get equal scores; an empty table gives an empty result. Of the table only id and text are
read; where it has columns score or predicted, these stay and the new ones get a name with underscores behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .convnet import Net, Shape, learn
from .shared import free_name, id_remainder, table

CHUNK, OVERLAP = 512, 32
PAD = 256
SHAPE = Shape(symbols=PAD + 1, width=8, stride=2, dim=8, filters=24)
#: Labelled rows that are learned from, at most.
SAMPLE = 3000
EPOCHS, SEED = 8, 5
#: Chunks scored at once.
BLOCK = 256


def chunks_of(data: bytes) -> np.ndarray:
    """(n, CHUNK) codes: starts lie CHUNK - OVERLAP apart, the last chunk is filled up with PAD."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


def scores(net: Net, texts) -> np.ndarray:
    """A probability for each text; blocks of chunks run across text borders."""
    n = len(texts)
    total, most, count = np.zeros((n, net.shape.filters), np.float32), np.zeros((n, net.shape.filters), np.float32), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def flush() -> None:
        codes, owner = np.concatenate(held), np.concatenate(owners)
        held.clear()
        owners.clear()
        for a in range(0, len(codes), BLOCK):
            top, own = net.pooled(codes[a : a + BLOCK]), owner[a : a + BLOCK]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            who = own[starts]
            total[who] += np.add.reduceat(top, starts)
            most[who] = np.maximum(most[who], np.maximum.reduceat(top, starts))

    waiting = 0
    for i, text in enumerate(texts):
        codes = chunks_of((text or "").encode("utf-8", "replace"))
        count[i] = len(codes)
        held.append(codes)
        owners.append(np.full(len(codes), i))
        waiting += len(codes)
        if waiting >= 8 * BLOCK:
            flush()
            waiting = 0
    if held:
        flush()
    return net.combine(total / np.maximum(count, 1)[:, None], most)


def learning_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each text with its label."""
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows["doc_id"], "mark": rows["mark"], "data": [(t or "").encode("utf-8", "replace") for t in rows["text"]]})


def fit(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> Net:
    """Learns from at most `sample` rows of labels (doc_id, mark) for which the column `usable` holds."""
    marked = labels.where(usable & F.col("mark").isin(0, 1) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(sample)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    rows = texts.join(F.broadcast(marked), "doc_id").mapInPandas(learning_chunks, "doc_id long, mark int, data binary").toPandas()  # at most `sample` labels
    rows = rows.sort_values(["doc_id", "mark", "data"])
    return learn(SHAPE, [chunks_of(x) for x in rows["data"]], rows["mark"].to_numpy(np.float32), EPOCHS, SEED)


def scorer(net: Net):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(net, texts.tolist()))

    return score


def with_quality(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """docs and the columns score, predicted."""
    score = free_name(docs, "score")
    return docs.withColumn(score, scorer(net)("text")).withColumn(free_name(docs, "predicted"), (F.col(score) >= threshold).cast("int"))


def good_ones(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at the threshold or above."""
    return docs.where(scorer(net)("text") >= threshold)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Net:
    """Held-out rows (crc32 of the id, modulo 4, is 2) are not learned from."""
    return fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("mark")), id_remainder(4) != 2)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select("doc_id", "text"), net).select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", "predicted")
