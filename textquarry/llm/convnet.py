"""A small convolutional network over symbol codes, in numpy: embed, convolve, max-pool each chunk, combine, one logistic unit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RATE, DECAY, BATCH = 0.01, 1e-4, 32


@dataclass(frozen=True)
class Shape:
    """symbols: codes run below this; a filter sees `width` codes and stands at every `stride`-th place."""

    symbols: int
    width: int
    stride: int
    dim: int
    filters: int


@dataclass
class Net:
    """embed (symbols, dim), filters (width * dim, filters), bias, out (2 * filters,), base."""

    shape: Shape
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    @classmethod
    def fresh(cls, shape: Shape, seed: int) -> Net:
        r, seen = np.random.default_rng(seed), shape.width * shape.dim
        f32 = np.float32
        return cls(shape, r.normal(0, 0.5, (shape.symbols, shape.dim)).astype(f32), r.normal(0, 1 / np.sqrt(seen), (seen, shape.filters)).astype(f32), np.zeros(shape.filters, f32), np.zeros(2 * shape.filters, f32), 0.0)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]

    def traced(self, codes: np.ndarray, block: int = 256):
        """The maxima, where they stand, and what each filter saw there, a block of chunks at a time."""
        parts = [self.pooled(codes[a : a + block], places=True) for a in range(0, len(codes), block)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def pooled(self, codes: np.ndarray, places: bool = False):
        """(chunks, filters) maxima; with places also where they stand and what the filters saw."""
        s = self.shape
        seen = self.embed[codes].reshape(len(codes), -1)
        x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(seen, s.width * s.dim, axis=1)[:, :: s.stride * s.dim])
        act = (x.reshape(-1, s.width * s.dim) @ self.filters).reshape(len(codes), -1, s.filters)
        if not places:
            return np.maximum(act.max(1) + self.bias, 0)
        at = act.argmax(1)
        return np.maximum(np.take_along_axis(act, at[:, None], 1)[:, 0] + self.bias, 0), at, x[np.arange(len(codes))[:, None], at]

    def combine(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The probability from the mean and the maximum over a document's chunks."""
        return sigmoid(np.concatenate([mean, most], 1) @ self.out + self.base).astype(np.float64)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(shape: Shape, samples: list[np.ndarray], marks: np.ndarray, epochs: int, seed: int) -> Net:
    """Adam on the log loss; the gradient goes through the maxima only. samples: the chunks (n, length) of each document."""
    net = Net.fresh(shape, seed)
    if not len(samples):
        return net
    rate = marks.mean()
    net.base = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    r, parts = np.random.default_rng(seed), net.parts()
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    mb = vb = 0.0
    for epoch in range(epochs):
        step = RATE * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
        order = r.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            codes = np.concatenate([samples[i] for i in docs])
            owner = np.repeat(np.arange(len(docs)), [len(samples[i]) for i in docs])
            top, at, x = net.traced(codes)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.bincount(owner)[:, None]
            mean, most = np.add.reduceat(top, starts) / count, np.maximum.reduceat(top, starts)
            feats = np.concatenate([mean, most], 1)
            error = (sigmoid(feats @ net.out + net.base) - marks[docs]) / len(docs)
            g_feats = error[:, None] * net.out
            g_top = (g_feats[:, : shape.filters] / count)[owner] + g_feats[:, shape.filters :][owner] * (top == most[owner])
            g_top = (g_top * (top > 0)).astype(np.float32)
            rows = np.arange(len(codes))[:, None]
            g_filters = np.einsum("cfk,cf->kf", x, g_top)
            g_seen = (g_top[:, :, None] * net.filters.T).reshape(-1, shape.dim)
            which = codes[rows[:, :, None], at[:, :, None] * shape.stride + np.arange(shape.width)].ravel()
            g_embed = np.stack([np.bincount(which, g_seen[:, k], shape.symbols) for k in range(shape.dim)], 1)
            grads = [g_embed, g_filters + DECAY * net.filters, g_top.sum(0), feats.T @ error + DECAY * net.out]
            t += 1
            fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, mi, vi in zip(parts, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= (step * fix * mi / (np.sqrt(vi) + 1e-8)).astype(np.float32)
            mb += 0.1 * (error.sum() - mb)
            vb += 0.001 * (error.sum() ** 2 - vb)
            net.base -= float(step * fix * mb / (np.sqrt(vb) + 1e-8))
    return net
