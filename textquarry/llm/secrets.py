"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

The patterns find the base spans, which always stay. Candidates are all runs of 12 or more characters that a pattern's value may
have, the base spans' values among them, and the values of matches that a pattern drops as too short. A small network sees each
with the text around it, long values by overlapping windows whose features are pooled. Every base span thus gets a probability; any
other candidate that passes the threshold is added as kind `learned`, unless a base span holds it whole.

The network is trained on labelled findings: candidates from a bounded sample of documents, labelled by whether a
pattern found them, half of them with their context blanked so that the shape of the value counts too. The patterns know three kinds
only, so each value they find is also learned respelt: another random text of its alphabet or a wider one, with or without a prefix; and
words of the same document joined by the signs that values hold (as in paths and names) are learned as none. Half of the findings train
it, a quarter calibrates its outputs, and on the last quarter the threshold is the highest one that still recalls RECALL of the findings,
also where that is a low one; recall and precision there are kept.

Null and empty texts have no spans. Places are code points, ends exclusive. Rows are scanned one by one, so repeated rows repeat their
result, and equal findings with different labels count once for each; an empty table gives an empty result; without findings to learn
from nothing is added and probabilities are null. A column named secrets stays, and the new one gets a name with underscores behind.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .convnet import Net, Shape, learn, sigmoid
from .shared import free_name, table

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run is maximal, so asking for its least length at once finds the same runs as finding all and dropping the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: What respelt values are drawn from, and words that are joined (of so many characters of a text that holds a finding).
ALPHABETS = ("0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_-")
WORDS, JOINED_FROM = re.compile(r"[A-Za-z]{2,}"), 20_000
ACCESS_ANY = re.compile(r"AKIA[A-Z0-9]+")

#: What the network sees: context before, HEAD + TAIL characters of the value, context after; longer values by windows that overlap by half.
BEFORE, HEAD, TAIL, AFTER = 24, 32, 12, 12
SHAPE = Shape(symbols=129, width=5, stride=1, dim=8, filters=16)
EPOCHS, SEED, RECALL = 6, 11, 0.98
#: Documents and findings learned from, at most (documents: on average).
SAMPLE_DOCS, SAMPLE_FINDINGS = 20_000, 4000

#: Windows and values scored at once.
BLOCK = 4096

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_of(text: str, span: Span) -> tuple[int, int]:
    """Where the value of a base span stands."""
    m = ASSIGN.match(text, span[0]) if span[1] == 0 else None
    return m.span(2) if m else (span[0], span[2])


def dropped(text: str) -> list[tuple[int, int]]:
    """The values of matches that a pattern drops as too short."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < ASSIGN_LEAST]
    if "AKIA" in text:
        out += [m.span() for m in ACCESS_ANY.finditer(text) if m.end() - m.start() < 18]
    return out


def candidates(text: str, found: list[Span], apart: bool = False) -> list[tuple[int, int]]:
    """Runs and dropped values that no base span holds whole; apart: that none touches."""
    cover: list[list[int]] = []  # the union of the base spans
    for a, _, b in sorted(found):
        if cover and a < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    starts, holds = [c[0] for c in cover], sorted((a, -b) for a, _, b in found)
    ends, most = [], -1
    for _, b in holds:
        most = max(most, -b)
        ends.append(most)  # the furthest end of the spans that start here or before
    firsts, out = [a for a, _ in holds], set()
    for a, b in [*(m.span() for m in CANDIDATE.finditer(text)), *dropped(text)]:
        k = bisect_right(starts, b - 1) - 1
        i = bisect_right(firsts, a) - 1
        if not (k >= 0 and cover[k][1] > a) if apart else not (i >= 0 and ends[i] >= b):
            out.add((a, b))
    return sorted(out)


def codes(text: str, a: int, b: int) -> np.ndarray:
    """The characters that the network sees, as codes: ASCII, 127 for others, 128 for none."""

    def fixed(part: str, size: int, right: bool = False) -> str:
        return part.rjust(size, "\x80") if right else part.ljust(size, "\x80")

    before, after = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
    value = text[a:b]
    seen = fixed(before, BEFORE, True) + fixed(value[:HEAD], HEAD) + fixed(value[HEAD:][-TAIL:], TAIL) + fixed(after, AFTER)
    points = np.frombuffer(seen.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points == 0x80, 128, np.minimum(points, 127)).astype(np.int16)


def windows(text: str, a: int, b: int, blank: bool = False) -> np.ndarray:
    """(n, characters) codes that together show every character of the value."""
    if blank:
        text, a, b = text[a:b], 0, b - a
    size = HEAD + TAIL
    starts = [*range(a, b - size, size // 2), max(a, b - size)]
    return np.stack([codes(text, s, min(b, s + size)) for s in starts])


def respelt(value: str, r: random.Random) -> str:
    """A random text as long as the value, in its alphabet or a wider one; sometimes behind a short name."""
    alphabet = r.choice(ALPHABETS[0 if HEX.fullmatch(value) else 1 :])
    name = r.choice(["", "", "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 6))) + r.choice("_-.")])
    return name + "".join(r.choice(alphabet) for _ in range(max(14, min(len(value), 60))))


def joined(words: list[str], r: random.Random) -> str:
    """Words, numbers among them, joined as in paths, names, dates."""
    sign = r.choice("/_-.=+")
    part = [r.choice(words) if r.random() < 0.8 else str(r.randrange(10 ** r.randint(1, 4))) for _ in range(r.randint(2, 6))]
    return sign.join(part) if r.random() < 0.8 else "".join(w.capitalize() for w in part)


def findings(batches: Iterator[pd.DataFrame], leave_out: int | None = None) -> Iterator[pd.DataFrame]:
    """Labelled findings (draw, mark, codes): pattern values and their respellings, candidates apart from them and joined words; leave_out: a kind that isn't learned."""
    for rows in batches:
        out = []

        def add(text: str, a: int, b: int, mark: int, blank: bool) -> None:
            seen = windows(text, a, b, blank).tobytes()
            out.append((hashlib.md5(seen).hexdigest(), mark, seen))

        for text in rows["text"]:
            text = text or ""
            found = base_spans(text)
            r = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
            words = WORDS.findall(text[:JOINED_FROM]) if found else []
            for n, span in enumerate(x for x in found if x[1] != leave_out):
                a, b = value_of(text, span)
                add(text, a, b, 1, n % 2 == 1)
                new = respelt(text[a:b], r)
                add(text[:a] + new + text[b:], a, a + len(new), 1, n % 2 == 0)
                if words:
                    new = joined(words, r)
                    add(text[: span[0]] + new + text[b:], span[0], span[0] + len(new), 0, r.random() < 0.5)
            for n, (a, b) in enumerate(candidates(text, found, apart=True)):
                add(text, a, b, 0, n % 2 == 1)
        yield pd.DataFrame(out, columns=["draw", "mark", "codes"])


class Detector:
    """The network, its calibration (scale, shift), the threshold on calibrated scores, and recall and precision on held findings."""

    recall = precision = float("nan")

    def __init__(self, net: Net | None, scale: float = 1.0, shift: float = 0.0, threshold: float = 2.0):
        self.net, self.scale, self.shift, self.threshold = net, scale, shift, threshold

    def raw(self, values: list[np.ndarray]) -> np.ndarray:
        """values: the windows of each."""
        n = np.array([len(v) for v in values])
        every = np.concatenate(values)
        top = np.concatenate([self.net.pooled(every[k : k + BLOCK]) for k in range(0, len(every), BLOCK)])
        starts = np.cumsum(n) - n
        p = np.clip(self.net.combine(np.add.reduceat(top, starts) / n[:, None], np.maximum.reduceat(top, starts)), 1e-9, 1 - 1e-9)
        return np.log(p / (1 - p))

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.scale * self.raw(x) + self.shift)


def fit_detector(docs: DataFrame, leave_out: int | None = None) -> Detector:
    """Learns from up to SAMPLE_FINDINGS findings of each label."""
    count = docs.count()
    rate = min(1.0, SAMPLE_DOCS / max(1, count))
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    found = drawn.mapInPandas(lambda it: findings(it, leave_out), "draw string, mark int, codes binary").dropDuplicates(["draw", "mark"])
    rows = pd.concat([found.where(F.col("mark") == k).orderBy("draw").limit(SAMPLE_FINDINGS).toPandas() for k in (0, 1)])  # bounded
    rows = rows.sort_values(["draw", "mark"])
    if rows["mark"].nunique() < 2:
        return Detector(None)
    x = [np.frombuffer(c, np.int16).reshape(-1, BEFORE + HEAD + TAIL + AFTER) for c in rows["codes"]]
    y = rows["mark"].to_numpy(np.float32)
    part = np.arange(len(x)) % 4  # 0 and 1 train, 2 calibrates, 3 sets the threshold
    if any(len(np.unique(y[own])) < 2 for own in (part < 2, part == 2, part == 3)):
        return Detector(None)

    def of(own: np.ndarray) -> list[np.ndarray]:
        return [c for c, mine in zip(x, own, strict=True) if mine]

    detector = Detector(learn(SHAPE, of(part < 2), y[part < 2], EPOCHS, SEED))
    detector.scale, detector.shift = calibrated(detector.raw(of(part == 2)), y[part == 2])
    settle_threshold(detector, detector.score(of(part == 3)), y[part == 3])
    return detector


def settle_threshold(detector: Detector, p: np.ndarray, y: np.ndarray) -> None:
    """The highest threshold that recalls RECALL of the held findings, and what it gives on them."""
    good = np.sort(p[y == 1])
    detector.threshold = float(good[int(np.floor((1 - RECALL) * len(good)))])
    said = p >= detector.threshold
    detector.recall, detector.precision = float(said[y == 1].mean()), float(y[said].mean())


def calibrated(raw: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Platt's scaling with his smoothed targets, by Newton steps on a loss that also draws the scale to 1 and the shift to 0, so that findings apart don't make it run off."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, start = np.c_[raw, np.ones(len(raw))], np.array([1.0, 0.0])
    w = start.copy()
    for _ in range(100):
        p = sigmoid(x @ w)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - t) + ridge * (w - start))
        w -= move / max(1.0, 2 * np.abs(move).max())
    return float(max(w[0], 1e-3)), float(w[1])


def recall_of_unlearned(docs: DataFrame, kind: int) -> tuple[float, int]:
    """The part of a pattern's values that a detector finds which never learned that pattern, and how many there are (up to the bound of the sample)."""
    detector, rate = fit_detector(docs, leave_out=kind), min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    texts = [r["text"] or "" for r in docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(rate * (1 << 40))).where(F.col("text").rlike(["(?i)passw|secret|token|api_?key", "AKIA", "[0-9a-f]{16}"][kind])).collect()]
    seen = [windows(t, *value_of(t, s)) for t in texts for s in base_spans(t) if s[1] == kind]
    if detector.net is None or not seen:
        return float("nan"), len(seen)
    return float((detector.score(seen) >= detector.threshold).mean()), len(seen)


Scored = tuple[int, int, int, float | None]  # start, kind, end, probability


def scanned(texts, detector: Detector) -> list[tuple[list[Span], list[Scored]]]:
    """(base, all with probabilities) spans of each text; the candidates of all texts are scored together."""
    found = [base_spans(t or "") for t in texts]
    if detector.net is None:
        return [(f, [(*s, None) for s in f]) for f in found]
    every: list[list[Scored]] = [[] for _ in found]
    asked = [(i, span, value_of(texts[i], span)) for i, f in enumerate(found) for span in f]
    asked += [(i, None, at) for i, t in enumerate(texts) for at in candidates(t or "", found[i])]
    for k in range(0, len(asked), BLOCK):
        part = asked[k : k + BLOCK]
        for (i, span, at), p in zip(part, detector.score([windows(texts[i], *at) for i, _, at in part]), strict=True):
            if span:
                every[i].append((*span, float(p)))
            elif p >= detector.threshold:
                every[i].append((at[0], 3, at[1], float(p)))
    return [(f, sorted(e)) for f, e in zip(found, every, strict=True)]


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, probabilities string"


def with_secrets(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs and the column `secrets`, a struct of SCHEMA; probabilities stand in the order of spans."""

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for base, every in scanned(texts.tolist(), detector):
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            said = None if detector.net is None else ",".join(f"{p:.4f}" for *_, p in every)
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), said))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "probabilities"])

    return docs.withColumn(free_name(docs, "secrets"), scan("text"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_secrets(docs, fit_detector(docs)).select("doc_id", "secrets.*")
