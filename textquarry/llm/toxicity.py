"""Toxicity: a learned lexicon, found through misspellings, and scores of each hit's context.

The lexicon comes from counts over a bounded sample of the labelled rows that may be learned from (the SAMPLE first ones by
hash of the id): terms that stand in toxic documents far more often than elsewhere, and stems, for languages that toxic words are
derived in: beginnings that several different words of a toxic document share. Terms and stems share one trie, in which a stem accepts
any token that begins with it; terms that do so are left to their stem. The trie is walked together with a Levenshtein automaton for each distinct token, so a term is
found at one edit (two from eight letters on). A stem must stand whole, as the words derived from it vary behind it.

A hit counts 1 if the term stands as it is, otherwise its confidence: how likely a token near that term is the term misspelt and not a
chance neighbour. It comes from the sample: toxic documents that hold such tokens, and as many more as if MISSPELT of the term's uses
were misspelt, against the different tokens near it elsewhere. Those that the sample knows as everyday words count nothing themselves.
Each hit is weighed by its window: hits inside quotation marks are summed apart from the plain ones and get a weight of their own, QUOTED of
the other's unless the sample says otherwise. The sums go into a logistic model fitted on the same sample whose weights are at or above zero, that of quoted hits at most that of plain
ones; so a misspelt term never lowers a score, and quotation never raises it above plain use. Every text is scored whole.

Null and empty texts have no hits and get the score of a text without any. Null labels are left out, repeated ones count
again; without labels every score is 0.5. Of terms equally near to a token the first by spelling counts; equal texts get equal scores. An
empty table gives an empty result. Only id and text of the table are read; where it has columns score or predicted, these stay and the new ones get a name with underscores behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, id_remainder, settle, table, whole_text

#: A term has this many characters at least; two edits are allowed from LONG on.
SHORTEST, LONG = 4, 8
#: Terms: standing in this many toxic documents at least, and this part of those that hold them is toxic.
LEAST_DOCS, PRECISION = 5, 0.8
#: Letters that a learned stem may have.
STEMS = (5, 6, 7, 8)
#: Its contexts: as many as this part of its toxic documents, or of the contexts that the most varied term has.
DIVERSE, FREQUENT = 0.4, 0.25
#: Labelled documents that lexicon and model are fitted on.
SAMPLE = 20_000
#: Tokens on either side that are looked at.
SPAN = 6
#: A token near a term is an everyday word if this many sample documents hold it, and less than this part of them is toxic.
KNOWN, EVERYDAY = 2, 0.5
#: What a quoted hit counts of a plain one before the sample says otherwise.
QUOTED = 0.4
#: The part of a term's uses that is taken to be misspelt before any is seen.
MISSPELT = 0.05
EDGES = ".,;:!?()[]{}<>|/\\#$%&*+=~^_-\"'`´‘’‚“”„«»‹›…"
QUOTES = frozenset("\"“”„«»‹›")
#: Distinct tokens a worker remembers the verdict on.
REMEMBERED = 1_000_000


class Lexicon:
    """A trie of terms, walked with rows of the edit-distance table as automaton states.

    A term within one edit keeps its first or its second half whole, one within two edits a third; tokens that have no
    such part where it could stand are not walked at all.
    """

    def __init__(self, terms, stems=()):
        self.terms, self.stems = frozenset(terms), frozenset(stems)
        self.everyday: frozenset[str] = frozenset()
        self.confidence: dict[str, float] = {}
        self.root: dict = {}
        for stem in self.stems:
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node["*"] = stem
        self.heads, self.tails, self.middles = {}, {}, {}
        for term in self.terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            edits = self.allowed(len(term))
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            for i in range(edits + 1):
                part = term[cuts[i] : cuts[i + 1]]
                (self.heads if i == 0 else self.tails if i == edits else self.middles).setdefault(len(part), set()).add(part)
        sizes = [len(t) for t in self.terms] or [0]
        self.shortest, self.longest = min(sizes) - self.allowed(min(sizes)), max(sizes) + self.allowed(max(sizes))

    @staticmethod
    def allowed(size: int) -> int:
        return 2 if size >= LONG else 1

    def stem(self, token: str) -> str | None:
        """The shortest stem that the token begins with."""
        node = self.root
        for c in token:
            if "*" in node:
                return node["*"]
            node = node.get(c)
            if node is None or c == "*":
                return None
        return node.get("*")

    def weight(self, token: str, found) -> float:
        """What a hit counts."""
        if found[1] == 0:
            return 1.0
        return 0.0 if token in self.everyday else self.confidence.get(found[0], 1.0)

    def worth_it(self, token: str) -> bool:
        if any(token[:k] in parts for k, parts in self.heads.items()) or any(token[-k:] in parts for k, parts in self.tails.items()):
            return True
        return len(token) >= LONG - 2 and any(token[i : i + k] in parts for k, parts in self.middles.items() for i in range(len(token) - k + 1))

    def find(self, token: str):
        """(term, distance) of the nearest term in reach, or None; ties by the term."""
        if token in self.terms:
            return token, 0
        if not self.terms or not self.shortest <= len(token) <= self.longest or not self.worth_it(token):
            return None
        best = None
        n = len(token)
        # A state: the entries within two edits of the automaton's row for the letters so far.
        stack = [(self.root, {j: j for j in range(min(2, n) + 1)})]
        while stack:
            node, row = stack.pop()
            for c, below in node.items():
                if c == "*":  # a stem, which stem() finds
                    continue
                if c == "":
                    d = row.get(n, 9)
                    if d <= self.allowed(len(below)) and (best is None or (d, below) < (best[1], best[0])):
                        best = (below, d)
                    continue
                after: dict[int, int] = {}
                for j, d in row.items():
                    if d < 2 and d + 1 < after.get(j, 9):
                        after[j] = d + 1
                    if j < n:
                        cost = d + (token[j] != c)
                        if cost <= 2 and cost < after.get(j + 1, 9):
                            after[j + 1] = cost
                if after:
                    for j in range(min(after), n):  # letters of the token that the term lacks
                        if after.get(j, 9) + 1 < min(3, after.get(j + 1, 9)):
                            after[j + 1] = after[j] + 1
                    stack.append((below, after))
        return best


#: What the logistic model sees of a document.
FEATURES = ("plain", "quoted", "crowded", "dense", "stems")


class Reader:
    """Turns texts into hits and features; remembers verdicts on tokens within a bound."""

    def __init__(self, lexicon: Lexicon, learning: bool = False):
        self.lexicon, self.learning, self.seen, self.hits, self.stemmed = lexicon, learning, set(), {}, {}

    def judged(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that are hits; learning: also those that count nothing."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.hits.clear()
            self.stemmed.clear()
        for raw in tokens - self.seen:
            token = raw.strip(EDGES) if len(raw) >= SHORTEST - 1 else ""
            if token and (found := self.lexicon.find(token)):
                weight = self.lexicon.weight(token, found)
                if weight or self.learning:
                    self.hits[raw] = token, weight
            elif token and self.lexicon.stem(token):
                self.stemmed[raw] = token
        self.seen |= tokens
        return tokens & self.hits.keys()

    def read(self, text: str | None) -> tuple:
        """How many tokens; how many derived from stems; place, bare token and quotation of each hit."""
        tokens = (text or "").lower().split()
        distinct = set(tokens)
        mine = self.judged(distinct)
        stems = len({self.stemmed[t] for t in distinct & self.stemmed.keys()})
        places = [i for i, x in enumerate(tokens) if x in mine] if mine else []
        return len(tokens), stems, places, [self.hits[tokens[i]][0] for i in places], [self.quoted(tokens, i) for i in places]

    def features(self, text: str | None) -> list[float]:
        size, stems, places, words, quoted = self.read(text)
        return features(size, stems, places, [self.lexicon.weight(w, self.lexicon.find(w)) for w in words], quoted)

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """Quotation marks open before the token and close after it, within the window."""
        before, after = "".join(tokens[max(0, i - SPAN) : i]), "".join(tokens[i + 1 : i + 1 + SPAN])
        own = tokens[i]
        opens = own[0] in QUOTES or sum(c in QUOTES for c in before) % 2 == 1
        closes = own.rstrip(".,;:!?")[-1:] in QUOTES or any(c in QUOTES for c in after)
        return opens and closes


def features(size: int, stems: int, places, weights, quoted) -> list[float]:
    """FEATURES of a document."""
    plain = sum(w for w, q in zip(weights, quoted, strict=True) if not q)
    cited = sum(w for w, q in zip(weights, quoted, strict=True) if q)
    near = [(places[n] - places[n - 1] <= SPAN) * w for n, w in enumerate(weights) if n]
    return [float(np.log1p(plain)), float(np.log1p(cited)), float(np.log1p(sum(near))), min(1.0, 20 * (plain + stems) / max(1, size)), float(np.log1p(stems))]


def learned_terms(marked: DataFrame) -> list[str]:
    """Terms that mark toxic documents, by counts over the labelled documents (text, mark) of the sample.

    Copies of one document would make any word of it look toxic, so a term must also stand in many different contexts
    (its neighbours where it first stands in a document): in DIVERSE of the documents, or FREQUENT of the best term's.
    """
    tokens = F.array_distinct(F.transform(F.split(F.lower(whole_text()), r"\s+"), lambda t: F.btrim(t, F.lit(EDGES))))
    each = marked.select("mark", F.explode(tokens).alias("term")).where(F.length("term") >= SHORTEST)
    counts = each.groupBy("term").agg(F.sum("mark").alias("bad"), F.count(F.lit(1)).alias("all"))
    likely = counts.where((F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= PRECISION * F.col("all"))).select("term", "bad")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = set()
            for text in rows["text"]:
                tokens = ["", *(t.strip(EDGES) for t in (text or "").lower().split()), ""]
                first = {}
                for i, t in enumerate(tokens):
                    if len(t) >= SHORTEST:
                        first.setdefault(t, i)
                out |= {(t, f"{tokens[i - 1]} {tokens[i + 1]}") for t, i in first.items()}
            yield pd.DataFrame(sorted(out), columns=["term", "context"])

    spread = marked.where("mark = 1").select("text").mapInPandas(contexts, "term string, context string").groupBy("term").agg(F.countDistinct("context").alias("n"))
    return [r["term"] for r in varied(likely.join(spread, "term"), "terms").orderBy("term").collect()]


def varied(counted: DataFrame, label: str) -> DataFrame:
    """Those of the counted (bad, n) that have contexts enough. Nothing is cut before this test, as words of copied documents would push out others, nor after it."""
    counted = settle(counted.where(F.col("n") >= LEAST_DOCS), label)
    most = counted.agg(F.max("n")).first()[0] or 0
    return counted.where((F.col("n") >= DIVERSE * F.col("bad")) | (F.col("n") >= FREQUENT * most))


def learned_stems(marked: DataFrame) -> list[str]:
    """Beginnings of words, such that a document with two different words that begin so is toxic; chosen as terms are, with the words as context."""

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, mark in zip(rows["text"], rows["mark"], strict=True):
                words: dict[str, list[str]] = {}
                for w in {t.strip(EDGES) for t in (text or "").lower().split()}:
                    for k in STEMS:
                        if len(w) >= k:
                            words.setdefault(w[:k], []).append(w)
                out += [(p, mark, " ".join(sorted(ws))) for p, ws in words.items() if len(ws) > 1]
            yield pd.DataFrame(out, columns=["stem", "mark", "words"])

    each = marked.mapInPandas(beginnings, "stem string, mark int, words string")
    counts = each.groupBy("stem").agg(F.sum("mark").alias("bad"), F.count(F.lit(1)).alias("all"), F.countDistinct(F.when(F.col("mark") == 1, F.col("words"))).alias("n"))
    kept = varied(counts.where((F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= PRECISION * F.col("all"))), "stems")
    good = sorted(sorted(r["stem"] for r in kept.select("stem").collect()), key=len)
    return [s for i, s in enumerate(good) if not any(s.startswith(o) for o in good[:i])]


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable=None) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the weights of FEATURES with the constant last."""
    usable = id_remainder(5) != 0 if usable is None else usable
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("mark")).where(usable & F.col("mark").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(SAMPLE)
    marked = settle(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "mark"), "labelled")
    if marked.isEmpty():
        return Lexicon([]), np.zeros(len(FEATURES) + 1)
    stems = learned_stems(marked)
    lexicon = Lexicon([t for t in learned_terms(marked) if not t.startswith(tuple(stems))], stems)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon, learning=True)
        for rows in batches:
            yield pd.DataFrame([[m, *reader.read(t)] for t, m in zip(rows["text"], rows["mark"], strict=True)], columns=["mark", "size", "stems", "places", "words", "quoted"])

    hits = settle(marked.mapInPandas(read, "mark int, size long, stems long, places array<int>, words array<string>, quoted array<boolean>"), "toxic-hits")
    words = hits.select("mark", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("mark").alias("bad"), F.count(F.lit(1)).alias("all"))
    trust(lexicon, [(r["word"], r["bad"], r["all"]) for r in words.collect()])  # words near a term in at most SAMPLE documents

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for mark, size, stems, *found in zip(*(rows[c] for c in ("mark", "size", "stems", "places", "words", "quoted")), strict=True):
                each = [(p, w, q) for p, word, q in zip(*found, strict=True) if (w := lexicon.weight(word, lexicon.find(word)))]
                out.append([mark, *features(size, stems, [x[0] for x in each], [x[1] for x in each], [x[2] for x in each])])
            yield pd.DataFrame(out, columns=["mark", *FEATURES])

    got = hits.mapInPandas(weigh, "mark int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()  # at most SAMPLE rows
    got = got.sort_values(["mark", *FEATURES])
    return lexicon, settled_weights(got[list(FEATURES)].to_numpy(), got["mark"].to_numpy(float))


def trust(lexicon: Lexicon, words: list[tuple[str, int, int]]) -> None:
    """Everyday words near terms, and each term's confidence, from (word, toxic documents, documents) of the sample."""
    found = [(w, bad, every, *near) for w, bad, every in sorted(words) if (near := lexicon.find(w))]
    lexicon.everyday = frozenset(w for w, bad, every, _, d in found if d and every >= KNOWN and bad < EVERYDAY * every)
    for term in lexicon.terms:
        near = [(w, bad, every) for w, bad, every, t, d in found if t == term and d]
        meant = MISSPELT * sum(bad for _, bad, _, t, d in found if t == term and not d) + sum(bad for w, bad, _ in near if w not in lexicon.everyday)
        lexicon.confidence[term] = meant / max(1e-9, meant + sum(bad < every for _, bad, every in near))


def settled_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression whose weights are at or above zero: those that come out below leave, the lowest first.

    The weight of quoted hits is learned as a distance from QUOTED of the plain ones' weight, and lies between zero and that weight.
    """
    x = np.c_[x[:, 0] + QUOTED * x[:, 1], x[:, 1:]]
    use, w = list(range(x.shape[1])), np.zeros(x.shape[1] + 1)
    while True:
        w[:] = 0
        w[[*use, -1]] = newton(x[:, use], y)
        bound = [k for k in use if k != 1 and w[k] < 0]
        if not bound:
            break
        use.remove(min(bound, key=lambda k: w[k]))
    w[1] = min(max(0.0, QUOTED * w[0] + w[1]), w[0])
    return w


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression; the ridge spares the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def scorer(lexicon: Lexicon, weights: np.ndarray):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts in batches:
            x = np.array([reader.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return score


def with_toxicity(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """docs and the columns score, predicted."""
    score = free_name(docs, "score")
    return docs.withColumn(score, scorer(lexicon, weights)("text")).withColumn(free_name(docs, "predicted"), (F.col(score) >= threshold).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon, weights = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs.select("doc_id", "text"), lexicon, weights).select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")
