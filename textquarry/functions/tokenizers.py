"""Token counts of texts under public vocabularies: whole texts, boundary tokens included, nothing truncated."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The encoders that units must fit, their limits, and what the first one puts before a text.
E5_MOST, BGE_MOST = 512, 8192
E5_DOCUMENT, E5_QUERY = "passage: ", "query: "


@dataclass(frozen=True)
class TokenCounter:
    """A vocabulary file, by name; kind is that of the file (sentencepiece, tokenizers). A sentencepiece text has two boundary tokens; other files say themselves what they add."""

    name: str
    path: str
    most: int
    kind: str = "sentencepiece"
    before_document: str = ""
    before_query: str = ""

    def count(self, text: Column, document: bool = True) -> Column:
        """How many tokens the text has; null for null."""
        path, kind, before = self.path, self.kind, self.before_document if document else self.before_query

        @F.pandas_udf("long")
        def counted(texts: pd.Series) -> pd.Series:
            many = iter(lengths(path, kind, [before + t for t in texts if t is not None]))
            return pd.Series([None if t is None else next(many) for t in texts], dtype="Int64")

        return counted(text)


@cache
def loaded(path: str, kind: str):
    """One for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "sentencepiece":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words whose pieces a worker remembers at once.
MOST_WORDS = 500_000
#: What a model may keep as pieces beyond words: spaces in a row and at the ends, wider spaces, its own mark of a space. Such texts are encoded whole.
WHOLE = re.compile("  |^ | $|^$|[\u2581\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Other texts, which a model must cut as it cuts their words: line breaks and tabs, marks, unknown characters.
PROBES = ("a b", "a\nb\t c", "a\n b", "a\n\n b \t\t c", "a \n b", "x \u0301y z", "\u00b4 \u00b4a", "\U0001f600 \U0001f601\U0001f602 \ue000 \ue000", "don't stop: 12,5 %", "a \u200b b", "\uac00 \u1100\u1161 \u1161", "\x00 a\x07 b")


@cache
def by_words(path: str) -> bool:
    """Whether a sentencepiece model's pieces never go beyond a space, so that a text has the pieces of its words: none holds an inner space mark, and the probes agree."""
    model = loaded(path, "sentencepiece")
    inner = any("\u2581" in model.id_to_piece(i).lstrip("\u2581") for i in range(model.get_piece_size()))
    return not inner and all(len(model.encode(t)) == sum(len(model.encode(w)) for w in t.split(" ")) for t in PROBES)


@cache
def known_words(path: str) -> dict[str, int]:
    """The pieces of words met so far; one for each worker process."""
    return {}


def pieces_of(path: str, text: str) -> int:
    """How many pieces a text has; a word that was met before isn't encoded again, and no text's ids are held but the one at hand."""
    model = loaded(path, "sentencepiece")
    if WHOLE.search(text) or not by_words(path):
        return len(model.encode(text))
    known, words = known_words(path), text.split(" ")
    if fresh := [w for w in set(words) if w not in known]:
        if len(known) > MOST_WORDS:
            known.clear()
            fresh = list(set(words))
        known.update(zip(fresh, map(len, model.encode(fresh, out_type=int, num_threads=1)), strict=True))
    return sum(map(known.__getitem__, words))


def lengths(path: str, kind: str, texts: list[str]) -> list[int]:
    if not texts:
        return []
    if kind == "sentencepiece":
        return [pieces_of(path, t) + 2 for t in texts]
    return [len(got.ids) for at in range(0, len(texts), 256) for got in loaded(path, kind).encode_batch_fast(texts[at : at + 256], add_special_tokens=True)]


def counters(e5_path: str | None, bge_path: str | None, skip: bool = False, kind: str = "sentencepiece") -> list[TokenCounter]:
    """The counters of a profile; none if they are to be skipped. A missing path is an error, as a profile without counts must be asked for."""
    if skip:
        return []
    if not e5_path or not bge_path:
        raise ValueError("a vocabulary file for each of e5 and bge_m3, or skip")
    return [TokenCounter("e5", e5_path, E5_MOST, kind, E5_DOCUMENT, E5_QUERY), TokenCounter("bge_m3", bge_path, BGE_MOST, kind)]
