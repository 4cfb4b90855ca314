"""Unicode steps that Spark has no built-in for, as Arrow UDFs that only see the rows that need them."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Few ranges, as Java tries them one by one: text of these characters alone is in NFC (the test says so of each).
SETTLED = "\\x00-\\u02ff\\u0400-\\u0482\\u048a-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf"
#: Bytes of texts that are Python strings at once; a batch of Arrow may hold 10,000 long texts.
SLICE = 1 << 20
#: Characters whose case folding is their lower case, wherever they stand; sharp s is among them, as casefold() replaces it.
FOLDS_TO_LOWER = "\\x00-\\u00b4\\u00b6-\\u012f\\u0131-\\u0148\\u014a-\\u017e\\u0400-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf"


def char_class(wanted: Callable[[str], bool]) -> str:
    """A Java character class (without brackets) of the code points for which `wanted` holds, as ranges."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and wanted(chr(c))]
    out, a = [], 0
    while a < len(points):
        b = a
        while b + 1 < len(points) and points[b + 1] == points[b] + 1:
            b += 1
        out.append(f"\\x{{{points[a]:x}}}-\\x{{{points[b]:x}}}")
        a = b + 1
    return "".join(out)


@cache
def digit_class() -> str:
    """Decimal digits and the other characters that count as digits (superscripts, circled digits, ...)."""
    return r"\p{Nd}" + char_class(lambda c: c.isdigit() and unicodedata.category(c) != "Nd")


def _mapped(function: Callable[[str], object], kind: str):
    @F.pandas_udf(kind)
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return udf


def in_slices(texts: pa.Array, function: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """function over SLICE bytes of texts at a time (a longer text by itself), joined."""
    step, at, done = max(1, int(len(texts) * min(1.0, SLICE / max(1, texts.nbytes)))), 0, []
    while at < len(texts) or not done:
        done.append(function(texts.slice(at, step).to_pylist()))
        at += step
    return pa.concat_arrays(done)


def _respelt(function: Callable[[str], str]):
    @F.arrow_udf("string")
    def udf(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: pa.array([None if t is None else function(t) for t in part], pa.string()))

    return udf


def beyond(text: Column, kinds: str) -> Column:
    """Whether the text holds a character outside a class (without brackets). One greedy run of the class is far quicker than a search for its negation."""
    return ~text.rlike(f"\\A[{kinds}]*+\\z")


def nfc(text: Column) -> Column:
    """Normalisation form C; text that is in it for certain stays in the JVM."""
    return F.coalesce(_respelt(lambda t: unicodedata.normalize("NFC", t))(F.when(beyond(text, SETTLED), text)), text)


def casefold(text: Column) -> Column:
    """Full case folding; only text with special characters leaves the JVM."""
    return F.coalesce(_respelt(str.casefold)(F.when(beyond(text, FOLDS_TO_LOWER), text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def stable_score(seed: int, scope: str | Column, key: Column) -> Column:
    """Eight BLAKE2b bytes of "seed|scope|key": binary order is the order of the unsigned number."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return _mapped(lambda s: hashlib.blake2b(s.encode(), digest_size=8).digest(), "binary")(F.concat_ws("|", F.lit(str(seed)), scope, key.cast("string")))


def char_counts(text: Column, spaces: bool = False) -> Column:
    """map<string, long>: how often each reportable character stands in the text (beyond ASCII and, unless spaces are asked for, no white space; or control, format, private)."""

    def count(t: str) -> dict[str, int]:
        return {c: t.count(c) for c in set(t) if (ord(c) > 127 and (spaces or not c.isspace())) or unicodedata.category(c) in ("Cc", "Cf", "Co")}

    return _mapped(count, "map<string,long>")(text)


def char_names(char: Column) -> Column:
    """struct<codepoint, name, category> of single characters; meant for distinct ones."""

    @F.pandas_udf("codepoint string, name string, category string")
    def udf(chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(f"U+{ord(c):04X}", unicodedata.name(c, ""), unicodedata.category(c)) for c in chars], columns=["codepoint", "name", "category"])

    return udf(char)


# What stands between the parts of an excerpt, the shares of its head and tail, and the room kept for the marks.
FOCUS_MARK, TAIL_MARK = "\n\n[...FOCUS AROUND LONGEST TOKEN / MIDDLE...]\n\n", "\n\n[...TAIL...]\n\n"
HEAD_SHARE, TAIL_SHARE, MARK_ROOM = 3, 4, 80


def middle_of_longest(text: str) -> int:
    """Where the middle of the first longest token stands; the middle of a text without tokens."""
    lengths = [len(p) for p in re.split(r"(\s+)", text)]  # tokens at even places, white space between them
    at = int(np.argmax(lengths[::2])) * 2
    return sum(lengths[:at]) + lengths[at] // 2 if lengths[at] else len(text) // 2


def excerpt(text: str, most: int) -> str:
    """A text of at most `most` characters as it is; else its head, what surrounds its longest token, and its tail."""
    text = "\n".join(text.replace("\r\n", "\n").split("\r"))
    if len(text) <= most:
        return text
    head, tail = text[: most // HEAD_SHARE], text[len(text) - most // TAIL_SHARE :]
    room = max(0, most - len(head) - len(tail) - MARK_ROOM)
    begin = max(0, middle_of_longest(text) - room // 2)
    return FOCUS_MARK.join([head, TAIL_MARK.join([text[begin : begin + room], tail])])


def smart_excerpt(text: Column, most: int) -> Column:
    return _respelt(lambda t: excerpt(t, most))(text)


TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]{0,2000}>", re.IGNORECASE | re.DOTALL)
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
TABLE = re.compile(r"\{\|.*?\|\}", re.DOTALL)
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
OUTER_LINK = re.compile(r"\[(?:https?:)?//\S+\s*([^\]]*)\]")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(raw: str) -> tuple[str, int, int, int]:
    """Text without wiki and HTML markup, and the templates, tags and links that were found. An approximation of a full parser."""
    text, templates = raw, 0
    while True:
        text, n = TEMPLATE.subn("", text)
        templates += n
        if not n:
            break
    text = TABLE.sub("", text)
    text, links = LINK.subn(r"\1", text)
    text = OUTER_LINK.sub(r"\1", text)
    text, tags = TAGS.subn(" ", text)
    text = re.sub(r"'{2,5}", "", re.sub(r"(?m)^\s*=+\s*(.*?)\s*=+\s*$", r"\1", text))
    for entity, char in ENTITIES.items():
        text = text.replace(entity, char)
    return unicodedata.normalize("NFC", re.sub("\r\n?", "\n", text)).strip(), templates, tags, links


def strip_markup(raw: Column) -> Column:
    """struct<text, ast_templates, ast_tags, ast_links> of raw markup; null for null."""

    def strip(part: list[str | None]) -> pa.Array:
        columns = zip(*[(None,) * 4 if t is None else plain_text(t) for t in part], strict=True) if part else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=["text", "ast_templates", "ast_tags", "ast_links"])

    @F.arrow_udf("text string, ast_templates long, ast_tags long, ast_links long")
    def udf(texts: pa.Array) -> pa.Array:
        return in_slices(texts, strip)

    return udf(raw)
