"""Text functions as Column builders that stay inside the JVM (Unicode normalisation excepted)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import casefold, digit_class, nfc

# Patterns and character lists that results depend on.
SPACE = "\\t-\\r\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
OTHER_SPACE = SPACE.replace("\\x1c-\\x20", "\\x1c-\\x1f")
LATIN = "[A-Za-zÀ-ž]"
CYRILLIC = "[\\u0400-\\u04FF]"
APOSTROPHES = ("'", "’", "‘", "ʻ", "ʼ", "`", "´", "ʹ", "ʽ")
SENTENCE_END = "[.!?…]"
PARAGRAPH_BREAK = "\\n\\s*\\n"
LETTER_DIGIT = "(?iu)(?:[A-Za-zÀ-žʻʼ‘’'`][0-9]|[0-9][A-Za-zÀ-žʻʼ‘’'`])"
LETTER_DIGIT_CYRILLIC = "(?iu)(?:[A-Za-zÀ-žЀ-ӿʻʼ‘’'`][0-9]|[0-9][A-Za-zÀ-žЀ-ӿʻʼ‘’'`])"
LONG_DIGIT_RUN = "(?U)\\d{8,}"
WIKI_MARKUP = "(?iu)(?:\\blink=|\\bFayl:|upload\\.wikimedia|wikimedia\\.org|\\bframeless\\b|\\bthumb\\b|\\balt=|[0-9]{2,4}x[0-9]{2,4}px)"
WIKI_RESIDUE = "(?iu)(?:\\blink=|\\bFayl:|\\bFile:|\\bImage:|upload\\.wikimedia|wikimedia\\.org|\\bframeless\\b|\\bthumb\\b|\\balt=|[0-9]{2,4}x[0-9]{2,4}px)"
URL_MARKUP = "(?iu)(?:https?://|www\\.|%[0-9A-F]{2})"
URL = "(?iu)\\b(?:https?://|www\\.)\\S*"
#: Each match of the markup patterns holds one of these in lower case (the last three are an s and an i to patterns, not to lower case).
MARKUP_HINTS = ("link=", "fayl:", "file:", "image:", "wikimedia", "frameless", "thumb", "alt=", "px", "http", "www.", "%", "____", "＿", "ſ", "ı", "i̇")
REPEATED_DELIMITER = "(?:\\|{3,}|={4,}|-{6,}|_{8,}|\\.{6,})"

#: Characters of these general categories that Unicode 14 and 15 added: RE2 knows them, Java 17 doesn't.
ADDED = {
    "L": "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446 16a70-16abe 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af",
    "Nd": "11f50-11f59 16ac0-16ac9 1e4f0-1e4f9",
    "P": "61d 1b7d-1b7e 2e53-2e5d 10f86-10f89 116b9 11b00-11b09 11f43-11f4f 12ff1-12ff2",
    "S": "888 20c0 fbc2 fd40-fd4f fdcf fdfe-fdff 1cf50-1cfc3 1d1e9-1d1ea 1f6dc-1f6df 1f774-1f776 1f77b-1f77f 1f7d9 1f7f0 1f979 1f9cc 1fa75-1fa77 1fa7b-1fa7c 1fa87-1fa88 1faa9-1faaf 1fab7-1fabd 1fabf 1fac3-1fac5 1face-1facf 1fad7-1fadb 1fae0-1fae8 1faf0-1faf8",
}


def category(name: str) -> str:
    """A character class (without brackets) of a general category of Unicode 15. Characters below the first of those added fail at once."""
    ranges = [[f"\\x{{{x}}}" for x in part.split("-")] for part in ADDED[name].split()]
    return f"\\p{{{name}}}[{ranges[0][0]}-\\x{{10ffff}}&&[{''.join('-'.join(r) for r in ranges)}]]"


@dataclass(frozen=True)
class Classes:
    """The classes (without brackets) of characters that features count, and what is trimmed from lines."""

    space: str
    trimmed: str
    letter: str
    digit: str
    punct: str
    symbol: str
    control: str
    digit_run: str

    @classmethod
    def python(cls) -> Classes:
        return cls(SPACE, SPACE, "\\p{L}", digit_class(), "\\p{P}", "\\p{S}", "\\p{Cc}", LONG_DIGIT_RUN)

    @classmethod
    def sql(cls) -> Classes:
        """As DuckDB has them: RE2's white space, digits and controls are ASCII, and trim() takes space separators only."""
        return cls("\\t\\n\\f\\r ", "\\p{Zs}", category("L"), f"²³¹{category('Nd')}", category("P"), category("S"), "\\x00-\\x1f\\x7f", "[0-9]{8,}")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def chars_of(text: Column, kinds: str) -> Column:
    """How many characters are of a class (without brackets): what goes with its runs. Their negation is much slower where it has ranges."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{kinds}]+", ""))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def tokens(text: Column, space: str = SPACE) -> Column:
    """What stands between white space: Java tries the ranges of a negated class for each character, some twenty times as long as a cut at the class itself takes."""
    return F.array_remove(F.split(text, f"[{space}]+"), "")


def word_count(text: Column) -> Column:
    return F.array_size(tokens(text)).cast("long")


def trimmed(text: Column, space: str) -> Column:
    return F.regexp_replace(text, f"\\A[{space}]+|[{space}]+\\z", "")


def strip(text: Column) -> Column:
    return trimmed(text, SPACE)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f" [{SPACE}]+|[{OTHER_SPACE}][{SPACE}]*", " "))


def normalize_text(text: Column) -> Column:
    return squeeze(nfc(F.coalesce(text, F.lit(""))))


def exact_hash(text: Column) -> Column:
    """SHA-256 of the normalised, case-folded text."""
    return F.sha2(casefold(normalize_text(text)), 256)


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def layout_text(text: Column) -> Column:
    """NFC, one kind of line end, single spaces, stripped lines, at most one blank line between others."""
    lines = F.transform(F.split(line_endings(nfc(F.coalesce(text, F.lit("")))), "\\n"), lambda x: strip(F.regexp_replace(x, "[ \\t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\\n{2,}", "\n\n"))


def latin_letters(text: Column) -> Column:
    return chars_of(text, LATIN[1:-1])


def cyrillic_letters(text: Column) -> Column:
    return chars_of(text, CYRILLIC[1:-1])


def apostrophe_variants(text: Column, variants: Sequence[str] = tuple(sorted(APOSTROPHES))) -> Column:
    """The variants that occur, in code-point order or the one given, as one string."""
    return F.concat_ws("", *[F.when(text.contains(a), F.lit(a)) for a in variants])


def script_class(text: Column) -> Column:
    latin, cyrillic = latin_letters(text), cyrillic_letters(text)
    minor = F.least(latin, cyrillic) / (latin + cyrillic)
    mixed = F.when(minor >= 0.10, "MIXED_BALANCED").otherwise("MIXED_MINOR")
    return F.when((latin > 0) & (cyrillic > 0), mixed).when(latin > 0, "LATIN").when(cyrillic > 0, "CYRILLIC").otherwise("NO_LATIN_CYR")


def digits(text: Column) -> Column:
    return chars_of(text, digit_class())


def letters(text: Column) -> Column:
    return chars_of(text, "\\p{L}")


def spaces(text: Column) -> Column:
    return chars_of(text, SPACE)


def token_lengths(text: Column) -> Column:
    """The length of each token, from which words, the longest token and long tokens are taken."""
    return F.transform(tokens(text), F.length)


def longest(lengths: Column) -> Column:
    return F.coalesce(F.array_max(lengths), F.lit(0)).cast("long")


def of_length(lengths: Column, least: int) -> Column:
    return F.size(F.filter(lengths, lambda n: n >= least)).cast("long")


def letter_digit_turns(text: Column, pattern: str = LETTER_DIGIT) -> Column:
    """Turns between letters and digits; texts without a digit are not searched."""
    return F.when(text.rlike("[0-9]"), matches(text, pattern)).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))


def has_markup(text: Column, pattern: str) -> Column:
    """Whether one of the markup patterns stands in the text; searched only where one of MARKUP_HINTS does."""
    low = F.lower(text)
    hint = low.contains(MARKUP_HINTS[0])
    for part in MARKUP_HINTS[1:]:
        hint = hint | low.contains(part)
    return F.when(hint, text.rlike(pattern)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def stripped_lines(text: Column, space: str = SPACE) -> Column:
    return F.filter(F.transform(F.split(line_endings(text), "\\n"), lambda x: trimmed(x, space)), lambda x: x != "")


def repeated_lines(text: Column, space: str = SPACE) -> Column:
    """How many non-empty lines stand again after their first time."""
    lines = stripped_lines(text, space)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def substring_count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, a line each."""
    return F.substring(F.sha2(F.concat_ws("\n", *[p.cast("string") for p in parts]), 256), 1, 16)
