"""Corpus profiles: per-source statistics, unit sizes at several limits, surface flags, a mechanical recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.tokenizers import TokenCounter
from textquarry.functions.unicode import casefold

from .segment import retrieval_units, unit_sizes

# What a screening of limits says of itself, without and with token counts.
STATUSES = ("tokenizers_not_run", "screening_only_not_a_scientific_freeze")
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# Columns that a record's fields are looked for in, in this order.
TEXT_FIELDS = ("text", "body", "content", "article_text", "full_text", "document_text", "article", "description", "raw_text")
TITLE_FIELDS = ("title", "document_title", "headline", "name", "doc_title")
ID_FIELDS = ("id", "doc_id", "document_id", "article_id", "page_id", "url", "link", "source_url")
CATEGORY_FIELDS = ("category", "label", "topic", "section")


def first_present(df: DataFrame, fields: tuple[str, ...], explicit: str | None = None) -> Column:
    """The explicit column, or the first of the fields that isn't empty."""
    if explicit is not None:
        return F.coalesce(F.col(explicit).cast("string"), F.lit("")) if explicit in df.columns else F.lit("")
    found = [F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in fields if f in df.columns]
    return F.coalesce(*found, F.lit(""))


def as_documents(df: DataFrame, source: str | Column, exclude: tuple[str, ...] = (), **explicit: str) -> DataFrame:
    """Records as documents (source, doc_id, title, text, category, provenance): blank texts and excluded categories go."""
    source = F.lit(source) if isinstance(source, str) else source
    docs = df.select(
        source.alias("source"),
        first_present(df, ID_FIELDS, explicit.get("doc_id")).alias("doc_id"),
        first_present(df, TITLE_FIELDS, explicit.get("title")).alias("title"),
        first_present(df, TEXT_FIELDS, explicit.get("text")).alias("text"),
        first_present(df, CATEGORY_FIELDS, explicit.get("category")).alias("category"),
        F.lit(explicit.get("provenance", "")).alias("provenance"),
    ).where(T.strip(F.col("text")) != "")
    if exclude:
        docs = docs.where(~T.strip(casefold(F.col("category"))).isin(*[e.strip().casefold() for e in exclude]))
    return docs


def summarize(value: Column, prefix: str) -> list[Column]:
    """n, mean, exact interpolated quantiles and max of the values that aren't null; nulls where there are none."""
    exact = [F.percentile(value, F.lit(q)).alias(f"{prefix}_{name}") for name, q in QUANTILES.items()]
    return [F.count(value).alias(f"{prefix}_n"), F.avg(value).alias(f"{prefix}_mean"), *exact, F.max(value).alias(f"{prefix}_max")]


def percent(part: Column) -> Column:
    """The percentage of a group's rows for which part holds."""
    return 100 * F.count_if(part) / F.greatest(F.lit(1), F.count(F.lit(1)))


def document_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words, chars, script counts and shares and the exact hash; without the text itself."""
    norm = docs.withColumn("_norm", T.normalize_text(F.col(text)))
    latin, cyrillic = T.latin_letters(F.col("_norm")), T.cyrillic_letters(F.col("_norm"))
    rows = norm.withColumns({"words": T.word_count(F.col("_norm")), "chars": F.length("_norm").cast("long"), "latin_letters": latin, "cyrillic_letters": cyrillic, "apostrophes": T.apostrophe_variants(F.col("_norm")), "hash": F.sha2(casefold(F.col("_norm")), 256)})
    both = F.col("latin_letters") + F.col("cyrillic_letters")
    return rows.withColumns({"latin_share": T.ratio(F.col("latin_letters"), both), "cyrillic_share": T.ratio(F.col("cyrillic_letters"), both), "mixed": (F.col("latin_letters") > 0) & (F.col("cyrillic_letters") > 0)}).drop("_norm", text)


def source_profile(docs: DataFrame) -> DataFrame:
    """A row for each source: exact duplicates, scripts, and summaries of words and characters."""
    rows = document_rows(docs)
    n, distinct = F.count(F.lit(1)), F.countDistinct("hash")
    return rows.groupBy("source").agg(
        n.alias("documents"),
        (n - distinct).alias("duplicate_docs"),
        (100 * (n - distinct) / F.greatest(F.lit(1), n)).alias("duplicate_pct"),
        F.count_if("mixed").alias("mixed_docs"),
        percent(F.col("mixed")).alias("mixed_pct"),
        F.avg("latin_share").alias("mean_latin_share"),
        F.avg("cyrillic_share").alias("mean_cyrillic_share"),
        *summarize(F.col("words"), "words"),
        *summarize(F.col("chars"), "chars"),
    )


def segmentation_profile(docs: DataFrame, limits: list[int], title: str | None = None) -> DataFrame:
    """A row for each source and limit: units, units per document, documents kept whole, words per unit. One pass over the texts."""
    sizes = unit_sizes(docs.select("source", "text", *([title] if title else [])), limits, title=title)
    each = sizes.select("source", "word_limit", F.size("sizes").alias("k"), F.posexplode_outer("sizes").alias("at", "words"))
    own = F.when(F.coalesce("at", F.lit(0)) == 0, F.greatest("k", F.lit(0)))
    return each.groupBy("source", "word_limit").agg(
        F.count(own).alias("documents"),
        F.sum(own).alias("units"),
        F.avg(own).alias("mean_units"),
        F.percentile(own, F.lit(0.95)).alias("p95_units"),
        F.max(own).alias("max_units"),
        (100 * F.count_if(own == 1) / F.count(own)).alias("whole_pct"),
        *summarize(F.col("words"), "unit_words"),
    )


def token_profile(docs: DataFrame, limits: list[int], counters: Sequence[TokenCounter], title: str | None = None) -> DataFrame:
    """segmentation_profile with, for each counter: a summary of the units' tokens, its limit, units above it, their percentage, and the room left at the 99th percentile."""
    base = segmentation_profile(docs, limits, title)
    if not counters:
        return base
    units = retrieval_units(docs.select("source", "text", *([title] if title else [])), limits, title=title)
    units = units.withColumns({f"_{c.name}": c.count(F.col("unit")) for c in counters})
    made = []
    for c in counters:
        n = F.col(f"_{c.name}")
        room = F.lit(c.most) - F.coalesce(F.percentile(n, F.lit(0.99)), F.lit(0.0))
        made += [*summarize(n, f"{c.name}_tokens"), F.first(F.lit(c.most)).alias(f"{c.name}_max_tokens"), F.count_if(n > c.most).alias(f"{c.name}_overflow_units"), percent(n > c.most).alias(f"{c.name}_overflow_pct"), room.alias(f"{c.name}_p99_headroom")]
    return base.join(units.groupBy("source", "word_limit").agg(*made), ["source", "word_limit"], "left")


def screen_limits(profile: DataFrame, most_overflow: float = 0.1, p99_target: float = 480, counter: str = "e5") -> DataFrame:
    """recommend_limit by a counter's tokens; its status says if tokens weren't counted, and that a recommendation is a screening only."""
    if f"{counter}_overflow_pct" not in profile.columns:
        nothing = profile.select("word_limit").distinct().agg(F.lit(None).cast("int").alias("recommended_limit"), F.lit(0).cast("long").alias("passing_limits"), F.count(F.lit(1)).alias("limits"))
        return nothing.withColumn("status", F.lit(STATUSES[0]))
    return recommend_limit(profile, most_overflow, p99_target, f"{counter}_tokens_p99", f"{counter}_overflow_pct").withColumn("status", F.lit(STATUSES[1]))


def recommend_limit(profile: DataFrame, most_overflow: float = 0.1, p99_target: float = 480, p99: str = "unit_words_p99", overflow: str | None = None) -> DataFrame:
    """One row: the largest limit whose worst source stays within both bounds; null where none does. A missing p99 passes no bound."""
    over = F.max(overflow) if overflow else F.lit(0.0)
    worst = profile.groupBy("word_limit").agg(over.alias("worst_overflow"), F.max(F.coalesce(p99, F.lit(1e9))).alias("worst_p99"))
    fits = (F.col("worst_overflow") <= most_overflow) & (F.col("worst_p99") <= p99_target)
    best = worst.agg(F.max(F.when(fits, F.col("word_limit"))).alias("recommended_limit"), F.count_if(fits).alias("passing_limits"), F.count(F.lit(1)).alias("limits"))
    return best.withColumn("status", F.when(F.col("recommended_limit").isNull(), "no_limit_passes").otherwise("recommended"))


# The reasons of a flag, in the order in which they are listed.
REASONS = ("MARKUP_ARTIFACT", "COLLAPSED_TABLE_OR_GLUE", "DIGIT_HEAVY", "SYMBOL_HEAVY", "VERY_LONG_SURFACE_TOKEN")


def structural_flags(units: DataFrame, text: str = "unit") -> DataFrame:
    """units with counts and ratios of their surface, and label, core_flag, reasons."""
    s, lengths = F.col(text), F.col("_lengths")
    counted = units.withColumn("_lengths", T.token_lengths(s)).withColumns(
        {
            "words": F.size(lengths).cast("long"),
            "chars": F.length(s).cast("long"),
            "max_word_len": T.longest(lengths),
            "long40": T.of_length(lengths, 40),
            "long80": T.of_length(lengths, 80),
            "digit_chars": T.digits(s),
            "alpha_chars": T.letters(s),
            "punct_chars": F.length(s).cast("long") - T.chars_of(s, "\\p{L}\\p{N}") - T.spaces(s),
            "transitions": T.letter_digit_turns(s),
            "digit_runs": T.matches(s, T.LONG_DIGIT_RUN),
            "wiki_markup": T.has_markup(s, T.WIKI_MARKUP),
            "url_markup": T.has_markup(s, T.URL_MARKUP),
        }
    ).drop("_lengths")
    whole = F.greatest(F.lit(1), F.col("chars"))
    counted = counted.withColumns({f"{k}_ratio": F.col(f"{k}_chars") / whole for k in ("digit", "alpha", "punct")})
    markup = F.col("wiki_markup") | F.col("url_markup")
    heavy = F.col("digit_ratio") >= 0.25
    collapsed = (F.col("transitions") >= 10) | (F.col("digit_runs") >= 2) | (heavy & (F.col("transitions") >= 4)) | (F.col("long80") >= 1) | (F.col("long40") >= 3)
    symbols = (F.col("punct_ratio") >= 0.25) & (F.col("alpha_ratio") < 0.60)
    holds = (markup, collapsed, heavy, symbols, F.col("max_word_len") >= 80)
    reasons = F.filter(F.array(*[F.when(h, F.lit(r)) for h, r in zip(holds, REASONS, strict=True)]), lambda r: r.isNotNull())
    label = F.when(markup & collapsed, "MARKUP_AND_STRUCTURED").when(markup, "MARKUP_ARTIFACT").when(collapsed, "STRUCTURED_OR_COLLAPSED").when(heavy | symbols, "REVIEW_SURFACE").otherwise("PROSE_LIKE")
    return counted.withColumns({"reasons": reasons, "core_flag": markup | collapsed, "label": label})


def structural_profile(flags: DataFrame, keys: tuple[str, ...] = ("source", "word_limit"), most_words: int | None = None) -> DataFrame:
    """A row for each source and limit: flagged units, units by reason; with most_words also the overflow among all and unflagged units."""
    parts = [F.count(F.lit(1)).alias("units"), F.count_if("core_flag").alias("flagged"), percent(F.col("core_flag")).alias("flagged_pct")]
    parts += [F.count_if(F.array_contains("reasons", r)).alias(r.lower()) for r in REASONS]
    if most_words is not None:
        over = F.col("words") > most_words
        parts += [percent(over).alias("overflow_pct"), (100 * F.count_if(over & ~F.col("core_flag")) / F.greatest(F.lit(1), F.count_if(~F.col("core_flag")))).alias("unflagged_overflow_pct")]
    return flags.groupBy(*keys).agg(*parts)


def flagged_examples(flags: DataFrame, cap: int, order: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """The first `cap` flagged units of each source."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return flags.where("core_flag").withColumn("nth", nth).where(F.col("nth") <= cap)


def labelled_overflow(flags: DataFrame, label: str, keep: str, most_words: int) -> DataFrame:
    """A row for each source and limit: units and percentages of each label; overflow over all units, and over the ones that `keep` holds for."""
    over = F.col("raw_words") > most_words
    left = F.expr(keep)
    return flags.groupBy("source", "word_limit", label).agg(F.count(F.lit(1)).alias("units"), F.count_if(over).alias("raw_overflow"), F.count_if(left & (F.col("words") > most_words)).alias("residual_overflow"))
