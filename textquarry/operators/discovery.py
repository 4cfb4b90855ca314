"""Structural discovery: page census, feature rows, signatures, ranked axes, Unicode inventory, review candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.unicode import casefold, char_counts, char_names, smart_excerpt, stable_score, strip_markup

# Patterns counted in raw markup.
RAW_PATTERNS = {
    "raw_urls": T.URL,
    "raw_external_links": "(?iu)\\[(?:https?://|//)",
    "raw_files": "(?iu)\\[\\[(?:File|Image|Fayl):",
    "raw_categories": "(?iu)\\[\\[(?:Category|Turkum):",
    "raw_refs": "(?iu)<\\s*ref\\b",
    "raw_references": "(?iu)<\\s*references\\b",
    "raw_galleries": "(?iu)<\\s*gallery\\b",
    "raw_html_tags": "(?iu)</?[A-Za-z][^>]{0,300}>",
    "raw_infobox_hints": "(?iu)\\{\\{\\s*(?:infobox|taxobox|geobox|chembox|sidebar)\\b",
    "raw_nav_hints": "(?iu)\\{\\{\\s*(?:navbox|navigation|navbar)\\b",
}
RAW_PARTS = {"raw_template_opens": "{{", "raw_template_closes": "}}", "raw_table_starts": "{|", "raw_table_ends": "|}", "raw_link_opens": "[[", "raw_link_closes": "]]", "raw_pipes": "|"}
LINE_PATTERNS = {"heading_lines": "^\\s*=+[^=\\n].*?=+\\s*$", "list_lines": "^\\s*[*#;:]+", "table_row_lines": "^\\s*\\|-", "table_cell_lines": "^\\s*[!|]", "key_value_lines": "^\\s*[^=\\n]{1,80}\\s*=\\s*\\S"}
RESIDUE_PARTS = {"double_braces": ("{{", "}}"), "table_markers": ("{|", "|}"), "pipes": ("|",), "equals": ("=",)}
LONG_TOKENS = (40, 80, 120, 200)


def lines_like(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(T.line_endings(text), "\\n"), lambda x: x.rlike(pattern))).cast("long")


def text_features(df: DataFrame, text: str, prefix: str, classes: T.Classes | None = None) -> DataFrame:
    """36 counts and ratios of a text column, each named prefix_*. classes: what counts as white space, letter, digit and so on, Python's by default."""
    s, classes = F.col(text), classes or T.Classes.python()
    chars = F.length(s).cast("long")
    tokens = f"{prefix}__tokens"
    df = df.withColumn(tokens, T.tokens(s, classes.space))
    sorted_tokens = F.array_sort(tokens)
    # The longest run of equal tokens in sorted order, kept as (last, run, best).
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    n = F.size(tokens)
    values = {
        "chars": chars,
        "utf8_bytes": F.octet_length(s).cast("long"),
        "words": n.cast("long"),
        "lines": F.when(s == "", 0).otherwise(F.size(F.split(T.line_endings(s), "\\n"))).cast("long"),
        "nonempty_lines": F.size(T.stripped_lines(s, classes.trimmed)).cast("long"),
        "max_line_len": F.coalesce(F.array_max(F.transform(F.split(T.line_endings(s), "\\n"), F.length)), F.lit(0)).cast("long"),
        "latin_letters": T.latin_letters(s),
        "cyrillic_letters": T.cyrillic_letters(s),
        "control_chars": T.chars_of(s, classes.control),
        "format_chars": T.chars_of(s, "\\p{Cf}"),
        "private_use_chars": T.chars_of(s, "\\p{Co}"),
        "replacement_chars": T.chars_of(s, "\\uFFFD"),
        "combining_marks": T.chars_of(s, "\\p{M}"),
        "apostrophe_variants": T.apostrophe_variants(s, T.APOSTROPHES),
        "max_token_len": T.longest(F.transform(tokens, F.length)),
        **{f"long_tokens_{k}": T.of_length(F.transform(tokens, F.length), k) for k in LONG_TOKENS},
        "alpha_digit_transitions": T.letter_digit_turns(s, T.LETTER_DIGIT_CYRILLIC),
        "glued_tokens": F.size(F.filter(tokens, lambda t: (F.length(t) >= 30) & (T.matches(t, T.LETTER_DIGIT_CYRILLIC) >= 2))).cast("long"),
        "long_digit_runs": T.matches(s, classes.digit_run),
        "unique_token_ratio": T.ratio(F.size(F.array_distinct(tokens)), n),
        "top_token_share": T.ratio(F.aggregate(sorted_tokens, start, step, lambda a: a["best"]), n),
        "repeated_line_instances": T.repeated_lines(s, classes.trimmed),
        "repeated_delimiters": T.matches(s, T.REPEATED_DELIMITER),
        "sha256": F.sha2(s.cast("binary"), 256),
        "_alpha": T.chars_of(s, classes.letter),
        "_digit": T.chars_of(s, classes.digit),
        "_whitespace": T.chars_of(s, classes.space),
        "_punct": T.chars_of(s, classes.punct),
        "_symbol": T.chars_of(s, classes.symbol),
    }
    df = df.withColumns({f"{prefix}_{k}": v for k, v in values.items()})

    def col(name: str) -> Column:
        return F.col(f"{prefix}_{name}")

    both = col("latin_letters") + col("cyrillic_letters")
    more = {f"{k}_ratio": T.ratio(col(f"_{k}"), col("chars")) for k in ("alpha", "digit", "whitespace", "punct", "symbol")}
    more |= {"latin_share": T.ratio(col("latin_letters"), both), "cyrillic_share": T.ratio(col("cyrillic_letters"), both), "mixed_latin_cyrillic": ((col("latin_letters") > 0) & (col("cyrillic_letters") > 0)).cast("int"), "repeated_line_ratio": T.ratio(col("repeated_line_instances"), col("nonempty_lines"))}
    return df.withColumns({f"{prefix}_{k}": v for k, v in more.items()}).drop(tokens, *[f"{prefix}_{k}" for k in values if k.startswith("_")])


def markup_features(df: DataFrame, raw: str) -> DataFrame:
    """22 markup counts of a raw column; strip_markup gives three more."""
    s = F.col(raw)
    counts = {k: T.matches(s, p) for k, p in RAW_PATTERNS.items()}
    counts |= {k: T.substring_count(s, p) for k, p in RAW_PARTS.items()}
    counts |= {f"raw_{k}": lines_like(s, p) for k, p in LINE_PATTERNS.items()}
    return df.withColumns(counts)


def residue_features(df: DataFrame, extracted: str) -> DataFrame:
    """9 counts of markup left in extracted text."""
    s = F.col(extracted)
    counts = {"residue_wiki": T.matches(s, T.WIKI_RESIDUE), "residue_urls": T.matches(s, T.URL)}
    for name, parts in RESIDUE_PARTS.items():
        counts[f"residue_{name}"] = sum((T.substring_count(s, p) for p in parts[1:]), T.substring_count(s, parts[0]))
    counts |= {f"residue_{k}": lines_like(s, LINE_PATTERNS[k]) for k in ("heading_lines", "list_lines", "key_value_lines")}
    return df.withColumns(counts)


def page_features(pages: DataFrame, raw: str = "raw", title: str = "title") -> DataFrame:
    """pages with extracted text and all features of raw and extracted text, and the script class; a narrow stage."""
    df = pages.withColumn("_plain", strip_markup(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn("extracted", F.col("_plain.text")).withColumns({f"raw_{k}": F.col(f"_plain.{k}") for k in ("ast_templates", "ast_tags", "ast_links")}).drop("_plain")
    df = residue_features(text_features(markup_features(text_features(df, raw, "raw"), raw), "extracted", "extracted"), "extracted")
    name, body = casefold(F.col(title)), casefold(F.col("extracted"))
    times = F.when(F.length(name) > 0, (F.length(body) - F.length(F.replace(body, name, F.lit("")))) / F.length(name)).otherwise(0).cast("long")
    return df.withColumns({"char_ratio": T.ratio(F.col("extracted_chars"), F.col("raw_chars")), "word_ratio": T.ratio(F.col("extracted_words"), F.col("raw_words")), "title_occurrences": times, "script_class": T.script_class(F.col("extracted"))})


def tags(*pairs: tuple[str, Column], none: str) -> Column:
    """The names whose condition holds, joined by +, or `none`."""
    joined = F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in pairs])
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def signatures(features: DataFrame) -> DataFrame:
    """features with raw_signature, extracted_signature and joint_signature."""
    c = F.col
    raw = tags(
        ("TEMPLATE_PRESENT", c("raw_ast_templates") > 0), ("TEMPLATE_HEAVY", c("raw_ast_templates") >= 10), ("TABLE_PRESENT", c("raw_table_starts") > 0), ("TABLE_HEAVY", c("raw_table_starts") >= 4),
        ("LIST_PRESENT", c("raw_list_lines") >= 5), ("LIST_HEAVY", c("raw_list_lines") >= 20), ("REF_PRESENT", c("raw_refs") > 0), ("REF_HEAVY", c("raw_refs") >= 10), ("MEDIA_PRESENT", c("raw_files") > 0),
        ("GALLERY_PRESENT", c("raw_galleries") > 0), ("URL_PRESENT", c("raw_urls") > 0), ("KEYVALUE_PRESENT", c("raw_key_value_lines") >= 5), ("KEYVALUE_HEAVY", c("raw_key_value_lines") >= 20),
        ("INFOBOX_HINT", c("raw_infobox_hints") > 0), ("NAV_HINT", c("raw_nav_hints") > 0), ("HEADING_RICH", c("raw_heading_lines") >= 5), none="RAW_BASELINE",
    )
    script = c("script_class")
    special = c("extracted_control_chars") + c("extracted_format_chars") + c("extracted_private_use_chars") + c("extracted_replacement_chars")
    extracted = tags(
        ("SCRIPT_CYRILLIC", script == "CYRILLIC"), ("SCRIPT_MIXED_BALANCED", script == "MIXED_BALANCED"), ("SCRIPT_MIXED_MINOR", script == "MIXED_MINOR"), ("SCRIPT_OTHER_OR_NONE", script == "NO_LATIN_CYR"),
        ("VERY_SHORT", c("extracted_words") <= 20), ("VERY_LONG", c("extracted_words") > 1500), ("LONG_TOKEN", c("extracted_max_token_len") >= 40), ("EXTREME_TOKEN", c("extracted_max_token_len") >= 80),
        ("DIGIT_HIGH", c("extracted_digit_ratio") >= 0.15), ("DIGIT_VERY_HIGH", c("extracted_digit_ratio") >= 0.30), ("PUNCT_HIGH", c("extracted_punct_ratio") >= 0.20), ("WHITESPACE_LOW", c("extracted_whitespace_ratio") < 0.05),
        ("ALPHA_LOW", c("extracted_alpha_ratio") < 0.50), ("ALNUM_TRANSITIONS_HIGH", c("extracted_alpha_digit_transitions") >= 10), ("GLUED_TRANSITION_TOKEN", c("extracted_glued_tokens") > 0), ("LONG_DIGIT_RUNS", c("extracted_long_digit_runs") >= 2),
        ("REPEATED_LINES", c("extracted_repeated_line_ratio") >= 0.20), ("WIKI_RESIDUE", c("residue_wiki") > 0), ("UNICODE_SPECIAL", special > 0), ("EXTRACTION_EXTREME_LOSS", c("char_ratio") < 0.15),
        ("EXTRACTION_LARGE_LOSS", (c("char_ratio") >= 0.15) & (c("char_ratio") < 0.35)), ("EXTRACTION_EXPANSION", c("char_ratio") > 1.10), ("EXTRACTED_LIST_HEAVY", c("residue_list_lines") >= 20),
        ("EXTRACTED_KEYVALUE_HEAVY", c("residue_key_value_lines") >= 20), ("TITLE_REPEATED", c("title_occurrences") > 1), none="SURFACE_BASELINE",
    )
    return features.withColumns({"raw_signature": raw, "extracted_signature": extracted}).withColumn("joint_signature", F.concat_ws("||", "raw_signature", "extracted_signature"))


# Bins of the older, binned signatures.
COUNT_BINS = {"TPL": (2, 9, 29), "TABLE": (1, 3, 9), "LIST": (4, 19, 99), "REF": (2, 9, 29), "FILE": (2, 9, 29), "URL": (1, 4, 19), "KV": (4, 19, 99), "TRANS": (3, 9, 29), "REPL": (1, 3, 9), "FORMAT": (1, 3, 9), "RESIDUE": (1, 3, 9)}
RATIO_BINS = {"DIGIT": (0.01, 0.05, 0.15, 0.30), "PUNCT": (0.03, 0.08, 0.20), "WS": (0.05, 0.10, 0.18, 0.30), "REPEATLINE": (0.01, 0.05, 0.20)}
COMPRESSION_BINS = (0.05, 0.15, 0.35, 0.65, 0.90, 1.10)


def labelled(value: Column, passed: list[Column], labels: list[str]) -> Column:
    """The label at the place given by how many of the conditions hold."""
    place = sum((c.cast("int") for c in passed[1:]), passed[0].cast("int"))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), place + 1)


def count_bucket(value: Column, cuts: tuple[int, ...]) -> Column:
    """0 for nothing, then the range of counts up to each cut; the last range is open."""
    ranges = [*zip((1, *(c + 1 for c in cuts)), cuts, strict=False)]
    labels = ["0", *[f"{a}-{b}" if a < b else f"{a}" for a, b in ranges], f"{cuts[-1] + 1}+"]
    return labelled(value, [value > 0, *[value > c for c in cuts]], labels)


def ratio_bucket(value: Column, cuts: tuple[float, ...]) -> Column:
    """The first cut that lies above the value, as <cut; >=cut from the last one on."""
    return labelled(value, [value >= c for c in cuts], [*[f"<{c:g}" for c in cuts], f">={cuts[-1]:g}"])


def compression_bucket(value: Column) -> Column:
    """Intervals that hold their lower end, but for the last two: the one below the last cut holds that cut too."""
    *cuts, last = COMPRESSION_BINS
    labels = [f"<{cuts[0]:.2f}", *[f"{a:.2f}-{b:.2f}" for a, b in zip(cuts, (*cuts[1:], last), strict=True)], f">{last:.2f}"]
    return labelled(value, [*[value >= c for c in cuts], value > last], labels)


def length_bucket(words: Column) -> Column:
    return count_bucket(words, (20, 100, 500, 1500))


def max_token_bucket(n: Column) -> Column:
    return F.when(n < 25, "<25").when(n < 40, "25-39").when(n < 80, "40-79").when(n < 160, "80-159").otherwise("160+")


def binned_signature(parts: dict[str, Column]) -> Column:
    """NAME=bucket for each part, joined by |; names as in COUNT_BINS and RATIO_BINS, or LEN, MAXTOK and COMP."""
    made = []
    for name, value in parts.items():
        bucket = length_bucket(value) if name == "LEN" else max_token_bucket(value) if name == "MAXTOK" else compression_bucket(value) if name == "COMP" else count_bucket(value, COUNT_BINS[name]) if name in COUNT_BINS else ratio_bucket(value, RATIO_BINS[name])
        made.append(F.concat(F.lit(f"{name}="), bucket))
    return F.concat_ws("|", *made)


def signature_counts(signed: DataFrame, axes: tuple[str, ...] = ("raw_signature", "extracted_signature", "joint_signature")) -> DataFrame:
    """axis, signature, pages."""
    each = signed.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("signature")) for a in axes])).alias("x"))
    return each.groupBy("x.axis", "x.signature").agg(F.count(F.lit(1)).alias("pages"))


def signature_examples(signed: DataFrame, axis: str, k: int, seed: int, key: str = "page_id") -> DataFrame:
    """The k pages of each signature that come first by hash, with their rank."""
    scored = signed.withColumn("_score", stable_score(seed, F.concat(F.lit("signature:"), F.col(axis)), F.col(key)))
    nth = F.row_number().over(Window.partitionBy(axis).orderBy("_score", key))
    return scored.withColumn("example_rank", nth).where(F.col("example_rank") <= k).drop("_score")


def baseline_sample(df: DataFrame, k: int, seed: int, key: str = "page_id") -> DataFrame:
    """The k rows that come first by hash."""
    return df.withColumn("_score", stable_score(seed, "baseline", F.col(key))).orderBy("_score", key).limit(k).drop("_score")


def top_k(df: DataFrame, axes: dict[str, tuple[Column, str]], k: int, key: str = "page_id", tie: Column | None = None) -> DataFrame:
    """axis, key, value, rank: the k largest (or, mode min, smallest) of each axis; among equals the larger tie wins. Null values don't compete."""
    tie = F.col(key) if tie is None else tie
    each = df.select(F.col(key), tie.alias("_tie"), F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), v.cast("double").alias("value"), F.lit(-1.0 if m == "min" else 1.0).alias("sign")) for n, (v, m) in axes.items()])).alias("x"))
    each = each.select(key, "_tie", "x.axis", "x.value", "x.sign").where("value is not null")
    w = Window.partitionBy("axis").orderBy((F.col("value") * F.col("sign")).desc(), F.col("_tie").desc())
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("axis", key, "value", "rank")


def outlier_axes(features: DataFrame) -> dict[str, tuple[Column, str]]:
    c = F.col
    special = c("extracted_control_chars") + c("extracted_format_chars") + c("extracted_private_use_chars") + c("extracted_replacement_chars")
    most = {
        "MAX_EXTRACTED_WORDS": c("extracted_words"), "MAX_EXTRACTED_TOKEN_LEN": c("extracted_max_token_len"), "MAX_DIGIT_RATIO": c("extracted_digit_ratio"), "MAX_PUNCT_RATIO": c("extracted_punct_ratio"),
        "MAX_SYMBOL_RATIO": c("extracted_symbol_ratio"), "MAX_ALPHA_DIGIT_TRANSITIONS": c("extracted_alpha_digit_transitions"), "MAX_LONG_DIGIT_RUNS": c("extracted_long_digit_runs"), "MAX_REPEATED_LINE_RATIO": c("extracted_repeated_line_ratio"),
        "MAX_RAW_TABLES": c("raw_table_starts"), "MAX_RAW_TEMPLATES": c("raw_ast_templates"), "MAX_RAW_LIST_LINES": c("raw_list_lines"), "MAX_EXTRACTED_WIKI_RESIDUE": c("residue_wiki"),
        "MAX_CONTROL_FORMAT_PRIVATE_REPLACEMENT": special, "MAX_EXTRACTION_CHAR_RATIO": c("char_ratio"), "MAX_TITLE_REPETITION": c("title_occurrences"),
    }
    least = {"MIN_EXTRACTED_WORDS_NONEMPTY": F.when(c("extracted_words") > 0, c("extracted_words")), "MIN_WHITESPACE_RATIO": c("extracted_whitespace_ratio"), "MIN_ALPHA_RATIO": c("extracted_alpha_ratio"), "MIN_EXTRACTION_CHAR_RATIO": c("char_ratio")}
    return {k: (v, "max") for k, v in most.items()} | {k: (v, "min") for k, v in least.items()}


def unicode_inventory(df: DataFrame, text: str, key: str, seed: int, scope: str, spaces: bool = False) -> DataFrame:
    """char, codepoint, name, category, count, rows, example: the example is the row that comes first by hash. Counts are made within rows before anything is shuffled."""
    each = df.select(F.col(key), F.explode(char_counts(F.coalesce(F.col(text), F.lit("")), spaces)).alias("char", "n"))
    score = F.xxhash64(F.lit(f"{seed}|unicode:{scope}"), "char", key)
    sums = each.groupBy("char").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows"), F.min_by(key, F.struct(score, F.col(key))).alias("example"))
    return sums.withColumn("_u", char_names(F.col("char"))).select("char", "_u.*", "count", "rows", "example")


def census(pages: DataFrame, text: str = "raw") -> DataFrame:
    """One row of counts over all pages: namespaces, redirects, missing, empty and blank texts, candidates."""
    main, body = F.col("namespace") == "0", F.coalesce(F.col(text), F.lit(""))
    usable = main & ~F.col("is_redirect") & (T.strip(body) != "")
    names = {
        "pages_total": F.lit(True), "main_namespace": main, "other_namespace": ~main, "redirects": F.col("is_redirect"), "main_redirects": main & F.col("is_redirect"), "without_revision": ~F.col("has_revision"), "without_text_node": ~F.col("has_text_node"),
        "empty_text": F.col("has_text_node") & (body == ""), "blank_text": T.strip(body) == "", "main_articles": main & ~F.col("is_redirect"), "candidates": usable,
    }
    return pages.agg(*[F.count_if(c).alias(n) for n, c in names.items()])


def namespace_counts(pages: DataFrame) -> DataFrame:
    """namespace, pages and the place in numeric-first order."""
    counts = pages.groupBy("namespace").agg(F.count(F.lit(1)).alias("pages"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.expr("try_cast(namespace as int)").asc_nulls_last(), "namespace")))


def frequent_signatures(counts: DataFrame, n: int) -> DataFrame:
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("pages"), "signature"))).where(F.col("nth") <= n)


def rare_signatures(counts: DataFrame, most: int, n: int | None, seed: int) -> DataFrame:
    """Signatures of at most `most` pages: all of them, or the first n of each axis by hash."""
    if n is None:
        return counts.where(F.col("pages") <= most)
    rare = counts.where(F.col("pages") <= most).withColumn("_score", stable_score(seed, F.concat(F.lit("rare-"), F.col("axis")), F.col("signature")))
    return rare.withColumn("nth", F.row_number().over(Window.partitionBy("axis").orderBy("_score", "signature"))).where(F.col("nth") <= n).drop("_score")


def rare_characters(inventory: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    rare = inventory.where(F.col("count") <= most).withColumn("_score", stable_score(seed, "rare-unicode", F.col("codepoint")))
    return rare.orderBy("count", "_score", "codepoint").limit(n).drop("_score")


def merge_reasons(selections: DataFrame, key: str = "page_id") -> DataFrame:
    """selections (key, reason, ord, population) as one row a key: sorted reasons, the first order, the last known population."""
    return selections.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.min("ord").alias("first_ord"), F.max_by("population", F.when(F.col("population").isNotNull(), F.col("ord"))).alias("population"))


def review_candidates(selections: DataFrame, cap: int, seed: int, key: str = "page_id") -> DataFrame:
    """At most `cap` candidates: those with more reasons first, then by hash, with their place (from 1)."""
    merged = merge_reasons(selections, key).withColumn("n_reasons", F.size("reasons")).withColumn("_score", stable_score(seed, "review-order", F.col(key)))
    picked = merged.orderBy(F.desc("n_reasons"), "_score", key).limit(cap)
    return picked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_reasons"), "_score", key))).drop("_score")


def in_batches(rows: DataFrame, size: int, place: str = "place") -> DataFrame:
    """rows with batch (from 1) by their place."""
    return rows.withColumn("batch", (F.floor((F.col(place) - 1) / size) + 1).cast("int"))


def with_excerpts(rows: DataFrame, columns: tuple[str, ...], most: int = 4000) -> DataFrame:
    return rows.withColumns({f"{c}_excerpt": smart_excerpt(F.col(c), most) for c in columns}).drop(*columns)
