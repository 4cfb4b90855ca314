"""The registered queries over the tables of a scale-factor folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.unicode import casefold
from textquarry.operators import assemble, discovery, evaluation, profile, refine, retrieval, sample, segment, stats, targets
from textquarry.plans.tables import spread, written

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
LIMITS = [120, 150, 180, 200, 220]
REFINED_LIMITS = [120, 130, 140]
SEED = 20260916
#: Tables whose rows take long enough to be worth spreading, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXTS[name]) if name in TEXTS else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: their last bits depend on the order of additions."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- SQL fragments -------------------------------------------------------------------------------------------------

NORM = r"trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g'))"
WORDS = r"len(regexp_extract_all({}, '\S+'))"
FOLD = "replace(lower({}), 'ß', 'ss')"


def sql_summary(value: str, prefix: str, digits: int = 6) -> str:
    quantiles = ", ".join(f"round(quantile_cont({value}, {q}), {digits}) AS {prefix}_{name}" for name, q in profile.QUANTILES.items())
    return f"count({value}) AS {prefix}_n, round(avg({value}), {digits}) AS {prefix}_mean, {quantiles}, max({value}) AS {prefix}_max"


def sql_count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


#: Sentences of the layout text of a document, and the words of each.
SENTENCES = r"""
body AS (
  SELECT doc_id, source, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{2,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS body
  FROM documents),
sents AS (
  SELECT doc_id, source, list_filter(flatten(list_transform(list_filter(string_split(body, chr(10) || chr(10)), lambda p: p <> ''), lambda p: string_split(regexp_replace(p, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s, ' ' || chr(10)) <> '') AS s
  FROM body),
"""
#: Units of each document and limit as lists of sentence groups: a running group closes where the next sentence would overflow it.
UNIT_SIZES = SENTENCES + r"""
counts AS (SELECT doc_id, source, list_transform(s, lambda x: CAST(len(regexp_extract_all(x, '\S+')) AS BIGINT)) AS c FROM sents),
limits AS (SELECT unnest({limits}) AS word_limit),
folded AS (
  SELECT doc_id, source, word_limit,
    list_reduce(list_prepend({'out': []::BIGINT[], 'open': 0::BIGINT}, list_transform(c, lambda n: {'out': []::BIGINT[], 'open': n})), lambda a, x:
      CASE WHEN x.open > word_limit THEN
        {'out': a.out || CASE WHEN a.open > 0 THEN [a.open] ELSE []::BIGINT[] END || list_transform(range(0, x.open // word_limit), lambda i: CAST(word_limit AS BIGINT)) || CASE WHEN x.open % word_limit > 0 THEN [x.open % word_limit] ELSE []::BIGINT[] END, 'open': 0::BIGINT}
      WHEN a.open + x.open > word_limit THEN {'out': a.out || CASE WHEN a.open > 0 THEN [a.open] ELSE []::BIGINT[] END, 'open': x.open}
      ELSE {'out': a.out, 'open': a.open + x.open} END) AS f
  FROM counts, limits),
units AS (SELECT doc_id, source, word_limit, f.out || CASE WHEN f.open > 0 THEN [f.open] ELSE []::BIGINT[] END AS sizes FROM folded)
"""


def unit_sizes_sql(limits: list[int]) -> str:
    return UNIT_SIZES.replace("{limits}", str(limits))


# ---- A: profiles -----------------------------------------------------------------------------------------------------

DOC_ROWS = rf"""
docs AS (SELECT doc_id, source, {NORM} AS t FROM documents),
rows AS (
  SELECT doc_id, source, CAST({WORDS.format('t')} AS BIGINT) AS words, CAST(length(t) AS BIGINT) AS chars, {sql_count('t', '[A-Za-zÀ-ž]')} AS latin, {sql_count('t', '[Ѐ-ӿ]')} AS cyrillic, sha256({FOLD.format('t')}) AS hash
  FROM docs)
"""


@query(
    f"""WITH {DOC_ROWS}
SELECT source, count(*) AS documents, count(*) - count(DISTINCT hash) AS duplicate_docs, round(100.0 * (count(*) - count(DISTINCT hash)) / count(*), 6) AS duplicate_pct,
  count(*) FILTER (latin > 0 AND cyrillic > 0) AS mixed_docs, round(100.0 * count(*) FILTER (latin > 0 AND cyrillic > 0) / count(*), 6) AS mixed_pct,
  round(avg(CASE WHEN latin + cyrillic > 0 THEN latin / (latin + cyrillic) ELSE 0 END), 6) AS mean_latin_share, round(avg(CASE WHEN latin + cyrillic > 0 THEN cyrillic / (latin + cyrillic) ELSE 0 END), 6) AS mean_cyrillic_share,
  {sql_summary('words', 'words')}, {sql_summary('chars', 'chars')}
FROM rows GROUP BY source"""
)
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each source."""
    return rounded(profile.source_profile(read(spark, sf_dir, "documents").select("source", "text")))


@query(f"WITH {DOC_ROWS} SELECT doc_id, source, words, chars, latin AS latin_letters, cyrillic AS cyrillic_letters, hash FROM rows")
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document."""
    return profile.document_rows(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "words", "chars", "latin_letters", "cyrillic_letters", "hash")


@query(rf"""SELECT doc_id, {sql_count('text', '[A-Za-zÀ-ž]')} AS latin, {sql_count('text', '[Ѐ-ӿ]')} AS cyrillic, array_to_string(list_filter(['''', '`', '´', 'ʹ', 'ʻ', 'ʼ', 'ʽ', '‘', '’'], lambda a: contains(text, a)), '') AS apostrophes FROM documents""")
def script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script counts and apostrophe variants."""
    s = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.latin_letters(s).alias("latin"), T.cyrillic_letters(s).alias("cyrillic"), T.apostrophe_variants(s).alias("apostrophes"))


@query(f"WITH {DOC_ROWS} SELECT hash, count(*) AS copies, min(doc_id) AS first_doc FROM rows GROUP BY hash HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.exact_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


SEGMENTATION = f"""WITH {unit_sizes_sql(LIMITS)},
per_doc AS (SELECT source, word_limit, count(*) AS documents, sum(len(sizes)) AS units, avg(len(sizes)) AS mean_units, quantile_cont(len(sizes), 0.95) AS p95_units, max(len(sizes)) AS max_units, 100.0 * count(*) FILTER (len(sizes) = 1) / count(*) AS whole_pct FROM units GROUP BY ALL),
per_unit AS (SELECT source, word_limit, {sql_summary('w', 'unit_words')} FROM (SELECT source, word_limit, unnest(sizes) AS w FROM units) GROUP BY ALL)
"""


@query(f"{SEGMENTATION} SELECT source, word_limit, documents, CAST(units AS BIGINT) AS units, round(mean_units, 6) AS mean_units, round(p95_units, 6) AS p95_units, max_units, round(whole_pct, 6) AS whole_pct, u.* EXCLUDE (source, word_limit) FROM per_doc JOIN per_unit u USING (source, word_limit)")
def segmentation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at several word limits."""
    return rounded(profile.segmentation_profile(read(spark, sf_dir, "documents"), LIMITS))


@query(f"""{SEGMENTATION}, worst AS (SELECT word_limit, max(unit_words_p99) AS p99 FROM per_unit GROUP BY word_limit)
SELECT max(word_limit) FILTER (p99 <= 190) AS recommended_limit, count(*) FILTER (p99 <= 190) AS passing_limits, count(*) AS limits, CASE WHEN max(word_limit) FILTER (p99 <= 190) IS NULL THEN 'no_limit_passes' ELSE 'recommended' END AS status FROM worst""")
def recommend_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest limit that every source bears, by words."""
    return profile.recommend_limit(profile.segmentation_profile(read(spark, sf_dir, "documents"), LIMITS), p99_target=190)


@query(f"WITH {unit_sizes_sql([120])} SELECT doc_id, word_limit, u.i AS chunk_index, sizes[u.i] AS words FROM units, unnest(range(1, len(sizes) + 1)) AS u(i)")
def retrieval_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the units themselves; here their sizes."""
    units = segment.retrieval_units(read(spark, sf_dir, "documents").select("doc_id", "text"), [120])
    return units.select("doc_id", "word_limit", F.col("chunk_index").cast("long").alias("chunk_index"), T.word_count(F.col("unit")).alias("words"))


FLAGS = r"""
counted AS (
  SELECT *, CAST(len(regexp_extract_all(u, '\S+')) AS BIGINT) AS words, CAST(length(u) AS BIGINT) AS chars, coalesce(list_max(list_transform(regexp_extract_all(u, '\S+'), lambda x: length(x))), 0) AS max_word_len,
    len(regexp_extract_all(u, '\S{40,}')) AS long40, len(regexp_extract_all(u, '\S{80,}')) AS long80, len(regexp_extract_all(u, '[\p{Nd}²³¹]')) AS digit_chars, len(regexp_extract_all(u, '\p{L}')) AS alpha_chars,
    length(u) - len(regexp_extract_all(u, '[\p{L}\p{N}]')) - len(regexp_extract_all(u, '\s')) AS punct_chars,
    CAST(len(regexp_extract_all(u, '(?i)(?:[A-Za-zÀ-žʻʼ‘’''`][0-9]|[0-9][A-Za-zÀ-žʻʼ‘’''`])')) AS BIGINT) AS transitions, CAST(len(regexp_extract_all(u, '\d{8,}')) AS BIGINT) AS digit_runs,
    regexp_matches(u, '(?i)(?:\blink=|\bFayl:|upload\.wikimedia|wikimedia\.org|\bframeless\b|\bthumb\b|\balt=|[0-9]{2,4}x[0-9]{2,4}px)') AS wiki_markup, regexp_matches(u, '(?i)(?:https?://|www\.|%[0-9A-F]{2})') AS url_markup
  FROM given),
ratios AS (SELECT *, digit_chars / greatest(1, chars) AS digit_ratio, alpha_chars / greatest(1, chars) AS alpha_ratio, punct_chars / greatest(1, chars) AS punct_ratio FROM counted),
tests AS (
  SELECT *, wiki_markup OR url_markup AS markup, transitions >= 10 OR digit_runs >= 2 OR (digit_ratio >= 0.25 AND transitions >= 4) OR long80 >= 1 OR long40 >= 3 AS collapsed,
    digit_ratio >= 0.25 AS heavy, punct_ratio >= 0.25 AND alpha_ratio < 0.60 AS symbols FROM ratios),
flags AS (
  SELECT *, markup OR collapsed AS core_flag,
    list_filter([CASE WHEN markup THEN 'MARKUP_ARTIFACT' END, CASE WHEN collapsed THEN 'COLLAPSED_TABLE_OR_GLUE' END, CASE WHEN heavy THEN 'DIGIT_HEAVY' END, CASE WHEN symbols THEN 'SYMBOL_HEAVY' END, CASE WHEN max_word_len >= 80 THEN 'VERY_LONG_SURFACE_TOKEN' END], lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN markup AND collapsed THEN 'MARKUP_AND_STRUCTURED' WHEN markup THEN 'MARKUP_ARTIFACT' WHEN collapsed THEN 'STRUCTURED_OR_COLLAPSED' WHEN heavy OR symbols THEN 'REVIEW_SURFACE' ELSE 'PROSE_LIKE' END AS label
  FROM tests)
"""
DOC_FLAGS = f"WITH given AS (SELECT doc_id, source, {NORM} AS u FROM documents), {FLAGS}"


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", T.normalize_text(F.col("text")).alias("unit"))
    return profile.structural_flags(docs)


@query(f"{DOC_FLAGS} SELECT doc_id, label, core_flag, array_to_string(reasons, '|') AS reasons, words, transitions, digit_runs, round(digit_ratio, 6) AS digit_ratio, round(alpha_ratio, 6) AS alpha_ratio, round(punct_ratio, 6) AS punct_ratio FROM flags")
def structural_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surface flags of whole documents."""
    return rounded(document_flags(spark, sf_dir).select("doc_id", "label", "core_flag", F.array_join("reasons", "|").alias("reasons"), "words", "transitions", "digit_runs", "digit_ratio", "alpha_ratio", "punct_ratio"))


@query(f"""{DOC_FLAGS} SELECT source, count(*) AS units, count(*) FILTER (core_flag) AS flagged, round(100.0 * count(*) FILTER (core_flag) / count(*), 6) AS flagged_pct,
  {', '.join(f"count(*) FILTER (list_contains(reasons, '{r}')) AS {r.lower()}" for r in profile.REASONS)},
  round(100.0 * count(*) FILTER (words > 480) / count(*), 6) AS overflow_pct, round(100.0 * count(*) FILTER (words > 480 AND NOT core_flag) / greatest(1, count(*) FILTER (NOT core_flag)), 6) AS unflagged_overflow_pct
FROM flags GROUP BY source""")
def structural_quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged documents of each source."""
    return rounded(profile.structural_profile(document_flags(spark, sf_dir), ("source",), 480))


@query(f"{DOC_FLAGS} SELECT source, doc_id, nth, label FROM (SELECT source, doc_id, label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM flags WHERE core_flag) WHERE nth <= 3")
def flagged_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flagged documents of each source."""
    return profile.flagged_examples(document_flags(spark, sf_dir), 3, ("doc_id",)).select("source", "doc_id", "nth", "label")


# ---- C: classes and validation -------------------------------------------------------------------------------------------

CLEAN_SQL = "given.u"
for _rule in refine.CLEANUP:
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '{_rule.replace('(?iu)', '(?i)')}', ' ', 'g')"
CLEAN_SQL = rf"trim(regexp_replace(regexp_replace({CLEAN_SQL}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
REFINED = rf"""
cleaned AS (SELECT *, {CLEAN_SQL} AS c FROM given),
toks AS (SELECT *, list_transform(regexp_extract_all(c, '\S+'), lambda t: {{'len': length(t), 'turns': len(regexp_extract_all(t, '(?i)(?:[A-Za-zÀ-žʻʼ‘’''`][0-9]|[0-9][A-Za-zÀ-žʻʼ‘’''`])')), 'digits': len(regexp_extract_all(t, '[\p{{Nd}}²³¹]')) / length(t)}}) AS t FROM cleaned),
seen AS (
  SELECT *, len(t) AS words, len(regexp_extract_all(u, '\S+')) AS raw_words, len(regexp_extract_all(c, '[\p{{Nd}}²³¹]')) / greatest(1, length(c)) AS digit_ratio, len(regexp_extract_all(c, '\d{{8,}}')) AS digit_runs,
    len(list_filter(t, lambda x: x.len >= 40)) AS long40, len(list_filter(t, lambda x: x.len >= 80)) AS long80,
    len(list_filter(t, lambda x: (x.len >= 50 AND x.turns >= 3) OR (x.len >= 40 AND x.digits >= 0.35 AND x.turns >= 2))) AS glued, len(list_filter(t, lambda x: x.len >= 30 AND x.turns >= 2)) > 0 AS mixed30,
    regexp_matches(u, '{refine.RAW_MARKUP.replace("(?iu)", "(?i)")}') OR c <> trim(u, ' ' || chr(10) || chr(9)) AS markup
  FROM toks),
labelled AS (SELECT *, CASE WHEN long80 > 0 OR glued > 0 OR (long40 >= 2 AND digit_ratio >= 0.08) OR (digit_runs >= 2 AND mixed30) THEN 'SEVERE_STRUCTURAL' WHEN markup THEN 'CLEANABLE_MARKUP' ELSE 'PROSE_LIKE' END AS label FROM seen)
"""
DOC_REFINED = f"WITH given AS (SELECT doc_id, source, coalesce(text, '') AS u FROM documents), {REFINED}"


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("unit"), F.lit(0).alias("word_limit"))
    return refine.refined_labels(docs)


@query(f"{DOC_REFINED} SELECT doc_id, label, CAST(words AS BIGINT) AS words, markup, CAST(long40 AS BIGINT) AS long40, CAST(glued AS BIGINT) AS glued, round(digit_ratio, 6) AS digit_ratio FROM labelled")
def refined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after cleanup."""
    return rounded(document_labels(spark, sf_dir).select("doc_id", "label", "words", "markup", "long40", "glued", "digit_ratio"))


@query(f"""{DOC_REFINED} SELECT source, CAST(0 AS INTEGER) AS word_limit, count(*) AS units,
  {', '.join(f"count(*) FILTER (label = '{c}') AS {c.lower()}, round(100.0 * count(*) FILTER (label = '{c}') / count(*), 6) AS {c.lower()}_pct" for c in refine.CLASSES)},
  count(*) FILTER (raw_words > 480) AS raw_overflow, count(*) FILTER (label <> 'SEVERE_STRUCTURAL' AND words > 480) AS residual_overflow,
  round(100.0 * count(*) FILTER (label <> 'SEVERE_STRUCTURAL' AND words > 480) / greatest(1, count(*) FILTER (label <> 'SEVERE_STRUCTURAL')), 6) AS residual_overflow_pct
FROM labelled GROUP BY source""")
def refined_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each source and what overflow is left."""
    return rounded(refine.refined_summary(document_labels(spark, sf_dir), 480))


JUDGED = f"{DOC_REFINED}, pairs AS (SELECT CASE WHEN label = 'PROSE_LIKE' THEN 1 ELSE 0 END AS predicted, quality AS human, source FROM labelled JOIN labels USING (doc_id))"


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("label") == "PROSE_LIKE", 1).otherwise(0).alias("predicted")
    return document_labels(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select("source", predicted, F.col("quality").cast("int").alias("human"))


@query(f"{JUDGED} SELECT predicted, count(*) FILTER (human = 0) AS human_0, count(*) FILTER (human = 1) AS human_1 FROM pairs GROUP BY predicted")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted classes against human labels."""
    return refine.confusion(judged_pairs(spark, sf_dir), "predicted", "human", (0, 1))


@query(f"""{JUDGED}, c AS (SELECT cls AS class, count(*) FILTER (predicted = cls AND human = cls) AS tp, count(*) FILTER (predicted = cls AND human <> cls) AS fp, count(*) FILTER (predicted <> cls AND human = cls) AS fn FROM pairs, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 'NaN'::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 'NaN'::DOUBLE END AS recall, tp + fp AS n FROM c)
SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN isnan(precision + recall) OR precision + recall = 0 THEN 'NaN'::DOUBLE ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1,
  round(CASE WHEN n > 0 THEN greatest(0, (precision + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(precision * (1 - precision) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) ELSE 'NaN'::DOUBLE END, 6) AS precision_low,
  round(CASE WHEN n > 0 THEN least(1, (precision + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(precision * (1 - precision) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) ELSE 'NaN'::DOUBLE END, 6) AS precision_high
FROM m""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and Wilson intervals."""
    return rounded(refine.class_metrics(judged_pairs(spark, sf_dir), "predicted", "human", (0, 1)).select("class", "tp", "fp", "fn", "precision", "recall", "f1", "precision_low", "precision_high"))


@query(f"{JUDGED} SELECT source, count(*) FILTER (predicted = 0) AS shown, count(*) FILTER (predicted = 0 AND human = 0) AS right_ones, round(CASE WHEN count(*) FILTER (predicted = 0) > 0 THEN count(*) FILTER (predicted = 0 AND human = 0) / count(*) FILTER (predicted = 0) END, 6) AS precision FROM pairs GROUP BY source")
def source_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of one class in each source."""
    shown, right = F.count_if(F.col("predicted") == 0), F.count_if((F.col("predicted") == 0) & (F.col("human") == 0))
    return rounded(judged_pairs(spark, sf_dir).groupBy("source").agg(shown.alias("shown"), right.alias("right_ones"), F.when(shown > 0, right / shown).alias("precision")))


@query(f"{DOC_REFINED} SELECT source, label, count(*) AS available, least(count(*), 5) AS selected FROM labelled GROUP BY ALL")
def blind_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified blind sample; here what each stratum had and gave."""
    rows = written(document_labels(spark, sf_dir).select("source", "label", F.col("doc_id").cast("string").alias("sample_id")), "labels")
    blind, key = refine.blind_and_key(refine.stratified_sample(rows, 5, SEED), (), ("source", "label"))
    picked = blind.join(key, "sample_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("selected"))
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("available")).join(picked, ["source", "label"])
