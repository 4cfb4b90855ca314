"""The pipelines from inputs to written results."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import assemble, discovery, profile, refine, sample, segment, targets
from textquarry.sources import sinks

from .config import DiscoveryConfig, ProfileConfig, RefineConfig


def corpus_profile(docs: DataFrame, out: str, config: ProfileConfig = ProfileConfig()) -> dict[str, DataFrame]:
    """Profile, segmentation, structural audit and recommendation of documents (source, doc_id, title, text)."""
    picked = sample.hash_sample(docs, config.sample_size, config.seed, "doc_id", ("source",)).persist()
    units = segment.retrieval_units(picked, [config.audit_limit], title="title")
    flags = profile.structural_flags(units)
    segmentation = profile.segmentation_profile(picked, list(config.word_limits), title="title")
    results = {
        "source_profile": profile.source_profile(picked),
        "segmentation_profile": segmentation,
        "recommendation": profile.recommend_limit(segmentation, config.most_overflow_pct, config.p99_target),
        "structural_profile": profile.structural_profile(flags),
        "structural_examples": profile.flagged_examples(flags, config.example_cap),
    }
    for name, df in results.items():
        sinks.write_csv(df, f"{out}/{name}")
    sinks.write_jsonl(docs.sparkSession.createDataFrame([(json.dumps(asdict(config)),)], "config string"), f"{out}/run_config")
    picked.unpersist()
    return results


def structural_discovery(pages: DataFrame, out: str, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """Features of all pages go to Parquet once; every ranking reads that table, and texts join back for the selected ids alone."""
    if config.max_pages:
        pages = pages.limit(config.max_pages)
    spark = pages.sparkSession
    sinks.write_csv(discovery.census(pages), f"{out}/census")
    sinks.write_csv(discovery.namespace_counts(pages), f"{out}/namespaces")
    usable = pages.where((F.col("namespace") == "0") & ~F.col("is_redirect") & (T.strip(F.col("raw")) != ""))
    discovery.signatures(discovery.page_features(usable)).write.mode("overwrite").parquet(f"{out}/features")
    table = spark.read.parquet(f"{out}/features")
    narrow = table.drop("raw", "extracted")
    counts = discovery.signature_counts(narrow)
    sinks.write_csv(counts, f"{out}/signature_counts")
    none, one = F.lit(None).cast("long"), F.lit(1)
    chosen = discovery.baseline_sample(narrow, config.baseline, config.seed).select("page_id", F.lit("BASELINE").alias("reason"), F.lit(0).alias("ord"), none.alias("population"))
    for n, axis in enumerate(("raw_signature", "extracted_signature")):
        own = counts.where(F.col("axis") == axis)
        for m, (kind, picked, k) in enumerate((("FREQUENT", discovery.frequent_signatures(own, config.frequent), 2), ("RARE", discovery.rare_signatures(own, config.rare_pages, config.rare_take, config.seed), 1))):
            wanted = picked.select(F.col("signature").alias(axis), "pages")
            examples = discovery.signature_examples(narrow.join(wanted, axis), axis, k, config.seed)
            chosen = chosen.unionAll(examples.select("page_id", F.concat(F.lit(f"{kind}:"), F.col(axis)), F.lit(1 + 2 * n + m), "pages"))
    outliers = discovery.top_k(narrow, discovery.outlier_axes(narrow), config.outliers_per_axis)
    chosen = chosen.unionAll(outliers.select("page_id", F.concat(F.lit("OUTLIER:"), "axis"), 5 * one, none))
    for n, column in enumerate(("raw", "extracted")):
        inventory = discovery.unicode_inventory(table, column, "page_id", config.seed, column)
        sinks.write_csv(inventory, f"{out}/unicode_{column}")
        rare = discovery.rare_characters(inventory, config.rare_character_count, config.rare_characters, config.seed)
        chosen = chosen.unionAll(rare.select(F.col("example").alias("page_id"), F.concat(F.lit("UNICODE:"), "codepoint"), F.lit(6 + n), none))
    candidates = discovery.in_batches(discovery.review_candidates(chosen, config.cap, config.seed), config.batch_size)
    full = discovery.with_excerpts(table.join(candidates, "page_id"), ("raw", "extracted"), config.excerpt_chars)
    review = F.struct(F.lit("").alias("decision"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("reason"), F.lit("").alias("notes"))
    sinks.write_batches(full.withColumn("candidate_id", F.concat(F.lit("UZWP-"), "page_id")).withColumn("review_fields", review), f"{out}/batches")
    return candidates


def classification(docs: DataFrame, out: str, config: RefineConfig = RefineConfig()) -> dict[str, DataFrame]:
    """Classes at several limits with examples and residual overflow, and a blind sample with its key."""
    labels = refine.refined_labels(segment.retrieval_units(docs, list(config.word_limits), title="title"))
    ids = T.stable_id(F.col("source"), F.col("doc_id"), F.col("chunk_index"), F.col("unit"))
    rows = labels.where(F.col("word_limit") == config.sample_limit).withColumn("sample_id", ids)
    blind, key = refine.blind_and_key(refine.stratified_sample(rows, config.per_stratum, config.seed), ("source", "unit"), ("source", "doc_id", "chunk_index", "label", "max_word_len", "digit_ratio", "transitions"))
    results = {"summary": refine.refined_summary(labels, config.most_words), "examples": refine.label_examples(labels, config.example_cap), "residual": refine.residual_rows(labels, config.most_words), "validation_blind": blind, "validation_key": key}
    for name, df in results.items():
        sinks.write_csv(df, f"{out}/{name}")
    return results


def full_pages(pages: DataFrame, batches: DataFrame, out: str) -> DataFrame:
    """The pages that review batches ask for, each batch's in order, with an index; incomplete batches are an error at the end."""
    members = targets.batch_members(batches)
    hits = targets.found(pages, members)
    ordered = members.join(hits, "page_id").orderBy("global_position")
    sinks.write_batches(ordered, f"{out}/pages")
    manifest = targets.batch_manifest(targets.index(batches, hits, ["title"]))
    sinks.write_csv(manifest, f"{out}/manifest")
    assemble.require(manifest.where("not complete"), "batches lack pages")
    return manifest


def assemble_decisions(batches: list[DataFrame], master: DataFrame, corrections: DataFrame, expected: int, out: str | None = None, key: str = "canonical_id") -> DataFrame:
    """All batches as one checked table: unique keys, complete order, the master's ids, corrections applied, every rule kept."""
    rows = assemble.normalize_decisions([(b, {}) for b in batches])
    assemble.require(assemble.key_violations(rows, key), "keys aren't unique")
    assemble.require(assemble.set_difference(rows, master, [key]), "ids differ from the master's")
    assemble.require(assemble.order_violations(rows, "screening_order", expected), "the order has gaps")
    final = assemble.apply_overlay(rows, corrections, key)
    assemble.require(assemble.decision_violations(final, key), "decisions break rules")
    final = final.join(master.select(key, *[F.col(c).alias(f"preparation_{c}") for c in master.columns if c != key]), key)
    if out:
        Path(out).mkdir(parents=True, exist_ok=True)
        Path(out, "decisions.csv").write_bytes(sinks.csv_bytes(final, [key, "screening_order"], ["screening_order"]))
        sinks.write_parquet(final, f"{out}/decisions.parquet")
        sinks.write_manifest(f"{out}/manifest.json", {"expected": expected}, {"decisions.csv": f"{out}/decisions.csv"}, {})
    return final


def batch_positions(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.orderBy(order)))
