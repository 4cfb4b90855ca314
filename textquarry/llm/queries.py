"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, mixing, neardup, quality, secrets, sharding, suffixes, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        neardup.op1_minhash,
        fingerprint.op2_fingerprints,
        sharding.op3_sharding,
        decontaminate.op4_decontamination,
        quality.op5_quality,
        tokens.op6_tokens,
        suffixes.op7_suffixes,
        toxicity.op8_toxicity,
        mixing.op9_mixing,
        secrets.op10_secrets,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.OP4_SQL, "op9_mixing": mixing.OP9_SQL}
