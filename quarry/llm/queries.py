"""The queries of this subpackage: production parameters, whole tables, full results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    decontaminate,
    language_id,
    lexical,
    line_dedup,
    merkle,
    near_dedup,
    oracles,
    pii,
    quality_model,
    quality_rules,
    source_mix,
    suffix_dedup,
    token_counts,
    toxicity,
)
from quarry.session import table

TOKENIZER = os.environ.get("QUARRY_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), near_dedup.THRESHOLD)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.source_mix(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy keeps out, and what only it does, from op2's ledger."""
    led = quality_rules.ledger(quality_rules.measurements(table(spark, sf_dir, "documents")))
    return quality_rules.ablation(led, quality_rules.PRODUCTION_POLICY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0]))) | {"quality_ablation": quality_ablation}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": oracles.OP1,
        "op2_quality_rules": oracles.OP2,
        "op3_line_dedup": oracles.OP3,
        "op7_decontaminate": oracles.OP7,
        "op8_source_mix": oracles.OP8,
        "op11_lexical_search": oracles.OP11,
        "op12_merkle_manifest": oracles.OP12,
        "quality_ablation": oracles.ABLATION,
    }
