"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, ctw, exact_dedup, minhash, packing, pii, quality_model, quality_rules, repeats, toxicity
from .tables import documents, labels


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op3_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.cut(documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(documents(spark, sf_dir))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_run_length_repeats": op3_run_length_repeats,
        "op4_quality_rules": op4_quality_rules,
        "op5_attention_quality": op5_attention_quality,
        "op6_context_tree": op6_context_tree,
        "op7_harmonic_packing": op7_harmonic_packing,
        "op8_prefix_bpe": op8_prefix_bpe,
        "op9_string_kernel_toxicity": op9_string_kernel_toxicity,
        "op10_personal_data": op10_personal_data,
    }


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
                 g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    }
