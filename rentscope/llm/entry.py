"""Registered queries of the package: one per operator, over whole tables, and the pipeline."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collapse, decontaminate, langid, lm_score, merkle, minhash, packing, quality_pu, rules, secrets, suffixes, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secrets(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op3_warc(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.op4_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op5_lm_score(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op6_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7_language_id(table(spark, sf_dir, "documents"))


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.op8_chat_collapse(table(spark, sf_dir, "conversations"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9_best_fit_packing(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op10_minhash_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11_embedding_whitening(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op12_suffix_dedup(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_merkle_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_secrets, op3_warc, op4_quality_classifier, op5_lm_score, op6_quality_rules, op7_language_id,
        op8_chat_collapse, op9_best_fit_packing, op10_minhash_dedup, op11_embedding_whitening, op12_suffix_dedup,
        op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op3_warc": warc.ORACLE, "op8_chat_collapse": collapse.ORACLE, "op12_suffix_dedup": suffixes.ORACLE,
            "op13_merkle_manifest": merkle.ORACLE}
