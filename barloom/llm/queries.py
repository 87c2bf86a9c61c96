"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import credentials, divergence, forest, importance, lattice, licenses, lines, neardup, packing, pieces, quality, repeats, toxicity
from barloom.llm.text import table


def op1_ann_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.neighbours(table(spark, folder, "embeddings"))


def op2_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.cluster(table(spark, folder, "documents"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op8_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digests(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"))


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digests(table(spark, folder, "documents"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_ann_forest, op2_lattice_score, op3_toxicity, op4_suffix_dedup, op5_minhash_near_dedup, op6_sentencepiece, op7_license_scan,
                                   op8_line_templates, op9_packing, op10_quality_rules, op11_secret_scan, op12_importance_resampling,
                                   op13_source_divergence)}
ORACLES = {
    "op4_suffix_dedup": repeats.oracle_sql(),
    "op5_minhash_near_dedup": neardup.oracle_sql(),
    "op7_license_scan": licenses.oracle_sql(),
    "op8_line_templates": lines.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
    "op12_importance_resampling": importance.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
