"""The registered queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import op01_divergence, op02_suffixes, op03_audio, op04_classifier, op05_language, op06_simhash, op07_bpe, op08_toxicity, op09_licenses, op10_packing

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_divergence.divergence(_table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_suffixes.repeats(_table(spark, sf_dir, "documents"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each document taken as samples, since no table has sound."""
    return op03_audio.audio(_table(spark, sf_dir, "documents"), "text")


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_language.identify(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_simhash.classes(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_bpe.encoded(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_licenses.scan(_table(spark, sf_dir, "documents"))


def op10_packing_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.packed(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_divergence": op1_divergence,
    "op2_suffixes": op2_suffixes,
    "op3_audio": op3_audio,
    "op4_classifier": op4_classifier,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing_,
}

ORACLE_SQL: dict[str, str] = {
    "op1_divergence": op01_divergence.sql(),
    "op2_suffixes": op02_suffixes.sql(),
    "op9_licenses": op09_licenses.sql(),
}
