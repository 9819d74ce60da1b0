"""The queries of this subpackage over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table
from . import ann, bpe, contamination, html, language, license_scan, orc_tokens, quality, simhash, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return orc_tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html.main_text(table(spark, sf_dir, "pages"))


_all = (op1_cross_polytope, op2_token_orc, op3_decontamination, op4_simhash, op5_warc, op6_license_scan, op7_quality, op8_bpe, op9_language, op10_main_text)
QUERIES = {f.__name__: f for f in _all}
ORACLE_SQL = {"op3_decontamination": contamination.ORACLE, "op5_warc": warc.ORACLE}
