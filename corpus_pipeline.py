"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents that stay.

Nulls and edge cases are those of the operators: a document without text is
rejected by the first stage; of rows with repeated or null ids the third keeps
one for each group of near duplicates, as of others.
Extra columns of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm import bpe, contamination, language, quality, simhash
from amplispark.llm.common import discard, fresh, written
from amplispark.llm.queries import tokenizer_path
from amplispark.session import ship, table

#: Least posterior of a language for a document to stay.
MIN_LANGUAGE_SCORE = 0.5
#: Quantile of the fit of a language's learning rows that a document has to reach.
LANGUAGE_FIT = 0.001


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most their language's quantile."""
    ship(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a sure enough score and n-grams as likely as in its learning rows.

    The posterior alone says which language is nearest, not that a text is in it.
    """
    ship(spark)
    langs, model = language.fit(docs.where(~language.held_out()))
    name = fresh(docs, "language")
    got = written(docs.withColumn(name, language.predictor(langs, model, docs)("text")), "languages")
    learned = got.where(~language.held_out() & (F.col("lang") == F.col(f"{name}.lang")))
    least = F.lit(None).cast("double")
    for r in learned.groupBy("lang").agg(F.percentile_approx(f"{name}.fit", LANGUAGE_FIT, quality.ACCURACY).alias("least")).collect():
        least = F.when(F.col(f"{name}.lang") == r["lang"], r["least"]).otherwise(least)
    fits = F.coalesce(F.col(f"{name}.fit") >= least, F.lit(False))
    return got.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE) & fits).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the documents' ids and of the text they decode to."""
    ship(spark)
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
            discard(before)
    return docs
