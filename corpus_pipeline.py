"""Corpus pipeline: language ID, quality, near-duplicates, mixing, tokens. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.llm import bpe, langid, mixing, quality, simhash
from serialake.llm.common import table
from serialake.llm.queries import RANKS, trusted_ids

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LEAD = 1 / 15  # of the way from even shares of all learned languages (0) to certainty (1)


def least_score(languages: int) -> float:
    """The score from which a language fits clearly better than the others: equal ones have 1 / ``languages`` each, so a text in a
    script that no language knows stays below, however many are learned (0.53 for two, 0.3 for four; a single one is never doubted)."""
    return (1 + LEAST_LEAD * (languages - 1)) / max(1, languages)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` as predicted; rejected: no text or letters, or no clear language."""
    model = langid.fit(docs)
    found = langid.with_language(docs.select(*DOCUMENT), model)
    clear = F.col("score") >= least_score(len(model.languages))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & clear).withColumn("lang", F.col("lang_pred")).select(*DOCUMENT)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return quality.keep_good(docs, trusted_ids(spark, sf_dir)).select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, overlap 0.8 or more."""
    return simhash.keep_one(docs).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document once per epoch it is taken in, so an id may repeat; whole texts only.

    The document at a source's cut stays if at least half of it fits the budget.
    """
    mixed = mixing.mix_sources(docs)
    times = F.col("epochs") + F.when(F.col("cut_words") * 2 >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    return mixed.withColumn("time", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*DOCUMENT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    return bpe.encode_texts(docs, ranks_path=public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("quality_classifier", quality_filter), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("bpe", tokens)]

ORACLE_SQL = None  # fitted models and hashes have no SQL twin; the tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
