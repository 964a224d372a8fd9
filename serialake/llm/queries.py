"""The corpus operators on the shared tables, and the SQL they must agree with where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.llm import bpe, langid, main_text, media, mixing, quality, runs, sharding, simhash, topk, toxicity, url_filter, variants
from serialake.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = docs.withColumns({"size": sharding.text_bytes(F.col("text")) + 8,
                                 "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint")})
    return sharding.shard_by_bytes(measured, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.score_texts(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.default_labels(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.texts_as_media(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs", "cut_words")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, trusted_ids(spark, sf_dir)).select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.bit_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(table(spark, sf_dir, "documents"), least_length=6, least_count=5, typo_every=199)
    return variants.spelling_variants(words, ratio=5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), least=24, times=3, prepare=runs.plant_period)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_toxicity, op4_top_k, op5_url_filter, op6_media, op7_mixing, op8_quality, op9_bpe, op10_simhash,
                                  op11_spelling, op12_periodic_runs, op13_main_text)}

ORACLES = {
    "op4_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
}
