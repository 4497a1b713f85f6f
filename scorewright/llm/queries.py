"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import (
    alignment,
    langid,
    lexical,
    licences,
    mixing,
    packing,
    passages,
    quality,
    scoring,
    sharding,
    simhash,
    suffixes,
    topk,
)
from scorewright.llm.common import documents, held_out, table

LANGUAGE_FOLDS = 4
MODEL_FOLDS = 7


def op1_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf).select("doc_id", "text"))


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), LANGUAGE_FOLDS)
    profiles = langid.fit_profiles(docs.filter(~held))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return quality.quality(docs, table(spark, sf, "labels")).drop("text")


def op4_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return scoring.lm_scores(docs, held_out(F.col("doc_id"), MODEL_FOLDS))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).drop("text")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf).select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf).select("doc_id", "text"))


def op8_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return licences.scan(docs, licences.document_counts(docs)).drop("text")


def op9_pivots(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.pivot_top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.ring_shards(documents(spark, sf).select("doc_id", "text"))
    return placed.withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    aligned, _ = alignment.align(documents(spark, sf).select("doc_id", "text"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return lexical.search(docs, table(spark, sf, "benchmark"))


def op13_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf).select("doc_id", "text")).drop("spans")


QUERIES = {
    query.__name__: query
    for query in (
        op1_passages,
        op2_language,
        op3_quality,
        op4_scoring,
        op5_mixing,
        op6_simhash,
        op7_packing,
        op8_licences,
        op9_pivots,
        op10_sharding,
        op11_alignment,
        op12_lexical,
        op13_suffixes,
    )
}
