"""A corpus pipeline: five stages, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import langid, mixing, packing, passages, simhash
from scorewright.llm.common import maybe_among, written
from scorewright.session import settled

# A text whose n-grams fit no learned language better than this is rejected.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language."""
    profiles = langid.fit_profiles(docs)
    found = langid.identify(docs, profiles)
    fits = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(fits).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, which rises with doc_id; null ids come last.

    Rows are told apart by it where ids are null or repeated.  It is written, so all
    later passes see the same numbers.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    return written(docs.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep one row, that with the smallest id.

    Rows with a null id are the last choice, and kept where they are alone; rows that
    repeat an id are documents of their own.
    """
    rows = _numbered(docs)
    groups = simhash.near_duplicates(rows.select("_row", "text"), key="_row")
    later = written(groups.filter(F.col("_row") != F.col("component_id")).select("_row"), "later-rows")
    # Only rows that may go are moved to those that do.
    marked = maybe_among(rows, later).select(*rows.columns, "_maybe")
    met = marked.filter("_maybe").join(later, "_row", "left_anti")
    return marked.filter("not _maybe").select(*docs.columns).union(met.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that a document with a smaller id has; drop what is then empty.

    Rows with null or repeated ids are documents of their own, null ids the last.
    """
    rows = _numbered(docs)
    found = passages.repeated_passages(rows.select("_row", "text"), key="_row")
    left = passages.without_passages(rows, written(found, "passages"), key="_row")
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", chars).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample the documents to the target mix of sources, languages and topics.

    A document whose rate is above 1 is repeated: as often as the whole part says, and
    once more with the probability of the rest.  So the targets are met in rows.
    """
    # Null or repeated ids would be drawn all together.
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    mixed = mixing.mix(keyed, key="_key").filter("sampled")
    more = F.pmod(F.xxhash64("_key", F.lit("more")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor("weight") + (more < F.col("weight") - F.floor("weight")).cast("int")
    repeated = mixed.withColumn("_time", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return repeated.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of sequences of like length."""
    return packing.pack(docs.select("doc_id", "text"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# Profiles, fingerprints and raking are not SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, name, partial(stage, spark, docs, sf_dir))
    return docs
