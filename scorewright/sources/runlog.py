"""The append-only run log: one row per transaction and model run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.schemas import LOG_COLUMNS, LOG_DISPLAY_ORDER, LOG_SCHEMA
from scorewright.sources.quoted_csv import read_quoted_csv

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Answers may hold line ends and quotes, so both need care in CSV.
_CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def log_rows(
    df: DataFrame,
    model_name: Column,
    prompt_variant: Column | None = None,
    reason: Column | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """Log rows from scored or answered transactions.

    ``df`` has ``transaction_id``, ``label``, ``predicted_label`` and
    ``predicted_prob``.
    """
    blank = F.lit("")
    return df.select(
        "transaction_id",
        F.col("label").cast("int").alias("true_label"),
        F.col("predicted_label").cast("string").alias("predicted_label"),
        F.col("predicted_prob").cast("double").alias("predicted_prob"),
        model_name.alias("model_name"),
        (blank if prompt_variant is None else F.coalesce(prompt_variant, blank)).alias(
            "prompt_variant"
        ),
        (blank if reason is None else reason).alias("reason"),
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
    )


def to_log_columns(df: DataFrame) -> DataFrame:
    """The eight columns in order and type; missing ones become null."""
    return df.select(
        [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_SCHEMA
        ]
    )


def append(df: DataFrame, path: str, run: str | None = None) -> None:
    """Append a run.  The log is partitioned by model, so reading one model is pruned.

    Each run has a folder of its own in those of its models, which becomes visible as a
    whole when all of it is written.  A run with a name may be repeated: it replaces
    what it logged before for the same models, so a retried run is in the log once.
    """
    rows = to_log_columns(df).withColumn("run", F.lit(run or uuid.uuid4().hex))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model_name", "run").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log with its fixed schema; a missing log raises."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).select(LOG_COLUMNS)


def export_csv(df: DataFrame, path: str) -> None:
    stamped = to_log_columns(df).withColumn("timestamp", F.date_format("timestamp", STAMP_FORMAT))
    stamped.write.mode("append").options(**_CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log; a large file is read by many tasks, though its reasons hold line ends."""
    return read_quoted_csv(spark, path, LOG_SCHEMA, timestampFormat=STAMP_FORMAT)


def complete(df: DataFrame) -> DataFrame:
    """Add whatever log column a foreign log lacks: null probability, else blank."""
    missing = [c for c in LOG_COLUMNS if c not in df.columns]
    fill = {
        c: F.lit(None).cast("double") if c == "predicted_prob" else F.lit("") for c in missing
    }
    return df.withColumns(fill) if fill else df


def read_tolerant(
    spark: SparkSession, path: str, file_format: str = "parquet"
) -> DataFrame | None:
    """A log with whatever columns it has, completed; None if there is none.

    Known columns of a CSV log get their types, and null where a value does not fit.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return None
    if file_format == "parquet":
        return complete(spark.read.parquet(path))
    found = spark.read.options(**_CSV_OPTIONS).csv(path)
    typed = {
        f.name: F.col(f.name).try_cast(f.dataType) for f in LOG_SCHEMA if f.name in found.columns
    }
    return complete(found.withColumns(typed))


def of_model(log: DataFrame, model_name: str) -> DataFrame:
    """Rows of one model."""
    return log.filter(F.col("model_name") == model_name)


def latest_only(log: DataFrame) -> DataFrame:
    """The newest row per transaction and model, for logs with repeated runs."""
    row = F.struct([F.col(c) for c in LOG_COLUMNS])
    order = F.struct("timestamp", "predicted_label", "predicted_prob", "reason")
    newest = log.groupBy("transaction_id", "model_name").agg(F.max_by(row, order).alias("row"))
    return newest.select("row.*")


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Runs of several models as one log."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return to_log_columns(first)


def sample(log: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the rows with the smallest salted hash."""
    key = F.md5(
        F.concat_ws(
            ":",
            F.lit(str(seed)),
            F.col("transaction_id").cast("string"),
            "model_name",
            F.date_format("timestamp", STAMP_FORMAT),
        )
    )
    return log.orderBy(key, "transaction_id", "model_name").limit(rows)


def display(df: DataFrame) -> DataFrame:
    """Available columns in reading order, as text with blanks for missing values."""
    shown = [c for c in LOG_DISPLAY_ORDER if c in df.columns]
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])
