"""Metrics kept up to date while the log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scorewright.operators.evaluate import confusion_counts, metrics_from_counts
from scorewright.schemas import LOG_SCHEMA


def follow(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream of appended files."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def metrics_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Metrics per model over all rows so far; the state is four counts per model."""
    return metrics_from_counts(confusion_counts(follow(spark, path, files_per_batch)))


def start(
    spark: SparkSession,
    path: str,
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in what the log holds now and write the metrics after each batch to ``target``.

    Every batch replaces its own folder, so a batch repeated after a failure leaves
    one result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = metrics_stream(spark, path, files_per_batch)
    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
