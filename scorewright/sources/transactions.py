"""Reading transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.amounts import txn_text, txn_text_short
from scorewright.functions.labels import label_to_int
from scorewright.operators.ranking import row_index
from scorewright.session import materialise


def read_table(
    spark: SparkSession, path: str, file_format: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """A table with a header.

    The path goes to Spark as it is, so it may name any file system; a missing one
    raises.  Without a schema a CSV is scanned once more to find the types.
    """
    if not path.strip():
        raise ValueError("the path is empty")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return reader.format(file_format).load(path)


def _landed(df: DataFrame, file_format: str) -> DataFrame:
    """A CSV once as Parquet: later steps pass over few columns several times."""
    return materialise(df, "transactions") if file_format == "csv" else df


# What fixes the row order of a file scan: the file, the block read of it, the place in the task.
_FILE_ORDER = ["_file", "_block", "_slot"]


def _with_file_order(scan: DataFrame) -> DataFrame:
    place = [
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    ]
    return scan.select("*", *[c.alias(n) for c, n in zip(place, _FILE_ORDER)])


def standardise(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Label as 0/1, a text column, and an id where there is none.

    A new id needs ``order_by``, the columns that fix the row order.
    """
    if "Class" in df.columns:
        df = df.withColumnRenamed("Class", "label")
    if "label" not in df.columns:
        raise ValueError("the table needs a Class or label column")
    if "transaction_id" not in df.columns:
        if not order_by:
            raise ValueError("a table without transaction_id needs order_by columns")
        df = row_index(df, order_by)
    return df.withColumns(
        {
            "txn_text": txn_text(df),
            "label": label_to_int(F.col("label"), df.schema["label"].dataType),
        }
    )


def standardise_strict(df: DataFrame) -> DataFrame:
    """Legacy form: any row with a null is dropped, and the text has no id."""
    if "Class" in df.columns:
        df = df.withColumnRenamed("Class", "label")
    number_columns = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    complete = df.replace(float("nan"), None, subset=number_columns) if number_columns else df
    return complete.na.drop("any").withColumn("txn_text", txn_text_short(df))


def load_transactions(
    spark: SparkSession,
    path: str,
    file_format: str = "csv",
    schema: T.StructType | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """A transaction table; one without ids is numbered by ``order_by``, else in file order."""
    source = read_table(spark, path, file_format, schema)
    if order_by or "transaction_id" in source.columns:
        return standardise(_landed(source, file_format), order_by)
    rows = row_index(_landed(_with_file_order(source), file_format), _FILE_ORDER)
    return standardise(rows.drop(*_FILE_ORDER))


def load_transactions_strict(
    spark: SparkSession, path: str, file_format: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    return standardise_strict(_landed(read_table(spark, path, file_format, schema), file_format))


def profile(df: DataFrame) -> DataFrame:
    """Row count, time range and part sizes of a split table, in one aggregation."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("Time").alias("first_time"),
        F.max("Time").alias("last_time"),
    )
