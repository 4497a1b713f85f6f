"""Contiguous row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.session import materialise

# monotonically_increasing_id keeps the partition above bit 33 and the position below.
POSITION_BITS = 33
_PART = "_part"
_POSITION = "_position"


def _with_offsets(placed: DataFrame, id_col: str) -> DataFrame:
    """Row number = rows in earlier parts + position inside the part.

    ``placed`` has one part number per written partition, so the offset table has
    as many rows as there are shuffle partitions and is safe to broadcast.
    """
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_PART)
        .count()
        .select(_PART, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = placed.join(F.broadcast(offsets), _PART)
    row_id = (F.col("_offset") + F.col(_POSITION)).cast("long").alias(id_col)
    return numbered.select(row_id, *[c for c in placed.columns if c not in (_PART, _POSITION)])


def row_index(df: DataFrame, order_by: list[str], id_col: str = "transaction_id") -> DataFrame:
    """Add a 0-based contiguous id in the order of ``order_by``.

    The order columns together must identify a row.  Rows are range-partitioned
    and sorted once, then written, so counting and numbering see the same layout
    even when tasks are rerun.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.monotonically_increasing_id()
    ordered = (
        df.repartitionByRange(parts, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_slot", slot)
    )
    stored = materialise(ordered, "row-index")
    placed = stored.select(
        F.shiftright("_slot", POSITION_BITS).alias(_PART),
        F.col("_slot").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias(_POSITION),
        *df.columns,
    )
    return _with_offsets(placed, id_col)


def file_row_index(
    spark: SparkSession, path: str, id_col: str = "transaction_id"
) -> DataFrame:
    """Number the rows of a Parquet source in file order, with no shuffle of the rows.

    Parquet scans give each row its position in its file, so only one count per
    file has to be summed up.
    """
    source = spark.read.parquet(path)
    columns = source.columns
    placed = source.select(
        F.col("_metadata.file_path").alias(_PART),
        F.col("_metadata.row_index").alias(_POSITION),
        *columns,
    )
    counts = placed.groupBy(_PART).count()
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PART, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset")
    )
    # The per-file table grows with the number of files: Spark picks the join by size.
    numbered = placed.join(offsets, _PART)
    row_id = (F.col("_offset") + F.col(_POSITION)).cast("long").alias(id_col)
    return numbered.select(row_id, *columns)
