"""Helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.session import materialise, spread

# Fixed value: what separates words, as a set of a regular expression.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

RANK_CELLS = 4096
# Bits of one piece of a bitmap, as Spark's bitmap functions have it; bits for each key, and
# most pieces (16 MB).
PIECE = 32_768
BITS_A_KEY = 32
MOST_PIECES = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def even(df: DataFrame) -> DataFrame:
    """A scan over all cores; see ``session.spread``."""
    return spread(df)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def held_out(key: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the key as text leaves this remainder; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def gapless(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``rank``, 0, 1, 2, ... inside each value of ``group``, in a hashed order.

    ``df`` must be a written table, as it is read twice.  Rows of a group are dealt
    to 4,096 cells by the hash of ``order``; counted cells give each one its first
    rank, and only the rows of a cell are sorted together.  The counts are 4,096
    rows for each group at most, so callers pass a column with few values.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(RANK_CELLS)).cast("int")
    rows = df.withColumn("_cell", cell)
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_0"))
    inside = Window.partitionBy(group, "_cell").orderBy(F.xxhash64(*order), *order)
    ranked = rows.withColumn("_at", F.row_number().over(inside))
    joined = ranked.join(F.broadcast(first), [group, "_cell"])
    return joined.withColumn("rank", F.col("_0") + F.col("_at") - 1).drop("_0", "_at", "_cell")


def maybe_among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``_maybe``: false for rows whose columns named as in ``keys`` are not among these.

    A bitmap of hashed keys goes to the rows, so that a join after this need not move
    the others.  Up to four million keys it is true for one in thirty of the others;
    the bitmap is 16 MB at most, so with many more keys it is true for more of them.
    Types that differ hash apart: then all rows may be among the keys.
    """
    names = keys.columns
    if any(df.schema[n].dataType != keys.schema[n].dataType for n in names):
        return df.withColumn("_maybe", F.lit(True))
    pieces = min(MOST_PIECES, -(-keys.count() * BITS_A_KEY // PIECE) or 1)
    # The bitmap functions count from 1.
    bit = (F.pmod(F.xxhash64(*names), F.lit(pieces * PIECE)) + 1).alias("_bit")
    bits = keys.select(bit).groupBy(F.bitmap_bucket_number("_bit").alias("_piece"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    rows = df.select("*", bit).withColumns(
        {"_piece": F.bitmap_bucket_number("_bit"), "_at": F.bitmap_bit_position("_bit").cast("int")}
    )
    byte = "cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int)"
    is_set = F.expr(f"coalesce(shiftright({byte}, _at % 8) & 1, 0) = 1")
    found = rows.join(F.broadcast(bits), "_piece", "left").withColumn("_maybe", is_set)
    return found.select(*df.columns, "_maybe")


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a later filter on these columns does not reach below this point.

    A filter that moves down takes the expressions of its columns along.  Where those
    look things up in an array, they would then build that array for each element.
    """
    row = F.inline(F.array(F.struct(*columns)))
    return df.select(*[c for c in df.columns if c not in columns], row)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the folder all executors share; later steps do not go back beyond it."""
    return materialise(df, name)


def worker_value(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python process.

    Functions travel to the executors by value and are new in each task there, so what
    should outlive a task hangs on the process itself.
    """
    holder = "_values_of_this_process"
    values = sys.modules.setdefault(holder, ModuleType(holder)).__dict__
    if name not in values:
        values[name] = make()
    return values[name]
