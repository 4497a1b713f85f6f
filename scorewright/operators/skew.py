"""Joins on a key that one value may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MOST_HOT_KEYS = 100
SALTS = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """Values with at least ``hot_rows`` rows and a hundredth of all rows.

    One pass over one column with a sketch; at most a hundred values can qualify.
    The answer only steers how a join is spread, so it may be approximate.
    """
    row = df.agg(
        F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {MOST_HOT_KEYS})").alias("top")
    ).first()
    enough = max(hot_rows, row["n"] / MOST_HOT_KEYS)
    return [entry["item"] for entry in row["top"] or [] if entry["count"] >= enough]


def placed(scan: DataFrame) -> DataFrame:
    """Add ``_spot``, a part from 0 to 63, by the position of a row in its scan.

    Equal rows get different parts, which a hash of their columns would not give them.
    """
    at = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return scan.withColumn("_spot", at.cast("int"))


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join in which rows of hot keys on the ``many`` side go to several tasks.

    ``many`` has ``_spot``, see ``placed``; the ``few`` side is repeated for the hot
    keys only.
    """
    if not hot:
        return many.join(few, key)
    scattered = F.when(F.col(key).isin(hot), F.coalesce("_spot", F.lit(0))).otherwise(0)
    everywhere = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    repeated = few.withColumn(
        "_salt", F.explode(F.coalesce(everywhere, F.array(F.lit(0))))
    )
    return many.withColumn("_salt", scattered).join(repeated, [key, "_salt"]).drop("_salt")
