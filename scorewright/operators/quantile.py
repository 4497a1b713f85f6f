"""Exact quantiles without gathering a column in one task.

Spark's ``percentile`` keeps every distinct value in one final buffer.  Here the
wanted rank is located by narrowing instead: each pass counts values in a fixed
number of equal-width slices and goes on inside the slice that holds the rank.
Only the slice counts reach the driver, and a value repeated billions of times
is one narrow slice like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 4096
GATHER_LIMIT = 200_000


def _value_at(values: DataFrame, rank: int, gather_limit: int, stats: tuple) -> float:
    """The value at a 0-based rank."""
    count, low, high = stats
    while low < high and count > gather_limit:
        # Halves, so that the width of a very wide range stays finite.
        width = (high / 2 - low / 2) / SLICES
        if width == 0:
            break
        offset = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(width)
        slice_of = F.least(F.floor(offset), F.lit(SLICES - 1))
        slices = (
            values.groupBy(slice_of.alias("slice"))
            .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("slice")
            .collect()
        )
        for part in slices:
            if rank < part["n"]:
                break
            rank -= part["n"]
        count, low, high = part["n"], part["low"], part["high"]
        values = values.filter(F.col("v").between(low, high))
    if low == high:
        return low
    # At most ``gather_limit`` values are left.
    for row in values.groupBy("v").count().orderBy("v").collect():
        if rank < row["count"]:
            return row["v"]
        rank -= row["count"]
    raise AssertionError("rank beyond the last value")


def quantile_value(
    df: DataFrame, column: str, share: float, gather_limit: int = GATHER_LIMIT
) -> float | None:
    """Quantile with linear interpolation between neighbours; None without values.

    Nulls and NaN are left out; infinite values rank below and above all others.
    Runs one small aggregation, one per narrowing pass when more than
    ``gather_limit`` values remain, and one for the neighbour above.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    is_finite = F.abs("v") < math.inf
    row = values.agg(
        F.count("v").alias("all"),
        F.count_if(F.col("v") == -math.inf).alias("under"),
        F.count_if(is_finite).alias("n"),
        F.min(F.when(is_finite, F.col("v"))).alias("low"),
        F.max(F.when(is_finite, F.col("v"))).alias("high"),
    ).first()
    if row["all"] == 0:
        return None
    finite, beyond = values.filter(is_finite), row["under"] + row["n"]
    if row["n"] == row["all"] <= gather_limit:
        return values.agg(F.percentile("v", share).alias("q")).first()["q"]
    position = share * (row["all"] - 1)
    below, above = math.floor(position), math.ceil(position)
    if below < row["under"]:
        low = -math.inf
    elif below >= beyond:
        low = math.inf
    else:
        stats = (row["n"], row["low"], row["high"])
        low = _value_at(finite, below - row["under"], gather_limit, stats)
    if below == above or low == math.inf:
        return low
    if above < row["under"]:
        return low
    if above >= beyond:
        return math.inf
    up_to = F.count_if(F.col("v") <= low).alias("up_to")
    after = finite.agg(up_to, F.min(F.when(F.col("v") > low, F.col("v"))).alias("next")).first()
    high = low if above - row["under"] < after["up_to"] else after["next"]
    return (above - position) * low + (position - below) * high


def quantile(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the share and the exact quantile."""
    found = quantile_value(df, column, share)
    return df.sparkSession.createDataFrame([(share, found)], "share double, quantile double")


def approximate_quantile(df: DataFrame, column: str, share: float, accuracy: int) -> DataFrame:
    """One row in a single pass; the rank is off by at most ``n / accuracy``."""
    return df.agg(F.percentile_approx(column, share, accuracy).alias("quantile")).select(
        F.lit(share).alias("share"), "quantile"
    )
