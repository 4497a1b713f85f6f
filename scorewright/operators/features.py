"""The fixed feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import amounts
from scorewright.operators.quantile import quantile_value
from scorewright.schemas import FEATURE_COLUMNS, MODEL_INPUTS

HIGH_AMOUNT_SHARE = 0.95


def with_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", amounts.amount(df))


def high_amount_threshold(df: DataFrame, share: float = HIGH_AMOUNT_SHARE) -> float | None:
    """The exact amount quantile, as one number for the plan."""
    return quantile_value(df.select(amounts.amount(df).alias("amount")), "amount", share)


def features(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Seven fixed columns; a missing one is filled with 0.

    The high-amount threshold comes from the whole table unless one is given, for
    example from the training part only.
    """
    if threshold is None:
        threshold = high_amount_threshold(df)
    prepared = with_amount(df).withColumns(
        {
            "log_amount": amounts.log_amount(F.col("amount")),
            "hour": amounts.hour(df),
            "is_high_amount": amounts.high_amount(F.col("amount"), threshold),
        }
    )
    return prepared.select(
        [F.col(c) if c in prepared.columns else F.lit(0).alias(c) for c in FEATURE_COLUMNS]
    )


def model_inputs(df: DataFrame) -> DataFrame:
    """The columns a classifier sees, with the key."""
    return df.select("transaction_id", *MODEL_INPUTS)


def scaler_stats(df: DataFrame) -> DataFrame:
    """Mean and population deviation of each input, one row per input."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in MODEL_INPUTS],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in MODEL_INPUTS],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}_mean").alias("mean"),
            F.col(f"{c}_std").alias("std"),
        )
        for c in MODEL_INPUTS
    ]
    return stats.select(F.inline(F.array(*rows)))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight per class: n / (classes * class size)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # One row per class: the window has a handful of rows.
    over_classes = Window.partitionBy()
    total = F.sum("n").over(over_classes)
    classes = F.count(F.lit(1)).over(over_classes)
    return counts.select("label", "n", (total / (classes * F.col("n"))).alias("weight"))
