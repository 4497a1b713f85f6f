"""Numeric features and the text form of one transaction.

Every function looks at ``df.columns`` / ``df.schema`` only, so a missing or
oddly typed column is settled while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.text import float_text, to_number

AMOUNT_NAMES = ["Amount", "TransactionAmt"]
DASH = " — "


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def amount(df: DataFrame) -> Column:
    """The first known amount column as double; bad or missing values are 0."""
    name = next((n for n in AMOUNT_NAMES if n in df.columns), None)
    if name is None:
        return F.lit(0.0)
    if _is_number(df, name):
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
    else:
        value = to_number(F.col(name).cast("string"))
    return F.coalesce(value, F.lit(0.0))


def log_amount(value: Column) -> Column:
    """ln(1 + amount); null at or below -1, where no finite value exists."""
    return F.log1p(value)


def hour(df: DataFrame) -> Column:
    """Hour of day, 0 to 23, from seconds; 0 when there is no numeric time, null for NaN."""
    if "Time" not in df.columns or not _is_number(df, "Time"):
        return F.lit(0.0)
    given = F.col("Time").cast("double")
    seconds = F.when(~F.isnan(given), given)
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("double")


def high_amount(value: Column, threshold: float | None) -> Column:
    """1 when strictly above the threshold."""
    if threshold is None:
        return F.lit(0)
    return F.when(value > F.lit(threshold), 1).otherwise(0)


def _shown(df: DataFrame, name: str) -> Column:
    """A column as text, NA when the column or the value is missing."""
    if name not in df.columns:
        return F.lit("NA")
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        value = float_text(F.when(~F.isnan(value), value.cast("double")))
    return F.coalesce(value.cast("string"), F.lit("NA"))


def txn_text(df: DataFrame) -> Column:
    """``Transaction TID: 7 — Time: 12.5 — Amount: $3.2``"""
    return F.concat(
        F.lit("Transaction TID: "),
        _shown(df, "transaction_id"),
        F.lit(DASH),
        txn_text_short(df),
    )


def txn_text_short(df: DataFrame) -> Column:
    """The same without the id."""
    return F.concat(
        F.lit("Time: "),
        _shown(df, "Time"),
        F.lit(f"{DASH}Amount: $"),
        _shown(df, "Amount"),
    )
