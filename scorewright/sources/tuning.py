"""Question and answer texts for tuning a text model elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.prompts import tuning_example
from scorewright.operators.split import TRAIN


def examples(split: DataFrame, parts: Sequence[str] = (TRAIN,)) -> DataFrame:
    """One text per row of the wanted parts; by default never the test rows."""
    text = tuning_example(F.col("txn_text"), F.col("label")).alias("text")
    return split.filter(F.col("split").isin(*parts)).select("transaction_id", "split", text)


def write_examples(split: DataFrame, path: str, parts: Sequence[str] = (TRAIN,)) -> None:
    """JSON lines, one folder per part."""
    examples(split, parts).write.mode("overwrite").partitionBy("split").json(path)
