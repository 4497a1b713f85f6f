"""Class labels: numbers or words to 0/1, and words from model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.text import strip

# The spellings of the positive class.
POSITIVE_WORDS = ["1", "true", "fraud", "fraudulent", "yes"]

POSITIVE = "FRAUD"
NEGATIVE = "NOT_FRAUD"


def word_to_int(label: Column) -> Column:
    """1 for a positive spelling, else 0; null counts as 0."""
    positive = F.lower(strip(label)).isin(POSITIVE_WORDS)
    return F.when(positive, 1).otherwise(0)


def label_to_int(label: Column, dtype: T.DataType) -> Column:
    """0/1 label of a column whose type is known.

    Numbers are cut to whole numbers (2.7 gives 2, NaN gives null); text goes by
    spelling, so the text ``2`` gives 0.
    """
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return label.try_cast("int")
    return word_to_int(label.cast("string"))


def answer_class(label: Column) -> Column:
    """FRAUD when the parsed label starts with that word, else NOT_FRAUD."""
    positive = F.lower(strip(label)).startswith(POSITIVE.lower())
    return F.when(positive, POSITIVE).otherwise(NEGATIVE)


def class_word(label: Column) -> Column:
    """0/1 to the word used in prompts and answers."""
    return F.when(label == 1, POSITIVE).otherwise(NEGATIVE)


def at_threshold(probability: Column, threshold: float = 0.5) -> Column:
    """Class 1 from the given probability on."""
    return F.when(probability >= threshold, 1).otherwise(0)
