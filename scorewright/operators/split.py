"""Stratified train / validation / test split.

Exact form: per-class quotas by largest remainder, and inside a class the rows
with the smallest salted hash are kept.  A full ranking is not needed for that,
only the hash at which each class is cut, so the cut is found by counting hash
prefixes.  The split itself is then a comparison per row: no shuffle of the
rows, whatever the class sizes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_STEP = 3
HASH_DIGITS = 32
GATHER_LIMIT = 100_000
MAX_CLASSES = 1_000

TRAIN, VALIDATION, TEST = "train", "val", "test"


def order_hash(key: Column, salt: int) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))


def class_quotas(sizes: Mapping[int, int], taken: int) -> dict[int, int]:
    """Rows each class keeps when ``taken`` of all rows leave, proportionally.

    Whole-number arithmetic: the classes with the largest remainder get one more
    until the total fits; ties go to the smaller label.
    """
    total = sum(sizes.values())
    kept = total - taken
    quotas = {c: n * kept // total for c, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(sizes[c] * kept % total), c))
    for c in by_remainder[: kept - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def _by_class(label: Column, values: Mapping[int, Column]) -> Column:
    """A constant per class; ``class_sizes`` bounds their number."""
    entries = [part for c, v in sorted(values.items()) for part in (F.lit(c), v)]
    return F.try_element_at(F.create_map(*entries), label)


def _reaching(counts: DataFrame, wanted: Mapping[int, int], order: list[str]) -> list[Row]:
    """Per class, the group in which the running count reaches the wanted one."""
    up_to = (
        Window.partitionBy("label")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    goal = _by_class(F.col("label"), {c: F.lit(w).cast("long") for c, w in wanted.items()})
    running = counts.withColumns({"total": F.sum("n").over(up_to), "wanted": goal})
    return running.filter("total >= wanted and total - n < wanted").collect()


def _cuts(
    rows: DataFrame, sizes: Mapping[int, int], quotas: Mapping[int, int], gather_limit: int
) -> dict[int, tuple]:
    """Per class, the (hash, key) of the last row kept.

    ``rows`` has ``label``, ``hash`` and ``key``.  Each pass extends the known hash
    prefix of every class by three digits, until what shares a prefix is small.
    """
    wanted = {c: q for c, q in quotas.items() if q > 0}
    if not wanted:
        return {}
    inside, largest, digits = rows, max(sizes.values()), 0
    while largest > gather_limit and digits + PREFIX_STEP < HASH_DIGITS:
        digits += PREFIX_STEP
        prefix = F.substring("hash", 1, digits)
        counts = inside.groupBy("label", prefix.alias("prefix")).agg(F.count("hash").alias("n"))
        found = _reaching(counts, wanted, ["prefix"])
        wanted = {r["label"]: r["wanted"] - (r["total"] - r["n"]) for r in found}
        known = _by_class(F.col("label"), {r["label"]: F.lit(r["prefix"]) for r in found})
        inside, largest = rows.filter(prefix == known), max(r["n"] for r in found)
    # Copies of a key are one counted group here.
    counts = inside.groupBy("label", "hash", "key").agg(F.count(F.lit(1)).alias("n"))
    found = _reaching(counts, wanted, ["hash", "key"])
    return {r["label"]: (r["hash"], r["key"]) for r in found}


def class_sizes(
    df: DataFrame, label: str, key: str | None = None, most_classes: int = MAX_CLASSES
) -> dict[int, int]:
    lost = F.count_if(F.col(key).isNull()) if key else F.lit(0)
    counts = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), lost.alias("lost")
    )
    rows = counts.limit(most_classes + 1).collect()
    if len(rows) > most_classes:
        raise ValueError(f"more than {most_classes} classes in {label}; raise most_classes if it is a label")
    if any(r["label"] is None for r in rows):
        raise ValueError(f"{label} has missing values; every row needs a class")
    if any(r["lost"] for r in rows):
        raise ValueError(f"{key} has missing values; every row needs an id")
    return {r["label"]: r["count"] for r in rows}


def stratified_split(
    df: DataFrame,
    key: str = "transaction_id",
    label: str = "label",
    test_percent: int = 15,
    val_percent: int = 15,
    seed: int = 42,
    gather_limit: int = GATHER_LIMIT,
    most_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Add ``split``: exact part sizes, every class in proportion.

    The counts run at once; the returned frame is lazy and keeps the partitioning
    of ``df``.  Rows with equal keys always land in the same part.  Class sizes and cuts
    are constants of the plan; a label of more than ``most_classes`` values raises.
    """
    sizes = class_sizes(df, label, key, most_classes)
    total = sum(sizes.values())
    n_test = math.ceil(total * test_percent / 100)
    n_val = math.ceil((total - n_test) * val_percent / (100 - test_percent))
    quotas = class_quotas(sizes, n_test)
    quotas_train = class_quotas(quotas, n_val)

    key_type = df.schema[key].dataType
    key_col, label_col = F.col(key), F.col(label).cast("int")

    def rows(source: DataFrame, salt: int) -> DataFrame:
        return source.select(
            label_col.alias("label"),
            order_hash(key_col, salt).alias("hash"),
            key_col.alias("key"),
        )

    def kept(salt: int, cuts: dict[int, tuple]) -> Column:
        return _kept(label_col, order_hash(key_col, salt), key_col, key_type, cuts)

    in_rest = kept(seed, _cuts(rows(df, seed), sizes, quotas, gather_limit))
    rest = rows(df.filter(in_rest), seed + 1)
    in_train = kept(seed + 1, _cuts(rest, quotas, quotas_train, gather_limit))
    part = F.when(~in_rest, TEST).when(~in_train, VALIDATION).otherwise(TRAIN)
    return df.withColumn("split", part)


def _kept(
    label: Column, hashed: Column, key: Column, key_type: T.DataType, cuts: dict[int, tuple]
) -> Column:
    """Whether a row comes at or before the cut of its class (no cut: nothing kept)."""
    if not cuts:
        return F.lit(False)
    position = F.struct(hashed.alias("hash"), key.alias("key"))
    cut = _by_class(
        label,
        {
            c: F.struct(F.lit(h).alias("hash"), F.lit(k).cast(key_type).alias("key"))
            for c, (h, k) in cuts.items()
        },
    )
    return F.coalesce(position <= cut, F.lit(False))


def hash_split(
    df: DataFrame,
    key: str = "transaction_id",
    test_share: float = 0.15,
    val_share: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` by hash threshold: one pass, approximate sizes."""
    digits = F.substring(order_hash(F.col(key), seed), 1, 8)
    position = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))
    part = (
        F.when(position < test_share, TEST)
        .when(position < test_share + val_share, VALIDATION)
        .otherwise(TRAIN)
    )
    return df.withColumn("split", part)


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Labels beside their feature rows, by key."""
    return features.join(labels, key)


def class_balance(df: DataFrame) -> DataFrame:
    """Rows per part and class."""
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
