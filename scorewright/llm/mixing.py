"""Mixing sources, languages and topics to target weights."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import even, written

TOPICS = 8
KEEP_SHARE = 0.5
ROUNDS = 30
CLOSE = 1e-4
# Exponent that turns token shares into targets: 1 keeps them, 0 makes them equal.
SOFTEN = 0.5
NONE = "(none)"
_TOPIC_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]{5,}")


def _topic_of(text: str | None) -> tuple[int, int]:
    """Number of words, and the topic: a hash of the commonest word of five bytes or more."""
    if not text:
        return 0, 0
    raw = text.encode("utf-8", "surrogatepass").lower()
    found = Counter(_TOPIC_WORD.findall(raw))
    if not found:
        return len(raw.split()), 0
    most = max(found.values())
    word = min(w for w, n in found.items() if n == most)
    return len(raw.split()), sum((i + 1) * b for i, b in enumerate(word)) % TOPICS


def with_topics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, the words of the text, and ``topic``.

    The topic stands in for a classifier's: texts that share their commonest longer
    word (ties: the smaller) share it.  A text without one has topic 0.
    """
    schema = T.StructType(
        [f for f in df.schema if f.name not in ("n_tokens", "topic")]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.IntegerType())]
    )

    def add(batches):
        for batch in batches:
            both = [_topic_of(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(f.name) for f in schema.fields[:-2]]
            columns += [pa.array([b[0] for b in both], pa.int64())]
            columns += [pa.array([b[1] for b in both], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return even(df).mapInArrow(add, schema)


def softened(cells: DataFrame, dim: str, power: float = SOFTEN) -> DataFrame:
    """Target shares of one dimension: its token shares to a power, scaled to sum 1."""
    mass = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), power).alias("m"))
    whole = mass.agg(F.sum("m").alias("all"))
    total = (whole.first() or {"all": None})["all"] or 1.0
    return mass.select(dim, (F.col("m") / F.lit(float(total))).alias("target"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE
) -> DataFrame:
    """Iterative proportional fitting: add ``share`` to the cells.

    ``cells`` has one row for each combination of the dimensions, with ``tokens``.
    Each step scales the shares so that one dimension's sums meet its targets; the
    steps go round until no dimension is off by more than ``close``, or ``rounds``
    times.  A value without a target keeps its own share, scaled with the rest.
    Each round is written out, so a lost executor costs one round.
    """
    fitted = cells.withColumn("share", F.col("tokens").cast("double"))
    for _ in range(rounds):
        off = F.lit(0.0)
        for dim, target in targets.items():
            sums = fitted.groupBy(dim).agg(F.sum("share").alias("_sum"))
            scale = sums.join(target, dim, "left").select(
                dim,
                F.coalesce(F.col("target") / F.col("_sum"), F.lit(1.0)).alias("_scale"),
            )
            fitted = fitted.join(scale, dim).withColumn("share", F.col("share") * F.col("_scale"))
            # A step's scale says how far the sums were off before it.
            fitted = fitted.withColumnRenamed("_scale", f"_scale_{dim}")
            off = F.greatest(off, F.max(F.abs(F.col(f"_scale_{dim}") - 1)))
        fitted = written(fitted, "raking")
        worst = fitted.agg(off.alias("off")).first()["off"]
        fitted = fitted.select(*cells.columns, "share")
        if worst is None or worst < close:
            break
    return fitted


def _uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that only depends on key and seed."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(
    df: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    key: str = "doc_id",
    keep_share: float = KEEP_SHARE,
    seed: int = 7,
) -> DataFrame:
    """Each row with topic, n_tokens, probability, weight and sampled.

    Tokens are raked to the targets of source, lang and topic (columns: the
    dimension as text, and target; without any, softened token shares).  A cell's
    rows are sampled with probability ``keep_share`` times its raked share over its
    token share, 1 at most; ``weight`` is what is above 1, so that the expected
    weighted tokens meet the targets in any case.  Sampling hashes the key.

    Null source or lang is a value of its own.  Rows without tokens say nothing of
    the mix and are sampled at ``keep_share``.  The hot cell is one row of the table
    of cells; that table is joined back by its cell.  Other columns stay.
    """
    taken = ["topic", "n_tokens", "probability", "weight", "sampled"]
    given = with_topics(df.drop(*taken))
    dims = {"source": "_source", "lang": "_lang", "topic": "_topic"}
    rows = given.withColumns(
        {inner: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d, inner in dims.items()}
    )
    return _sampled(rows, dims, targets, key, keep_share, seed)


def _sampled(rows, dims, targets, key, keep_share, seed) -> DataFrame:
    inner = list(dims.values())
    narrow = written(rows.select(*inner, "n_tokens", F.col(key).alias("_key")), "tokens")
    cells = written(
        narrow.filter("n_tokens > 0").groupBy(*inner).agg(F.sum("n_tokens").alias("tokens")),
        "cells",
    )
    if targets is None:
        goal = {i: softened(cells, i) for i in inner}
    else:
        goal = {dims[d]: t.withColumnRenamed(d, dims[d]) for d, t in targets.items()}
    fitted = rake(cells, goal)
    total = fitted.agg(F.sum("tokens").alias("t"), F.sum("share").alias("s")).first()
    tokens, shares = float(total["t"] or 1), float(total["s"] or 1)
    ratio = (F.col("share") / shares) / (F.col("tokens") / tokens) * keep_share
    rates = fitted.select(*inner, ratio.alias("_rate"))
    joined = rows.join(rates, inner, "left").withColumn(
        "_rate", F.when(F.col("n_tokens") > 0, F.col("_rate")).otherwise(keep_share)
    )
    return joined.withColumns(
        {
            "probability": F.least(F.col("_rate"), F.lit(1.0)),
            "weight": F.greatest(F.col("_rate"), F.lit(1.0)),
        }
    ).withColumn("sampled", _uniform(F.col(key), seed) < F.col("probability")).drop(*inner, "_rate")
