"""Where two models disagree, transaction by transaction."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.labels import label_to_int
from scorewright.operators.skew import HOT_ROWS, hot_keys, placed, spread_join
from scorewright.session import materialise

# A logged time, the class and the spelling of a prediction share one whole number:
# 58 bits of microseconds (beyond the year 9999), one bit, four bits.
MAX_SPELLINGS = 16
# Transactions whose bitsets are multiplied at once.
BIT_ROWS = 8_192
_LATE = (1 << 58) - 1


def model_names(log: DataFrame) -> list[str]:
    """Sorted names of the models with a recorded prediction; they become columns."""
    given = log.filter("model_name is not null and predicted_label is not null")
    rows = given.select("model_name").distinct().collect()
    return sorted(r["model_name"] for r in rows)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _time(log: DataFrame) -> Column:
    """Log time in microseconds; a missing time comes last."""
    return F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(_LATE))


def _class_of(log: DataFrame) -> Column:
    return label_to_int(F.col("predicted_label"), log.schema["predicted_label"].dataType)


def _given(log: DataFrame) -> DataFrame:
    return log.filter("transaction_id is not null and predicted_label is not null")


def _first(name: str, packed: Column) -> Column:
    """The smallest packed number of one model.

    A plain minimum keeps the aggregation hash-based with fixed-size buffers.
    """
    given = (F.col("model_name") == name) & F.col("predicted_label").isNotNull()
    return F.min(F.when(given, packed))


def _first_classes(log: DataFrame, names: list[str]) -> list[Column]:
    """Per model, the first logged class, 0 or 1."""
    packed = _time(log) * 2 + (1 - _class_of(log))
    return [(1 - F.pmod(_first(n, packed), F.lit(2))).cast("int").alias(n) for n in names]


def _first_guesses(log: DataFrame, names: list[str]) -> list[Column]:
    """Per model, the first logged prediction as text."""
    guess, second = F.col("predicted_label"), 1 - _class_of(log)
    found = _given(log).select("predicted_label").distinct().limit(MAX_SPELLINGS + 1).collect()
    spellings = sorted(r["predicted_label"] for r in found)
    if not spellings or len(spellings) > MAX_SPELLINGS:
        order = F.when(guess.isNotNull(), F.struct(_time(log), second, guess))
        return [F.min_by(guess, F.when(F.col("model_name") == n, order)).alias(n) for n in names]
    spelling = F.lit(0)
    for place, text in enumerate(spellings):
        spelling = F.when(guess == text, place).otherwise(spelling)
    packed = (_time(log) * 2 + second) * MAX_SPELLINGS + spelling
    texts = F.array(*[F.lit(t) for t in spellings])
    return [
        F.get(texts, F.pmod(_first(n, packed), F.lit(MAX_SPELLINGS)).cast("int")).alias(n)
        for n in names
    ]


def prediction_pivot(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per transaction, one column per model: the first logged prediction.

    "First" is by log time; at equal times the positive class, then the smaller
    text comes first.  Missing predictions never count, and a transaction with
    none at all has no row.  All models share one exchange on the transaction.
    The spellings in the log are looked up first: with few of them, as usual, the
    texts stay out of the aggregation.
    """
    names = model_names(log) if names is None else names
    return _given(log).groupBy("transaction_id").agg(*_first_guesses(log, names))


def class_pivot(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The pivot with 0/1 classes."""
    names = model_names(log) if names is None else names
    return _given(log).groupBy("transaction_id").agg(*_first_classes(log, names))


def _differ(a: Column, b: Column) -> Column:
    """A missing prediction differs from everything, another missing one included."""
    return F.coalesce(a != b, F.lit(True))


def _checked(log: DataFrame, names: list[str] | None, *wanted: str) -> list[str]:
    names = model_names(log) if names is None else names
    for name in wanted:
        if name not in names:
            raise ValueError(f"{name} has no recorded predictions")
    return names


def disagreements(
    log: DataFrame, model_a: str, model_b: str, raw: bool = False, names: list[str] | None = None
) -> DataFrame:
    """Transactions on which two models differ, with the predictions of every model.

    Predictions compare as 0/1 classes, because some models log numbers and others
    words; ``raw`` compares and shows them as logged.
    """
    names = _checked(log, names, model_a, model_b)
    wide = prediction_pivot(log, names) if raw else class_pivot(log, names)
    return wide.filter(_differ(F.col(_quoted(model_a)), F.col(_quoted(model_b))))


def disagreements_top(
    log: DataFrame, model_a: str, model_b: str, rows: int = 20, raw: bool = False
) -> DataFrame:
    """The first disagreements in id order."""
    return disagreements(log, model_a, model_b, raw).orderBy("transaction_id").limit(rows)


def _details(log: DataFrame, model: str, with_truth: bool) -> DataFrame:
    truth = ["true_label"] if with_truth else []
    return log.filter(F.col("model_name") == model).select(
        "transaction_id",
        *truth,
        F.col("predicted_label").alias(f"pred_{model}"),
        F.col("predicted_prob").alias(f"prob_{model}"),
        F.col("reason").alias(f"reason_{model}"),
    )


def _left_join(rows: DataFrame, joined: DataFrame, has_details: str) -> DataFrame:
    """Rows with details as joined, and the rest around the join.

    Whether a row has details is known beforehand, which turns the left join into
    an inner one: that can broadcast the few rows of a report, or split a hot key.
    """
    alone = rows.filter(~F.col(has_details))
    return joined.unionByName(alone, allowMissingColumns=True).drop(has_details)


def disagreement_details(
    log: DataFrame,
    model_a: str,
    model_b: str,
    rows: int | None = None,
    raw: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Disagreements with what each model logged; repeated runs give repeated rows.

    All of them, or those of the first ``rows`` transactions.  Each run of one model
    stands next to each run of the other, so runs multiply; ``runlog.latest_only``
    beforehand leaves one of each.
    """
    names = _checked(log, None, model_a, model_b)
    firsts = _first_guesses(log, names) if raw else _first_classes(log, names)
    logged = [
        F.bool_or(F.col("model_name") == model).alias(flag)
        for model, flag in ((model_a, "_in_a"), (model_b, "_in_b"))
    ]
    # Rows without a prediction count as details, though not in the pivot.
    keyed = log.filter(F.col("transaction_id").isNotNull())
    wide = keyed.groupBy("transaction_id").agg(*firsts, *logged)
    given = F.coalesce(*[F.col(_quoted(n)) for n in names]).isNotNull()
    differing = wide.filter(given & _differ(F.col(_quoted(model_a)), F.col(_quoted(model_b))))
    details_a, details_b = _details(log, model_a, True), _details(log, model_b, False)
    if rows is not None:
        # At most ``rows`` transactions: both runs are filtered where they lie.
        top = differing.orderBy("transaction_id").limit(rows)
        in_a = details_a.join(F.broadcast(top.filter("_in_a")), "transaction_id")
        with_a = _left_join(top, in_a, "_in_a")
        wanted = F.broadcast(top.select("transaction_id"))
        near_b = details_b.join(wanted, "transaction_id", "left_semi")
        in_b = with_a.filter("_in_b").join(near_b, "transaction_id")
        return _left_join(with_a, in_b, "_in_b")
    hot = hot_keys(log, "transaction_id", hot_rows)
    in_a = spread_join(placed(details_a), differing.filter("_in_a"), "transaction_id", hot)
    with_a = _left_join(differing, in_a, "_in_a")
    in_b = spread_join(with_a.filter("_in_b"), details_b, "transaction_id", hot)
    return _left_join(with_a, in_b, "_in_b").drop("_spot")


def _products(models: int):
    """For each model the transactions on which each later one has its class; and all (-1)."""

    def run(batches):
        equal, total = np.zeros((models, models), dtype=np.int64), 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            total += int(n.sum())
            words = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
            bits = np.stack(words, axis=1).astype("<i8").view(np.uint8)
            for low in range(0, len(batch), BIT_ROWS):
                some = slice(low, low + BIT_ROWS)
                held = np.unpackbits(bits[some], axis=1, count=2 * models, bitorder="little")
                for side in (0, 1):
                    one = held[:, side::2].astype(np.float64)
                    # Whole numbers, exact below 2^53.
                    equal += ((one * n[some, None]).T @ one).astype(np.int64)
        rows = [[total], *(equal[a, a + 1 :] for a in range(models))]
        yield pa.RecordBatch.from_pydict(
            {"a": np.arange(-1, models, dtype=np.int32), "equal": pa.array(rows, pa.list_(pa.int64()))}
        )

    return run


def disagreement_count(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Disagreeing transactions for every pair of models.

    Two models disagree wherever their classes are not the same, so the transactions
    on which they agree are counted and taken from all.  A transaction is two bitsets of
    models, one for each class; equal ones are counted first.  Each task multiplies its
    bitsets to one matrix of pairs, and the matrices are added: no pair is a row before
    the result, and the plan does not grow with the models.
    """
    names = sorted(set(model_names(log) if names is None else names))
    spark = log.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "model_a string, model_b string, n long")
    packed = _time(log) * 2 + (1 - _class_of(log))
    firsts = _given(log).groupBy("transaction_id", "model_name").agg(F.min(packed).alias("p"))
    # From literals: rows from the driver's Python would need a worker to be started.
    numbers = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(n) for n in names])).alias("_model", "model_name")
    )
    value = F.col("_model") * 2 + (1 - F.pmod("p", F.lit(2))).cast("int")
    firsts = firsts.join(F.broadcast(numbers), "model_name", "left").withColumn("_v", value)
    bit = F.expr("shiftleft(1L, _v % 64)")
    # A transaction without any of the models counts too: all pairs differ on it.
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("_v") / 64) == k, bit)), F.lit(0).cast("long")).alias(f"_{k}")
        for k in range(-(-2 * len(names) // 64))
    ]
    sets = firsts.groupBy("transaction_id").agg(*words).drop("transaction_id")
    sets = sets.groupBy(*sets.columns).agg(F.count(F.lit(1)).alias("n"))
    parts = sets.mapInArrow(_products(len(names)), "a int, equal array<long>")
    # One array for each task and model: a task adds up those of its models.
    added = F.reduce(
        F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))),
        F.get("rows", F.lit(0)),
        lambda one, other: F.zip_with(one, other, lambda x, y: x + y),
    )
    sums = parts.groupBy("a").agg(F.collect_list("equal").alias("rows")).select("a", added.alias("equal"))
    sums = materialise(sums, "agreements")
    total = sums.filter("a = -1").first()
    if total is None:
        pairs = [(*pair, 0) for pair in combinations(names, 2)]
        return spark.createDataFrame(pairs, "model_a string, model_b string, n long")
    pairs = sums.filter("a >= 0").select("a", F.posexplode("equal").alias("after", "same"))
    name = F.array(*[F.lit(n) for n in names])
    return pairs.select(
        F.get(name, "a").alias("model_a"),
        F.get(name, F.col("a") + F.col("after") + 1).alias("model_b"),
        (F.lit(total["equal"][0]) - F.col("same")).alias("n"),
    )
