"""Rows with missing, infinite or odd values go through every step."""

import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions.amounts import hour
from scorewright.functions.text import float_text
from scorewright.operators import compare
from scorewright.operators.features import features
from scorewright.operators.quantile import quantile_value
from scorewright.operators.split import stratified_split
from scorewright.plans import training
from scorewright.sources.transactions import standardise


def test_training_and_scoring_keep_every_row(spark):
    odd = [(-5.0, 10.0), (1.0, None), (2.0, math.nan), (math.inf, 5.0)]
    rows = [(i, *odd[i % 4], i % 2) if i < 8 else (i, float(i), 60.0 * i, i % 2) for i in range(60)]
    raw = spark.createDataFrame(rows, "transaction_id long, Amount double, Time double, Class int")
    table = features(standardise(raw))
    for kind in (training.LOGISTIC, training.FOREST):
        scored = training.score(training.train_model(table, kind), table)
        assert scored.count() == 60
        assert scored.columns == [*table.columns, "predicted_prob", "predicted_label"]
        assert scored.filter("predicted_prob between 0 and 1").count() == 60


def test_hour_of_nan_is_null(spark):
    times = spark.createDataFrame([(math.nan,), (3600.0,)], "Time double")
    assert [r[0] for r in times.select(hour(times)).collect()] == [None, 1.0]


def test_numbers_print_like_python(spark):
    given = [1e-5, 2.5e-7, 1e16, 1.5e22, 1e100, 12.5, 1e7, 0.001]
    shown = spark.createDataFrame([(x,) for x in given], "x double").select(float_text(F.col("x")))
    assert [r[0] for r in shown.collect()] == [repr(x) for x in given]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.77, 0.95, 1.0])
@pytest.mark.parametrize("limit", [3, 1000])
def test_quantile_ranks_infinities(spark, share, limit):
    given = [-math.inf, -math.inf, *map(float, range(20)), 7.0, 7.0, math.inf]
    frame = spark.createDataFrame([(x,) for x in given], "v double").repartition(3)
    ranked, at = sorted(given), share * (len(given) - 1)
    low, high = ranked[math.floor(at)], ranked[math.ceil(at)]
    want = low if low == high else low + (at - math.floor(at)) * (high - low)
    assert quantile_value(frame, "v", share, limit) == pytest.approx(want)


def test_split_needs_ids(spark):
    rows = spark.createDataFrame([(None, 1), (2, 0)], "transaction_id long, label int")
    with pytest.raises(ValueError, match="id"):
        stratified_split(rows)


def test_many_models(spark):
    log = spark.range(3000).select(
        F.pmod("id", F.lit(2)).alias("transaction_id"),
        F.concat(F.lit("m"), F.floor(F.col("id") / 2)).alias("model_name"),
        F.when(F.col("id") % 3 == 0, "1").otherwise("0").alias("predicted_label"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )
    counts = compare.disagreement_count(log)
    assert counts.count() == 1500 * 1499 // 2
    a, b = "m0", "m1"
    classes = {(r[0], r[1]): r[2] for r in log.collect()}
    differ = sum(classes[i, a] != classes[i, b] for i in (0, 1))
    assert counts.filter(f"model_a = '{a}' and model_b = '{b}'").first()["n"] == differ
