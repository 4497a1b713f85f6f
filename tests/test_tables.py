"""Loading, features, numbering, quantiles and splits on small frames."""

import math
import random

import pytest
from conftest import SMALL, plan_of, values
from pyspark.sql import functions as F

from scorewright.operators import features, quantile, ranking, split
from scorewright.sources import transactions


def amounts_frame(spark, numbers):
    return spark.createDataFrame([(float(n),) for n in numbers], "x double")


def linear_quantile(numbers, share):
    ordered = sorted(numbers)
    position = share * (len(ordered) - 1)
    low, high = math.floor(position), math.ceil(position)
    return ordered[low] + (ordered[high] - ordered[low]) * (position - low)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 0.999, 1.0])
def test_quantile_by_narrowing(spark, share):
    rng = random.Random(7)
    numbers = [rng.expovariate(0.02) for _ in range(3000)]
    numbers += [50.0] * 2000 + [-3.5] * 10 + [1e9]
    df = amounts_frame(spark, numbers)
    exact = linear_quantile(numbers, share)
    assert quantile.quantile_value(df, "x", share) == pytest.approx(exact, abs=1e-9)
    narrowed = quantile.quantile_value(df, "x", share, gather_limit=20)
    assert narrowed == pytest.approx(exact, abs=1e-9)


def test_quantile_between_heavy_values(spark):
    df = amounts_frame(spark, [1.0] * 500 + [2.0] * 500)
    assert quantile.quantile_value(df, "x", 0.5, gather_limit=10) == pytest.approx(1.5)


def test_quantile_of_a_wide_range(spark):
    df = amounts_frame(spark, [-1.7e308, 1.7e308] + [float(i) for i in range(200)])
    assert quantile.quantile_value(df, "x", 0.5, gather_limit=5) == pytest.approx(99.5)
    beyond = amounts_frame(spark, [1.0, 2.0, float("inf")])
    assert quantile.quantile_value(beyond, "x", 0.5) == 2.0
    assert quantile.quantile_value(beyond, "x", 1.0) == float("inf")


def test_quantile_leaves_out_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (3.0,)], "x double")
    assert quantile.quantile_value(df, "x", 0.5) == 2.0
    assert quantile.quantile_value(df.filter("x > 9"), "x", 0.5) is None


def test_approximate_quantile(spark):
    df = amounts_frame(spark, range(1000))
    got = quantile.approximate_quantile(df, "x", 0.95, 10_000).first()["quantile"]
    assert abs(got - 949) <= 1


def test_row_index(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b"])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, g string")
    got = values(ranking.row_index(df, ["g", "k"]).orderBy("transaction_id"), "transaction_id", "g", "k")
    expected = sorted((g, k) for k, g in rows)
    assert got == [(i, g, k) for i, (g, k) in enumerate(expected)]


def test_file_row_index(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(7).write.parquet(path)
    got = ranking.file_row_index(spark, path)
    assert sorted(r["transaction_id"] for r in got.collect()) == list(range(1000))
    assert "Exchange rangepartitioning" not in plan_of(got)


def test_load_from_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as out:
        out.write("Time,V1,Amount,Class\n0.0,1.5,149.62,0\n1.0,,2.69,1\n")
    loaded = transactions.load_transactions(spark, path, order_by=["Time"]).orderBy("transaction_id")
    assert values(loaded, "transaction_id", "label", "txn_text") == [
        (0, 0, "Transaction TID: 0 — Time: 0.0 — Amount: $149.62"),
        (1, 1, "Transaction TID: 1 — Time: 1.0 — Amount: $2.69"),
    ]
    assert "V1" in loaded.columns
    strict = transactions.load_transactions_strict(spark, path)
    assert values(strict, "label", "txn_text") == [(0, "Time: 0.0 — Amount: $149.62")]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_load_without_ids_numbers_rows_in_file_order(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    rows = spark.range(500, numPartitions=5).select(
        F.col("id").alias("at"), F.lit(1.5).alias("Amount"), (F.col("id") % 2).alias("Class")
    )
    rows.write.format(kind).option("header", True).save(path)
    loaded = transactions.load_transactions(spark, path, kind).orderBy("at")
    assert values(loaded, "transaction_id", "at") == [(i, i) for i in range(500)]


def test_load_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        transactions.load_transactions(spark, "  ")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        transactions.load_transactions(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="label"):
        transactions.standardise(spark.range(1))
    with pytest.raises(ValueError, match="order_by"):
        transactions.standardise(spark.range(1).withColumn("Class", F.lit(1)))


def test_features_fill_missing_columns(spark):
    df = spark.createDataFrame([(3.0,), (1.0,)], "TransactionAmt double")
    got = features.features(df)
    assert got.columns == [
        "transaction_id", "amount", "log_amount", "hour", "is_high_amount", "label", "txn_text"
    ]
    assert values(got.orderBy("amount"), "transaction_id", "amount", "hour", "is_high_amount", "label") == [
        (0, 1.0, 0.0, 0, 0), (0, 3.0, 0.0, 1, 0)
    ]


def test_threshold_is_strict_and_can_be_given(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "transaction_id long, Amount double")
    got = features.features(df, threshold=3.0).orderBy("transaction_id")
    assert [v for (v,) in values(got, "is_high_amount")] == [0, 0, 0, 0, 1]


def split_frame(spark, n):
    return spark.range(n).select(
        F.col("id").alias("transaction_id"),
        F.when(F.col("id") < n // 3, 1).when(F.col("id") == n - 1, 2).otherwise(0).alias("label"),
    )


def by_hash(rows, quotas, salt):
    """Reference ranking in plain Python."""
    import hashlib

    kept = set()
    for label, quota in quotas.items():
        own = sorted((hashlib.md5(f"{salt}:{k}".encode()).hexdigest(), k) for k, c in rows if c == label)
        kept |= {k for _, k in own[:quota]}
    return kept


@pytest.mark.parametrize("gather_limit", [3, 100_000])
def test_split_sizes_and_members(spark, gather_limit):
    n = 2000
    df = split_frame(spark, n)
    got = split.stratified_split(df, gather_limit=gather_limit).collect()
    parts = {p: {r["transaction_id"] for r in got if r["split"] == p} for p in ("train", "val", "test")}
    assert [len(parts[p]) for p in ("test", "val", "train")] == [300, 300, 1400]
    assert sum(map(len, parts.values())) == len(set().union(*parts.values())) == n
    rows = [(r["transaction_id"], r["label"]) for r in got]
    sizes = split.class_sizes(df, "label")
    quotas = split.class_quotas(sizes, 300)
    rest = by_hash(rows, quotas, 42)
    train = by_hash([r for r in rows if r[0] in rest], split.class_quotas(quotas, 300), 43)
    assert parts["test"] == {k for k, _ in rows} - rest
    assert parts["train"] == train


def test_split_keeps_copies_together(spark):
    df = split_frame(spark, 300)
    copies = F.explode(F.sequence(F.lit(1), F.lit(400))).alias("copy")
    hot = df.filter("transaction_id = 7").select("*", copies).drop("copy")
    got = split.stratified_split(df.union(hot), gather_limit=5)
    assert got.filter("transaction_id = 7").select("split").distinct().count() == 1
    assert got.count() == 700


def test_split_needs_classes(spark):
    df = spark.createDataFrame([(1, None)], "transaction_id long, label int")
    with pytest.raises(ValueError):
        split.stratified_split(df)


def test_split_does_not_move_rows(spark):
    table = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr(
        "event_id as transaction_id", "user_id % 2 as label", "value"
    )
    plan = plan_of(split.stratified_split(table))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_hash_split_shares(spark):
    got = split.hash_split(split_frame(spark, 4000)).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    assert abs(sizes["test"] - 600) < 100 and abs(sizes["val"] - 600) < 100


def test_class_weights(spark):
    got = {r["label"]: r["weight"] for r in features.class_weights(split_frame(spark, 9)).collect()}
    assert got == {0: pytest.approx(9 / 15), 1: pytest.approx(1.0), 2: pytest.approx(3.0)}
