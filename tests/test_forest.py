"""Trees to purity: exact cuts in a task, the same shape when Spark splits the top, odd tables."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewright.plans import forest, training
from scorewright.session import intermediates

INPUTS = ["a", "b"]
SCHEMA = "id long, a double, b double, label int, weight double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def chain(n):
    """Labels that alternate along one input: a pure tree has to cut between all of them."""
    return [(i, float(i), 0.0, i % 2, 1.0) for i in range(n)]


def scored(grown, df):
    return {r["id"]: r["p"] for r in forest.forest_probability(grown, df, "p").collect()}


def plain_best(x, y, w, feature):
    """Least weighted Gini impurity over all cuts of one input."""

    def impurity(rows):
        total, ones = w[rows].sum(), (w * y)[rows].sum()
        return 2 * ones * (total - ones) / total

    values = np.unique(x[:, feature])
    cuts = (values[1:] + values[:-1]) / 2
    return min((impurity(x[:, feature] <= c) + impurity(x[:, feature] > c), c) for c in cuts)


def test_a_root_takes_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    for turn in range(20):
        x = rng.integers(0, 12, (80, 2)).astype(float)
        y = (x[:, 0] + rng.normal(0, 3, 80) > 6).astype(float)
        w = rng.integers(1, 4, 80).astype(float)
        tree = forest.grow(x, y, w, 2, turn)
        best = min(plain_best(x, y, w, f)[0] for f in range(2))
        got = plain_best(x, y, w, tree["feature"][0])
        left = x[:, tree["feature"][0]] <= tree["threshold"][0]
        total = sum(2 * (w * y)[s].sum() * (w * (1 - y))[s].sum() / w[s].sum() for s in (left, ~left))
        assert got[0] == pytest.approx(best) and total == pytest.approx(best)


def test_a_tree_is_pure_where_rows_can_be_told_apart():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3)).round(2)
    y = rng.integers(0, 2, 3000).astype(float)
    tree = forest.grow(x, y, np.ones(3000), 1, 5)
    p = forest._walk(tree, x)
    by = {}
    for row, label in zip(map(tuple, x), y):
        by.setdefault(row, []).append(label)
    want = [np.mean(by[tuple(row)]) for row in x]
    assert np.allclose(p, want)


def test_depth_has_no_limit(spark, tmp_path):
    grown = forest.grow_forest(table(spark, chain(400)), INPUTS, str(tmp_path / "g"), trees=40)
    assert grown.depth() >= 15
    p = scored(grown, table(spark, chain(400)))
    assert sum((p[i] >= 0.5) == (i % 2 == 1) for i in range(400)) >= 380


def test_large_nodes_are_split_in_spark(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), 0, 1.0) for i in range(1000)]
    rows = [(i, a, b, int(a > 0.3 and b > 0.6), w) for i, a, b, _, w in rows]
    df = table(spark, rows)
    grown = forest.grow_forest(df, INPUTS, str(tmp_path / "f"), trees=8, few=250)
    assert grown.splits.count() > 8 and grown.cells.count() > grown.splits.select("tree").distinct().count()
    p = scored(grown, df)
    assert all((p[r[0]] >= 0.5) == bool(r[3]) for r in rows)
    shares = {r["feature"]: r["importance"] for r in grown.importances().collect()}
    assert sum(shares.values()) == pytest.approx(1) and min(shares.values()) > 0.1
    grown.save(str(tmp_path / "again"))
    assert scored(forest.Forest(spark, str(tmp_path / "again"), INPUTS), df) == p


def test_constant_inputs_and_mixed_rows_end_in_a_leaf(spark, tmp_path):
    for few in (forest.FEW, 100):
        rows = [(i, 1.0, 2.0, int(i % 4 == 0), 1.0) for i in range(400)]
        grown = forest.grow_forest(table(spark, rows), INPUTS, str(tmp_path / str(few)), trees=30, few=few)
        assert grown.depth() == 0
        (p,) = set(scored(grown, table(spark, rows)).values())
        assert p == pytest.approx(0.25, abs=0.05)


def test_one_hot_value_and_one_class(spark, tmp_path):
    rows = [(i, 5.0 if i % 10 else float(i), 0.0, int(i % 10 == 0), 1.0) for i in range(1000)]
    grown = forest.grow_forest(table(spark, rows), INPUTS, str(tmp_path / "h"), trees=9, few=400)
    p = scored(grown, table(spark, rows))
    assert all((p[r[0]] >= 0.5) == bool(r[3]) for r in rows if r[1] != 5.0 or not r[3])
    rows = [(i, float(i), 0.0, 1, 1.0) for i in range(50)]
    grown = forest.grow_forest(table(spark, rows), INPUTS, str(tmp_path / "one"), trees=3)
    assert set(scored(grown, table(spark, rows)).values()) == {1.0}


def test_an_empty_table(spark, tmp_path):
    grown = forest.grow_forest(table(spark, []), INPUTS, str(tmp_path / "e"), trees=3)
    assert scored(grown, table(spark, chain(3))) == {0: None, 1: None, 2: None}
    assert scored(grown, table(spark, [])) == {}
    assert grown.importances().count() == 0


def test_saved_forests_load_as_forests(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, float(i), float(i % 24), float(i % 24), 0, int(i > 30)) for i in range(60)],
        "transaction_id long, amount double, log_amount double, hour double, is_high_amount int, label int",
    )
    model = training.train_model(rows, training.FOREST)
    training.save(model, str(tmp_path / "m"))
    again = training.load(str(tmp_path / "m"))
    first, second = (
        {r["transaction_id"]: r["predicted_prob"] for r in training.score(m, rows).collect()} for m in (model, again)
    )
    assert first == second
    right = training.score(model, rows).filter(F.col("predicted_label") == F.col("label")).count()
    assert right >= 58
    assert training.feature_importance(spark, model, 2).first()["feature"] == "amount"


def test_draws_are_those_of_spark(spark):
    rows = spark.range(-500, 500).select(F.col("id").alias("row"), F.lit(7).alias("tree"))
    hashes = rows.select(F.xxhash64("row", "tree", F.lit(42)).alias("h")).toPandas()["h"].to_numpy()
    mine = forest._hash_int(42, forest._hash_int(7, forest._hashed(np.arange(-500, 500))))
    assert (mine.view(np.int64) == hashes).all()


def test_large_nodes_leave_no_copies_of_the_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), int(rng.random() > 0.5), 1.0) for i in range(2000)]
    size = []
    for trees in (1, 12):
        with intermediates(spark) as folder:
            forest.grow_forest(table(spark, rows), INPUTS, str(tmp_path / str(trees)), trees=trees, few=300)
            size.append(sum(f.stat().st_size for f in Path(folder).rglob("*.parquet")))
    assert size[1] < 1.5 * size[0]


def test_large_nodes_that_common_slices_do_not_part(spark, tmp_path, monkeypatch):
    """Most values lie in one slice of all rows, and there the label follows them."""
    rows = [(i, i * 1e-9 if i % 3 else 1.0 + i, 0.0, int(i % 3 > 0 and i > 1000), 1.0) for i in range(2000)]
    monkeypatch.setattr(forest, "QUANTILES", 2)
    grown = forest.grow_forest(table(spark, rows), INPUTS, str(tmp_path / "s"), trees=9, few=200)
    p = scored(grown, table(spark, rows))
    assert sum((p[r[0]] >= 0.5) == bool(r[3]) for r in rows) >= 1990


def test_slices_of_a_row_are_found_once_for_all_trees(monkeypatch):
    rng = np.random.default_rng(6)
    rows, trees = 3000, 30
    x, y = rng.random((rows, 2)), rng.integers(0, 2, rows).astype(np.int32)
    edges = [np.unique(rng.random(50)) for _ in INPUTS]
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * 2)
    batch = pa.RecordBatch.from_pydict({
        "x": pa.ListArray.from_arrays(ends, pa.array(x.ravel())), "y": pa.array(y),
        "w": pa.array(np.ones(rows)), "row": pa.array(np.arange(rows)),
    })

    class Table:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, *rest: looked.append(len(a)) or search(a, *rest))
    tops = {tree: forest._Top() for tree in range(trees)}
    found = forest._sums(Table(), tops, [(tree, 0) for tree in tops], [edges], 2, 42)
    assert sum(n == len(edges[0]) for n in looked) <= 2 * len(INPUTS)  # once for each tree before
    for part in found:
        tree = part.column("tree")[0].as_py()
        sums = np.frombuffer(part.column("sums")[0].as_py()).reshape(2, forest.SLICES, 4)
        times = forest._drawn(forest._hashed(np.arange(rows)), tree, 42)
        for f in range(2):
            slices = search(edges[f], x[:, f])
            for k, each in enumerate((times > 0, (times > 0) * y, times * y, times)):
                assert (sums[f, :, k] == np.bincount(slices, each, forest.SLICES)).all()
