"""The run log, metrics and comparison on small frames."""

import random

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from scorewright.operators import compare, evaluate
from scorewright.operators.skew import hot_keys, placed
from scorewright.schemas import LOG_COLUMNS, LOG_SCHEMA
from scorewright.sources import runlog
from scorewright.streaming import log_metrics

FIRST, SECOND = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def log_of(spark, rows):
    """rows: (id, truth, guess, model[, stamp])"""
    full = [
        (r[0], r[1], r[2], 0.5, r[3], "", 'said "x"\nand more', r[4] if len(r) > 4 else FIRST)
        for r in rows
    ]
    schema = LOG_SCHEMA.simpleString().replace("struct<", "").rstrip(">").replace(
        "timestamp:timestamp", "timestamp:string"
    )
    schema = ", ".join(part.replace(":", " ") for part in schema.split(","))
    df = spark.createDataFrame(full, schema)
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@pytest.fixture(scope="module")
def mixed(spark):
    """Id 1 only in C; 2 agrees; 3 only in C; 4 differs in kind of label but agrees; 5 differs."""
    return log_of(
        spark,
        [
            (1, 1, "FRAUD", "C"),
            (2, 0, "0", "A"), (2, 0, "NOT_FRAUD", "B"),
            (3, 1, "FRAUD", "C"), (3, 1, None, "A"),
            (4, 1, "1", "A"), (4, 1, "FRAUD", "B"),
            (5, 1, "1", "A", SECOND), (5, 1, "0", "A", FIRST), (5, 1, "FRAUD", "B"),
            (6, 0, None, "A"),
        ],
    )


def test_append_and_read(spark, mixed, tmp_path):
    path = str(tmp_path / "log")
    runlog.append(mixed.filter("model_name = 'A'").drop("reason"), path)
    runlog.append(mixed.filter("model_name <> 'A'"), path)
    back = runlog.read(spark, path)
    assert back.columns == LOG_COLUMNS and back.count() == mixed.count()
    assert back.filter("model_name = 'A' and reason is not null").count() == 0
    pruned = plan_of(runlog.of_model(back, "A"))
    assert "PartitionFilters: [isnotnull(model_name" in pruned


def test_missing_log(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runlog.read(spark, str(tmp_path / "none")).count()
    assert runlog.read_tolerant(spark, str(tmp_path / "none")) is None


def test_csv_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "csv")
    runlog.export_csv(mixed, path)
    back = runlog.read_csv(spark, path)
    assert back.count() == mixed.count()
    assert {r["reason"] for r in back.collect()} == {'said "x"\nand more'}
    assert back.agg(F.max("timestamp")).first()[0] == mixed.agg(F.max("timestamp")).first()[0]


def test_tolerant_fill(spark, mixed):
    filled = runlog.complete(mixed.drop("predicted_prob", "reason", "prompt_variant"))
    row = filled.first()
    assert (row["predicted_prob"], row["reason"], row["prompt_variant"]) == (None, "", "")


def test_tolerant_csv(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    with open(path, "w") as out:
        out.write("transaction_id,true_label,predicted_label,model_name,extra\n1,x,0,A,z\n2,1,FRAUD,B,\n")
    log = runlog.read_tolerant(spark, path, "csv").orderBy("transaction_id")
    assert values(log, "transaction_id", "true_label", "predicted_label", "predicted_prob", "reason", "extra") == [
        (1, None, "0", None, "", "z"), (2, 1, "FRAUD", None, "", None)
    ]


def test_latest_only(spark, mixed):
    newest = runlog.latest_only(mixed).filter("transaction_id = 5 and model_name = 'A'")
    assert values(newest, "predicted_label") == [("1",)]


def test_sample_is_repeatable(spark, mixed):
    first = values(runlog.sample(mixed, 4), *LOG_COLUMNS)
    assert first == values(runlog.sample(mixed.repartition(5), 4), *LOG_COLUMNS)
    assert len(first) == 4 and runlog.sample(mixed, 500).count() == mixed.count()


def test_display(spark, mixed):
    shown = runlog.display(mixed.drop("prompt_variant"))
    assert shown.columns[0:3] == ["transaction_id", "timestamp", "model_name"]
    assert shown.filter(" or ".join(f"`{c}` is null" for c in shown.columns)).count() == 0


def test_metrics_with_zero_division(spark):
    log = log_of(
        spark,
        [(1, 0, "0", "NONE"), (2, 0, "0", "NONE"), (1, 1, "0", "NEVER"), (1, 1, "1", "ALL"),
         (2, 1, "FRAUD", "ALL"), (3, 1, None, "ALL")],
    )
    got = {r["model_name"]: r for r in evaluate.model_metrics(log).collect()}
    for name in ("NONE", "NEVER"):
        assert (got[name]["precision"], got[name]["recall"], got[name]["f1"]) == (0.0, 0.0, 0.0)
    assert got["NONE"]["confusion_matrix"] == [[2, 0], [0, 0]]
    assert got["NONE"]["support"] == 0 and got["NEVER"]["support"] == 1
    assert got["ALL"]["precision"] == 1.0 and got["ALL"]["recall"] == pytest.approx(2 / 3)
    assert got["ALL"]["confusion_matrix"] == [[0, 0], [1, 2]]


def test_requested_models(spark, mixed):
    compared = evaluate.compare_models(mixed, ["C", "X", "A"])
    assert [r["model_name"] for r in compared.collect()] == ["C", "A"]
    selected = evaluate.selected_metrics(mixed, ["X", "C"]).collect()
    assert [(r["model"], r["precision"], r["support"]) for r in selected] == [("X", None, 0), ("C", 1.0, 2)]
    present = evaluate.model_presence(mixed, ["C", "X"]).orderBy("position")
    assert values(present, "model_name", "present") == [("C", True), ("X", False)]


def test_stats_and_inventory(spark):
    log = log_of(spark, [(1, 0, "0", "LOCAL_RAG_x"), (1, 0, "0", "LLM_m"), (None, 0, "0", "M")])
    log = log.withColumn("prompt_variant", F.when(F.col("model_name") == "LLM_m", "base_RAG"))
    assert values(evaluate.log_stats(log), "n_rows", "n_transactions") == [(3, 1)]
    assert values(evaluate.model_inventory(log), "raw_name", "engine_type", "display_label", "rag_used") == [
        ("LLM_m", "Cloud LLM", "m", True), ("LOCAL_RAG_x", "Local HF", "RAG_x", True),
        ("M", "ML Model", "M", False),
    ]
    assert values(evaluate.models_sorted(log, 2), "model_name") == [("LLM_m",), ("LOCAL_RAG_x",)]


def test_pivot(spark, mixed):
    got = values(compare.prediction_pivot(mixed).orderBy("transaction_id"), "transaction_id", "A", "B", "C")
    assert got == [
        (1, None, None, "FRAUD"), (2, "0", "NOT_FRAUD", None), (3, None, None, "FRAUD"),
        (4, "1", "FRAUD", None), (5, "0", "FRAUD", None),
    ]


def test_pivot_with_many_spellings(spark):
    rows = [(i % 7, 1, f"guess {i}", "A", f"2024-01-{1 + (i * 11) % 28:02d} 00:00:00") for i in range(28)]
    many = compare.prediction_pivot(log_of(spark, rows))
    assert "SortAggregate" in plan_of(many)
    first = {}
    for key, _, guess, _, stamp in sorted(rows, key=lambda r: (r[4], r[2])):
        first.setdefault(key, guess)
    assert dict(values(many, "transaction_id", "A")) == first
    few = compare.prediction_pivot(log_of(spark, rows[:14]))
    assert "SortAggregate" not in plan_of(few)
    first = {}
    for key, _, guess, _, stamp in sorted(rows[:14], key=lambda r: (r[4], r[2])):
        first.setdefault(key, guess)
    assert dict(values(few, "transaction_id", "A")) == first


def test_times_at_the_edges(spark):
    rows = [(1, 1, "0", "A", "9999-12-31 23:59:59"), (1, 1, "1", "A", None), (2, 0, "x", "A", None)]
    log = log_of(spark, rows)
    assert sorted(values(compare.prediction_pivot(log), "transaction_id", "A")) == [(1, "0"), (2, "x")]
    assert sorted(values(compare.class_pivot(log), "transaction_id", "A")) == [(1, 0), (2, 0)]


def test_class_pivot_matches_pivot(spark, sf):
    from workload import fixtures as fx
    from scorewright.functions.labels import word_to_int

    log = fx.run_log(spark, sf)
    words, classes = compare.prediction_pivot(log), compare.class_pivot(log)
    as_int = words.select(
        "transaction_id",
        *[F.when(F.col(f"`{m}`").isNotNull(), word_to_int(F.col(f"`{m}`"))).alias(m) for m in fx.MODELS],
    )
    assert as_int.exceptAll(classes).count() == 0 and classes.exceptAll(as_int).count() == 0


def test_disagreements(spark, mixed):
    ids = [r[0] for r in values(compare.disagreements(mixed, "A", "B").orderBy("transaction_id"), "transaction_id")]
    assert ids == [1, 3, 5]
    raw = compare.disagreements(mixed, "A", "B", raw=True)
    assert sorted(r[0] for r in values(raw, "transaction_id")) == [1, 2, 3, 4, 5]
    assert values(compare.disagreements_top(mixed, "A", "B", 2), "transaction_id") == [(1,), (3,)]
    with pytest.raises(ValueError, match="no recorded"):
        compare.disagreements(mixed, "A", "Z")


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_disagreement_details_fan_out(spark, mixed, hot_rows):
    got = compare.disagreement_details(mixed, "A", "B", hot_rows=hot_rows)
    assert values(got.orderBy("transaction_id", "pred_A"), "transaction_id", "pred_A", "pred_B") == [
        (1, None, None), (3, None, None), (5, "0", "FRAUD"), (5, "1", "FRAUD")
    ]
    first = compare.disagreement_details(mixed, "A", "B", rows=2)
    assert sorted(values(first, "transaction_id", "true_label")) == [(1, None), (3, 1)]


def test_equal_rows_of_a_hot_key_go_to_all_parts(spark):
    rows = placed(spark.range(6_400, numPartitions=2).selectExpr("7 as transaction_id"))
    counts = rows.groupBy("_spot").count().collect()
    assert sorted(r["_spot"] for r in counts) == list(range(64))
    assert {r["count"] for r in counts} == {100}


def test_model_without_a_recorded_prediction(spark, mixed):
    silent = mixed.withColumns({"model_name": F.lit("Z"), "predicted_label": F.lit(None).cast("string")})
    with pytest.raises(ValueError, match="no recorded predictions"):
        compare.disagreements(mixed.unionByName(silent), "A", "Z")


def test_hot_transaction(spark):
    """One transaction holds a third of the rows of a model."""
    rows = [(i, 1, "1", "A") for i in range(200)] + [(7, 1, "1", "A", SECOND)] * 100
    log = log_of(spark, rows + [(i, 1, "0" if i % 5 else "1", "B") for i in range(200)])
    assert hot_keys(log, "transaction_id", hot_rows=50) == [7]
    assert hot_keys(log, "transaction_id") == []
    plain = compare.disagreement_details(log, "A", "B")
    spread = compare.disagreement_details(log, "A", "B", hot_rows=50)
    assert spread.exceptAll(plain).count() == 0 and spread.count() == plain.count() == 160 + 100
    assert spread.filter("transaction_id = 7").count() == 101


def test_disagreement_counts(spark, mixed):
    counts = {(r["model_a"], r["model_b"]): r["n"] for r in compare.disagreement_count(mixed).collect()}
    names = ["A", "B", "C"]
    expected = {
        (a, b): compare.disagreements(mixed, a, b).count()
        for i, a in enumerate(names) for b in names[i + 1 :]
    }
    assert counts == expected
    single = compare.disagreement_count(mixed.filter("model_name = 'A'"))
    assert single.count() == 0


def test_pivot_takes_one_exchange(spark, sf):
    from workload import fixtures as fx

    log = fx.run_log(spark, sf)
    for wide in (compare.class_pivot(log, fx.MODELS), compare.prediction_pivot(log, fx.MODELS)):
        plan = plan_of(wide)
        assert plan.count("Exchange (") <= 2 and "hashpartitioning(transaction_id" in plan
    assert "SortAggregate" not in plan_of(compare.class_pivot(log, fx.MODELS))


def test_stream_equals_batch(spark, mixed, tmp_path):
    path, target = str(tmp_path / "log"), str(tmp_path / "out")
    state = str(tmp_path / "state")
    for name in ("A", "B", "C"):
        runlog.append(mixed.filter(F.col("model_name") == name), path)
    query = log_metrics.start(spark, path, target, state, files_per_batch=1)
    query.awaitTermination()
    batches = query.lastProgress["batchId"]
    assert batches >= 1
    streamed = spark.read.parquet(f"{target}/batch={batches}")
    batch = evaluate.model_metrics(runlog.read(spark, path))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    runlog.append(mixed.filter("model_name = 'A'"), path)
    log_metrics.start(spark, path, target, state).awaitTermination()
    later = spark.read.parquet(f"{target}/batch={batches + 1}")
    assert later.filter("model_name = 'A'").first()["support"] == 2 * batch.filter(
        "model_name = 'A'"
    ).first()["support"]


def test_agreement_of_many_models_is_counted_without_pair_rows(spark):
    rng = random.Random(6)
    names = [f"m{i:03}" for i in range(70)]
    rows = [
        (t, n, str(rng.randrange(2)), t)
        for t in range(40) for n in names if rng.random() < 0.8
    ]
    rows += [(t, n, "1", t + 100) for t, n, _, _ in rows[:500]] + [(99, "other", "1", 0)]
    log = spark.createDataFrame(rows, "transaction_id long, model_name string, predicted_label string, at long")
    log = log.withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    first = {}
    for t, n, label, at in sorted(rows, key=lambda r: r[3]):
        first.setdefault((t, n), label)
    ids = {t for t, _, _, _ in rows}
    found = compare.disagreement_count(log, names)
    assert "Generate explode" not in plan_of(found)
    got = {(r["model_a"], r["model_b"]): r["n"] for r in found.collect()}
    assert len(got) == 70 * 69 // 2
    for (a, b), n in got.items():
        same = sum(1 for t in ids if first.get((t, a)) is not None and first.get((t, a)) == first.get((t, b)))
        assert n == len(ids) - same


def test_a_repeated_run_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    first, other = (log_of(spark, [(i, 1, "1", m) for i in range(n)]) for m, n in (("A", 5), ("B", 3)))
    runlog.append(first.limit(2), path, "one")
    runlog.append(first, path, "one")
    runlog.append(other, path, "two")
    runlog.append(other, path)
    assert runlog.read(spark, path).groupBy("model_name").count().collect() and runlog.read(spark, path).count() == 11

    def broken(batches):
        yield next(batches)
        raise ValueError("lost")

    with pytest.raises(Exception):
        runlog.append(first.mapInArrow(broken, first.schema), path, "one")
    assert sorted(values(runlog.read(spark, path).groupBy("model_name").count(), "model_name", "count")) == [("A", 5), ("B", 6)]
    assert runlog.read(spark, path).columns == LOG_COLUMNS
