"""Training, answering and the whole experiment."""

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from scorewright.functions.prompts import BASE_HEAD
from scorewright.operators.evaluate import model_metrics
from scorewright.plans import experiment, responding, training
from scorewright.sources import runlog, tuning
from workload import fixtures as fx


@pytest.fixture(scope="module")
def train(spark):
    """Class 1 wherever the amount is above 70, so both classifiers can find it."""
    k = F.col("id")
    amount = ((k * 37) % 100).cast("double")
    return spark.range(600).select(
        k.alias("transaction_id"),
        amount.alias("amount"),
        F.log1p(amount).alias("log_amount"),
        (k % 24).cast("double").alias("hour"),
        F.when(amount > 94, 1).otherwise(0).alias("is_high_amount"),
        F.when(amount > 70, 1).otherwise(0).alias("label"),
    )


@pytest.mark.parametrize("kind", [training.FOREST, training.LOGISTIC])
def test_classifier(spark, train, kind, tmp_path):
    model = training.train_model(train, kind, tree_depth=4)
    scored = training.score(model, train)
    row = scored.agg(
        F.min("predicted_prob").alias("low"),
        F.max("predicted_prob").alias("high"),
        F.avg((F.col("label") == F.col("predicted_label")).cast("int")).alias("right"),
        F.count_if((F.col("predicted_prob") >= 0.5) != (F.col("predicted_label") == 1)).alias("off"),
    ).first()
    assert 0 <= row["low"] <= row["high"] <= 1 and row["right"] > 0.9 and row["off"] == 0
    path = str(tmp_path / "model")
    training.save(model, path)
    again = training.score(training.load(path), train)
    assert again.exceptAll(scored).count() == 0
    top = training.feature_importance(spark, model, top_k=2)
    assert top.count() == 2 and top.first()["feature"] in ("amount", "log_amount")


def test_unknown_classifier(train):
    with pytest.raises(ValueError, match="'rf' or 'logreg'"):
        training.train_model(train, "svm")


def test_balanced_weights(train):
    rows, count = training.weighted(train)
    sums = rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert count == 600 and [r["w"] for r in sums] == [pytest.approx(300), pytest.approx(300)]


def test_logistic_strength(train):
    """The gradient of the penalised, weighted loss vanishes at the fitted coefficients."""
    import numpy as np

    model = training.train_model(train, training.LOGISTIC)
    rows, _ = training.weighted(train)
    data = model.transform(rows).select("inputs", "label", "weight").collect()
    x = np.array([r["inputs"].toArray() for r in data])
    y = np.array([r["label"] for r in data])
    w = np.array([r["weight"] for r in data])
    fitted = model.stages[-1]
    b = fitted.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ b + fitted.intercept)))
    gradient = x.T @ (w * (p - y)) + b
    assert np.abs(gradient).max() < 0.05 * len(y) ** 0.5


def test_scored_log(train):
    model = training.train_model(train, training.LOGISTIC)
    log = training.score_to_log(model, train, "L")
    assert log.count() == 600 and log.filter("reason <> '' or prompt_variant <> ''").count() == 0
    assert {r[0] for r in log.select("predicted_label").distinct().collect()} == {"0", "1"}
    metrics = model_metrics(log).first()
    assert metrics["support"] == train.filter("label = 1").count()
    stats = training.scoring_stats(model, train, "L").first()
    assert stats["n"] == 600 and stats["latency_per_tx"] > 0


def txns(spark, n=10):
    return spark.range(n).select(
        F.col("id").alias("transaction_id"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.concat(F.lit("Amount: $"), F.col("id")).alias("txn_text"),
    )


def test_errors_stay_with_their_prompt(spark):
    def make():
        def respond(prompts):
            if any("$3\n" in p for p in prompts):
                raise RuntimeError("no three")
            return ["LABEL: FRAUD\nCONFIDENCE: 0.9\nREASON: r"] * len(prompts)

        return respond

    log = responding.batch_respond(txns(spark), make, F.lit("M")).orderBy("transaction_id").collect()
    assert len(log) == 10
    bad = log[3]
    assert (bad["predicted_label"], bad["predicted_prob"], bad["reason"]) == ("NOT_FRAUD", 0.5, "ERROR: no three")
    assert {(r["predicted_label"], r["predicted_prob"]) for r in log if r["transaction_id"] != 3} == {("FRAUD", 0.9)}


def test_batches_and_one_model_per_part(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"model-{uuid.uuid4().hex}"), "w").close()

        def respond(prompts):
            assert len(prompts) <= 4
            return [str(len(prompts))] * len(prompts)

        return respond

    prompts = responding.build_prompts(txns(spark).coalesce(1))
    sizes = sorted(r["output"] for r in responding.ask(prompts, make, 4).collect())
    assert sizes == ["2"] * 2 + ["4"] * 8
    assert len(list(tmp_path.iterdir())) == 1


def test_echo_and_json_by_kind_of_model(spark):
    def echo():
        return lambda prompts: [p + " LABEL: FRAUD" for p in prompts]

    def wrapped():
        return lambda prompts: ['{"generated_text": "LABEL: FRAUD"}' for _ in prompts]

    for make, hosted in ((echo, False), (wrapped, True)):
        log = responding.batch_respond(txns(spark), make, F.lit("M"), hosted=hosted)
        assert log.filter("predicted_label = 'FRAUD' and reason = 'LABEL: FRAUD'").count() == 10


def test_prompts_with_and_without_context(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank int, text string")
    prompts = dict(values(responding.build_prompts(txns(spark, 3), hits=hits), "transaction_id", "prompt"))
    assert prompts[0].startswith(BASE_HEAD)
    assert prompts[1].startswith(
        "Retrieved similar transactions (for context):\nExample 1: a\nExample 2: b\n\n" + BASE_HEAD
    )


def test_missing_answers(spark):
    answers = spark.createDataFrame([(0, "yes", None), (1, None, "late")], "transaction_id long, output string, error string")
    got = responding.attach_responses(txns(spark, 3), answers).orderBy("transaction_id")
    assert values(got, "response") == [("yes",), ("ERROR: late",), ("ERROR: no response",)]


def test_tuning_export_takes_training_rows(spark, tmp_path):
    parts = txns(spark, 4).withColumn("split", F.when(F.col("transaction_id") < 3, "train").otherwise("test"))
    path = str(tmp_path / "tuning")
    tuning.write_examples(parts, path)
    back = spark.read.json(path)
    assert back.count() == 3 and {r["split"] for r in back.collect()} == {"train"}
    assert values(back.filter("text like '%$1\n%'"), "text") == [
        ("Transaction:\nAmount: $1\n\nIs this fraud? FRAUD",)
    ]


def test_experiment(spark, sf, tmp_path):
    log_path, model_dir = str(tmp_path / "log"), str(tmp_path / "models")
    raw = fx.txn(spark, sf)
    table = experiment.run_experiment(
        raw, fx.rule_responder, "local_llama", "team/rule", log_path=log_path, model_dir=model_dir
    )
    names = [r["model_name"] for r in table.collect()]
    assert names == ["RandomForest", "LogisticRegression", "LOCAL_LOCAL_LLAMA_team_rule"]
    log = runlog.read(spark, log_path)
    sizes = {r["count"] for r in log.groupBy("model_name").count().collect()}
    assert sizes == {150}
    assert log.select("transaction_id").distinct().count() == 150
    assert log.filter("reason like 'ERROR%'").count() == 0
    assert training.load(f"{model_dir}/rf") is not None
    hosted = experiment.run_experiment(
        raw, fx.rule_responder, "openai", "m", local=False, use_retrieval=False, log_path=log_path
    )
    rows = hosted.collect()
    assert rows[-1]["model_name"] == "LLM_openai_m" and len(rows) == 3


def test_native_text_work(spark, sf):
    """Prompts and parsing stay on the JVM."""
    from workload.queries import QUERIES

    for name in ("prompt_few_shot", "response_parse", "label_normalise", "strip_echo", "features"):
        assert "Python" not in plan_of(QUERIES[name](spark, sf)), name
