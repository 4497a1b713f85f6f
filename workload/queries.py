"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.functions import amounts, labels, names, prompts, responses
from scorewright.functions.labels import label_to_int
from scorewright.operators import compare, embedding, evaluate, features, quantile
from scorewright.operators import retrieval, split
from scorewright.operators.ranking import file_row_index, row_index
from scorewright.plans import experiment, responding, training
from scorewright.session import materialise, new_path, spread
from scorewright.sources import answers, corpus, runlog, transactions, tuning
from scorewright.streaming import log_metrics
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
PAIR = (fx.FOREST, fx.CLOUD)
ASKED = [fx.FOREST, "NotThere", fx.LOCAL]
EXACT = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, EXACT) for c in columns})


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", runlog.STAMP_FORMAT))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return features.features(fx.loaded(spark, sf))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(feature_table(spark, sf))


# ------------------------------------------------------------- sources and sinks


def load_transactions(spark, sf):
    return fx.loaded(spark, sf).select(
        "transaction_id", "Time", "Amount", "event_type", "user_id", "label", "txn_text"
    )


def load_transactions_csv(spark, sf):
    """A CSV with a Class column and no ids, numbered in file order."""
    path = new_path(spark, "raw-csv")
    raw = fx.txn(spark, sf).withColumnRenamed("transaction_id", "event_id")
    ordered = raw.orderBy("event_id").select("event_id", "Time", "Amount", F.col("label").alias("Class"))
    ordered.write.option("header", True).csv(path)
    schema = "event_id long, Time double, Amount double, Class string"
    return transactions.load_transactions(spark, path, schema=schema).select(
        "transaction_id", "event_id", "Time", "Amount", "label"
    )


def load_transactions_strict(spark, sf):
    """Most transactions have no quality label, and the strict load drops those."""
    marks = fx.table(spark, sf, "labels").withColumnRenamed("doc_id", "transaction_id")
    raw = fx.txn(spark, sf).drop("label").join(marks, "transaction_id", "left")
    strict = transactions.standardise_strict(raw.withColumnRenamed("toxic", "Class"))
    return strict.select("transaction_id", "Time", "Amount", "quality", "label", "txn_text")


def numbered_by_amount(spark, sf):
    raw = fx.table(spark, sf, "events").select("event_id", "value")
    return row_index(raw, ["value", "event_id"])


def numbered_by_file(spark, sf):
    return file_row_index(spark, f"{sf}/events.parquet").select("transaction_id", "event_id")


def log_append(spark, sf):
    """Two appends to a new log, read back."""
    path = new_path(spark, "log")
    log = fx.run_log(spark, sf)
    by_rule = F.col("model_name").isin(fx.FOREST, fx.LOGISTIC)
    runlog.append(log.filter(by_rule), path)
    runlog.append(log.filter(~by_rule), path)
    return stamped(runlog.read(spark, path))


def log_append_repeated(spark, sf):
    """Two named runs, each logged twice: a first try with part of its rows, then all of them."""
    path = new_path(spark, "log")
    log = fx.run_log(spark, sf)
    by_rule = F.col("model_name").isin(fx.FOREST, fx.LOGISTIC)
    for run, rows in (("rules", log.filter(by_rule)), ("texts", log.filter(~by_rule))):
        runlog.append(rows.filter("transaction_id % 3 = 0"), path, run)
        runlog.append(rows, path, run)
    return stamped(runlog.read(spark, path))


def log_read(spark, sf):
    """CSV out and in again, with line ends and quotes in the reasons."""
    path = new_path(spark, "log-csv")
    runlog.export_csv(fx.run_log(spark, sf), path)
    return stamped(runlog.read_csv(spark, path)).na.fill("", ["prompt_variant", "reason"])


def log_read_tolerant(spark, sf):
    path = new_path(spark, "foreign-log")
    fx.run_log(spark, sf).drop("predicted_prob", "reason").write.parquet(path)
    return stamped(runlog.read_tolerant(spark, path))


def model_save_load(spark, sf):
    table = spread(materialise(parts(spark, sf), "parts"))
    fitted = training.train_model(table.filter("split = 'train'"), training.LOGISTIC)
    path = new_path(spark, "model")
    training.save(fitted, path)
    again = training.score(training.load(path), table)
    return again.select("transaction_id", "split", "predicted_prob", "predicted_label")


def model_save_load_checked(spark, sf):
    """Whether a saved and loaded model scores every row as before."""
    table = spread(materialise(parts(spark, sf), "parts"))
    fitted = training.train_model(table.filter("split = 'train'"), training.LOGISTIC)
    path = new_path(spark, "model")
    training.save(fitted, path)
    found = F.struct("predicted_prob", "predicted_label")
    before = training.score(fitted, table).select("transaction_id", "split", found.alias("a"))
    after = training.score(training.load(path), table).select("transaction_id", found.alias("b"))
    same = F.col("a").eqNullSafe(F.col("b")).alias("same")
    return before.join(after, "transaction_id").select("transaction_id", "split", same)


def corpus_build(spark, sf):
    documents = fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text"
    )
    embedder = embedding.fit_embedder(documents)
    return corpus.build(documents, new_path(spark, "corpus"), embedder).select("doc_id", "text")


def profile_load(spark, sf):
    table = fx.loaded(spark, sf)
    return transactions.profile(split.stratified_split(table))


# ------------------------------------------------------------------- projections


def label_forms(spark, sf):
    raw = fx.txn(spark, sf)
    return raw.select(
        "transaction_id",
        label_to_int(F.col("label"), raw.schema["label"].dataType).alias("from_word"),
        label_to_int(F.col("Amount"), raw.schema["Amount"].dataType).alias("from_number"),
    )


def txn_text(spark, sf):
    raw = fx.txn(spark, sf)
    return raw.select("transaction_id", amounts.txn_text(raw).alias("txn_text"))


def txn_text_short(spark, sf):
    raw = fx.txn(spark, sf)
    return raw.select("transaction_id", amounts.txn_text_short(raw).alias("txn_text"))


def amount_coerce(spark, sf):
    """Amounts as text, some of them not numbers, under the second known name."""
    number = F.col("value").cast("string")
    text = (
        F.when(F.col("event_type") == "view", F.concat(number, F.lit("d")))
        .when(F.col("event_type") == "click", F.concat(F.lit(" "), number, F.lit(" ")))
        .when(F.col("event_type") == "signup", F.lit("n/a"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("-"), number))
        .otherwise(number)
    )
    raw = fx.table(spark, sf, "events").select("event_id", text.alias("TransactionAmt"))
    return features.with_amount(raw).select("event_id", "amount")


def log_amount(spark, sf):
    value = F.round(amounts.log_amount(F.col("o_totalprice")), EXACT)
    return fx.table(spark, sf, "orders").select("o_orderkey", value.alias("log_amount"))


def hour(spark, sf):
    raw = fx.txn(spark, sf)
    return raw.select("transaction_id", amounts.hour(raw).alias("hour"))


def high_amount_flag(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("Amount")
    )
    threshold = features.high_amount_threshold(orders)
    flag = amounts.high_amount(F.col("Amount"), threshold)
    return orders.select("o_orderkey", flag.alias("is_high_amount"))


def feature_rows(spark, sf):
    return rounded(feature_table(spark, sf), "log_amount")


def model_inputs(spark, sf):
    return rounded(features.model_inputs(feature_table(spark, sf)), "log_amount")


def model_filter(spark, sf):
    return stamped(runlog.of_model(fx.run_log(spark, sf), fx.LOCAL))


def log_project(spark, sf):
    share = F.col("Amount") / (F.col("Amount") + 50)
    scored = fx.loaded(spark, sf).withColumns(
        {"predicted_prob": F.round(share, EXACT), "predicted_label": labels.at_threshold(share)}
    )
    rows = runlog.log_rows(
        scored, F.lit("AmountRule"), timestamp=F.lit(fx.STAMP).cast("timestamp")
    )
    return stamped(rows)


def model_run_name(spark, sf):
    model = F.concat(F.lit("team/"), "event_type", F.lit("/"), "user_id")
    return fx.txn(spark, sf).select(
        "transaction_id",
        names.local_run_name(F.col("event_type"), model).alias("local_name"),
        names.cloud_run_name(F.col("event_type"), model).alias("cloud_name"),
    )


def _run_names() -> Column:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return (
        F.when(kind == "view", F.concat(F.lit("LOCAL_LOCAL_LLAMA_"), user))
        .when(kind == "click", F.concat(F.lit("local_"), user))
        .when(kind == "signup", F.concat(F.lit(" LLM_openai_"), user))
        .when(kind == "error", F.lit("  "))
        .otherwise(F.concat(F.lit("Forest"), user))
    )


def classify_model(spark, sf):
    named = fx.txn(spark, sf).select("transaction_id", _run_names().alias("model_name"))
    return named.select(
        "transaction_id",
        names.engine_type(F.col("model_name")).alias("engine_type"),
        names.display_label(F.col("model_name")).alias("display_label"),
    )


def score_threshold(spark, sf):
    share = F.col("Amount") / (F.col("Amount") + 50)
    return fx.txn(spark, sf).select(
        "transaction_id", labels.at_threshold(share).alias("predicted_label")
    )


def display_projection(spark, sf):
    return runlog.display(stamped(fx.run_log(spark, sf)).drop("prompt_variant"))


# -------------------------------------------------------------------------- joins


def disagreement_details(spark, sf):
    return compare.disagreement_details(fx.run_log(spark, sf), *PAIR)


def retrieve_topk(spark, sf):
    return retrieval.retrieve_topk(
        fx.vectors(spark, sf, "query_id"), fx.vector_corpus(spark, sf), k=3
    )


def retrieve_topk_bucketed(spark, sf):
    return retrieval.retrieve_topk_cells(
        fx.vectors(spark, sf, "query_id"), fx.vector_corpus(spark, sf), k=3
    )


def retrieve_topk_probed(spark, sf):
    return retrieval.retrieve_topk_probed(
        fx.vectors(spark, sf, "query_id"), fx.vector_corpus(spark, sf), k=3
    )


def retrieve_recall(spark, sf):
    """Whether the approximate search finds nine tenths of the exact hits."""
    measured = retrieval.recall(retrieve_topk_probed(spark, sf), retrieve_topk(spark, sf))
    return measured.select("n_hits", (F.col("recall") >= 0.9).alias("reached"))


def attach_labels(spark, sf):
    table = feature_table(spark, sf)
    marks = fx.loaded(spark, sf).select("transaction_id", F.col("label").alias("y"))
    joined = split.attach_labels(table.drop("label", "txn_text"), marks)
    return rounded(joined, "log_amount")


def attach_responses(spark, sf):
    """Orders as transactions; only those with a number of an event have an answer."""
    answers = fx.responses(spark, sf).select("transaction_id", F.col("raw").alias("output"))
    txns = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), "o_totalprice"
    )
    return responding.attach_responses(txns, answers)


def model_presence(spark, sf):
    return evaluate.model_presence(fx.run_log(spark, sf), ASKED)


# --------------------------------------------------------------------- aggregates


def amount_quantile(spark, sf):
    return rounded(quantile.quantile(fx.txn(spark, sf), "Amount", 0.95), "quantile")


def confusion_counts(spark, sf):
    return evaluate.confusion_counts(fx.run_log(spark, sf))


def flat_matrix(df: DataFrame) -> DataFrame:
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    matrix = F.col("confusion_matrix")
    flat = {name: matrix[row][column] for name, (row, column) in cells.items()}
    return rounded(df.withColumns(flat).drop("confusion_matrix"), "precision", "recall", "f1")


def model_metrics(spark, sf):
    return flat_matrix(evaluate.model_metrics(fx.run_log(spark, sf)))


def compare_models(spark, sf):
    return flat_matrix(evaluate.compare_models(fx.run_log(spark, sf), ASKED))


def selected_metrics(spark, sf):
    wanted = evaluate.selected_metrics(fx.run_log(spark, sf), ASKED)
    return rounded(wanted, "precision", "recall", "f1")


def log_stats(spark, sf):
    return evaluate.log_stats(fx.run_log(spark, sf))


def model_inventory(spark, sf):
    return evaluate.model_inventory(fx.run_log(spark, sf))


def prediction_pivot(spark, sf):
    return compare.prediction_pivot(fx.run_log(spark, sf))


def class_weights(spark, sf):
    return rounded(features.class_weights(fx.loaded(spark, sf)), "weight")


def scaler_stats(spark, sf):
    return rounded(features.scaler_stats(feature_table(spark, sf)), "mean", "std")


def class_balance(spark, sf):
    return split.class_balance(parts(spark, sf))


# --------------------------------------------------- sorts, samples, sets, comparison


def top_features(spark, sf):
    fitted, _ = _fitted(spark, sf, training.LOGISTIC)
    return training.feature_importance(spark, fitted, top_k=10)


def top_features_checked(spark, sf):
    """The inputs of a fit on a known label; the one that says least about it."""
    fitted, _ = _fitted_known(spark, sf, training.LOGISTIC)
    return training.feature_importance(spark, fitted).select("feature", _is_least())


def disagreements_top(spark, sf):
    return compare.disagreements_top(fx.run_log(spark, sf), *PAIR, rows=20)


def log_sample(spark, sf):
    return stamped(runlog.sample(fx.run_log(spark, sf), rows=50))


def models_sorted(spark, sf):
    return evaluate.models_sorted(fx.run_log(spark, sf))


def retrieval_corpus(spark, sf):
    return corpus.retrieval_rows(parts(spark, sf))


def log_union(spark, sf):
    log = fx.run_log(spark, sf)
    by_rule = F.col("model_name").isin(fx.FOREST, fx.LOGISTIC)
    return stamped(runlog.union(log.filter(by_rule).drop("reason"), log.filter(~by_rule)))


def corpus_replace(spark, sf):
    """Building twice at one place; turns of a conversation share its id."""
    turns = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        "text",
        F.array().cast("array<float>").alias("embedding"),
    )
    path = new_path(spark, "replaced-corpus")
    corpus.build(turns.withColumn("text", F.upper("text")), path)
    return corpus.build(turns, path).select("doc_id", "text")


def disagreements(spark, sf):
    return compare.disagreements(fx.run_log(spark, sf), *PAIR)


def disagreement_count(spark, sf):
    return compare.disagreement_count(fx.run_log(spark, sf))


# --------------------------------------------------------------------------- text


def embed_text(spark, sf):
    documents = spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    fitted = embedding.fit_embedder(documents)
    return embedding.embed(fitted, documents).select("doc_id", "embedding")


def embed_text_checked(spark, sf):
    """The length of each vector, and whether it has length one (or zero, without any words)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = (F.abs(norm - 1) < 1e-3) | (norm == 0)
    return embed_text(spark, sf).select(
        "doc_id", F.size("embedding").alias("n_dims"), unit.alias("unit")
    )


def prompt_base(spark, sf):
    text = prompts.base_prompt(F.col("txn_text"))
    return fx.loaded(spark, sf).select("transaction_id", text.alias("prompt"))


def prompt_few_shot(spark, sf):
    """The few-shot template for purchases, the base one for every other variant name."""
    variant = F.when(F.col("event_type") == "purchase", "few_shot").otherwise(F.col("event_type"))
    text = prompts.prompt(F.col("txn_text"), variant)
    return fx.loaded(spark, sf).select("transaction_id", text.alias("prompt"))


def prompt_with_context(spark, sf):
    hits = retrieve_topk(spark, sf)
    txns = fx.loaded(spark, sf).select("transaction_id", "txn_text")
    return responding.build_prompts(txns, "base", hits).select("transaction_id", "prompt")


def response_parse(spark, sf):
    """The answer fixture and every conversation turn."""
    made = fx.responses(spark, sf).select(
        F.concat(F.lit("r"), "transaction_id").alias("key"), "raw"
    )
    spoken = fx.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"),
        F.col("text").alias("raw"),
    )
    parsed = responses.parse(made.unionByName(spoken), "raw")
    return parsed.select("key", "parsed_label", "parsed_conf", "parsed_reason")


def response_errors(spark, sf):
    """A missing answer becomes an error text and is parsed as one."""
    text = responses.with_errors(F.col("raw"), F.lit("no answer"))
    df = fx.responses(spark, sf).select("transaction_id", text.alias("response"))
    return responses.normalise(responses.parse(df, "response"), "response").select(
        "transaction_id", "response", "predicted_label", "predicted_prob", "reason"
    )


def label_normalise(spark, sf):
    df = fx.responses(spark, sf).select("transaction_id", "raw")
    return responses.normalise(responses.parse(df, "raw"), "raw").select(
        "transaction_id", "predicted_label", "predicted_prob", "reason"
    )


def strip_echo(spark, sf):
    """Events repeat the prompt before the answer, except for views."""
    prompt = F.col("prompt")
    answer = F.concat(F.lit("\n  LABEL: FRAUD for "), "event_type", F.lit(" \n"))
    output = F.when(F.col("event_type") == "view", answer).otherwise(F.concat(prompt, answer))
    df = fx.loaded(spark, sf).withColumn("prompt", prompts.base_prompt(F.col("txn_text")))
    text = responses.without_echo(output, prompt)
    return df.select("transaction_id", text.alias("answer"))


def response_json_text(spark, sf):
    """Conversation turns as object, list or plain text, depending on the speaker."""
    single = F.to_json(F.struct(F.col("text").alias("generated_text")))
    several = F.to_json(F.array(F.struct(F.col("text").alias("generated_text"))))
    reply = (
        F.when(F.col("role") == "user", single)
        .when(F.col("role") == "assistant", several)
        .otherwise(F.col("text"))
    )
    turns = fx.table(spark, sf, "conversations").withColumn("reply", reply)
    return turns.select("conv_id", "turn", responses.generated_text(F.col("reply")).alias("answer"))


def tuning_examples(spark, sf):
    return tuning.examples(parts(spark, sf)).select("transaction_id", "text")


# ------------------------------------------------------------------ split and models


def stratified_split(spark, sf):
    return parts(spark, sf).select("transaction_id", "label", "split")


def split_hash(spark, sf):
    return split.hash_split(fx.loaded(spark, sf)).select("transaction_id", "label", "split")


def _fitted(spark, sf, kind):
    table = spread(materialise(parts(spark, sf), "parts"))
    fitted = training.train_model(table.filter("split = 'train'"), kind)
    return fitted, table.filter("split = 'test'")


def _fitted_known(spark, sf, kind):
    """A fit on a label that one of the inputs is, so that each row's class is known."""
    known = parts(spark, sf).withColumn("label", F.col("is_high_amount"))
    table = spread(materialise(known, "parts"))
    fitted = training.train_model(table.filter("split = 'train'"), kind)
    return fitted, table.filter("split = 'test'")


def _in_range() -> Column:
    return F.col("predicted_prob").between(0, 1).alias("in_range")


def _is_least() -> Column:
    """Of a model's few inputs the one with the least importance."""
    return (F.rank().over(Window.orderBy("importance")) == 1).alias("is_least")


def _classes_known(kind: str) -> Query:
    def query(spark, sf):
        fitted, test = _fitted_known(spark, sf, kind)
        scored = training.score(fitted, test)
        return scored.select("transaction_id", "label", "predicted_label", _in_range())

    return query


def train_random_forest(spark, sf):
    fitted, test = _fitted(spark, sf, training.FOREST)
    return training.score(fitted, test).select("transaction_id", "label", "predicted_prob")


def train_logistic(spark, sf):
    fitted, test = _fitted(spark, sf, training.LOGISTIC)
    return training.score(fitted, test).select("transaction_id", "label", "predicted_prob")


def feature_importance(spark, sf):
    fitted, _ = _fitted(spark, sf, training.FOREST)
    return training.feature_importance(spark, fitted)


def feature_importance_checked(spark, sf):
    fitted, _ = _fitted_known(spark, sf, training.FOREST)
    total = F.round(F.sum("importance").over(Window.partitionBy()), EXACT).alias("total")
    return training.feature_importance(spark, fitted).select("feature", _is_least(), total)


def score_and_log_checked(spark, sf):
    fitted, test = _fitted_known(spark, sf, training.LOGISTIC)
    path = new_path(spark, "log")
    runlog.append(training.score_to_log(fitted, test, fx.LOGISTIC), path)
    return runlog.read(spark, path).select(
        "transaction_id", "true_label", "predicted_label", "model_name", _in_range()
    )


def scoring_stats_checked(spark, sf):
    return scoring_stats(spark, sf).select("model_name", "n")


def score_and_log(spark, sf):
    fitted, test = _fitted(spark, sf, training.LOGISTIC)
    path = new_path(spark, "log")
    runlog.append(training.score_to_log(fitted, test, fx.LOGISTIC), path)
    return flat_matrix(evaluate.model_metrics(runlog.read(spark, path)))


def scoring_stats(spark, sf):
    fitted, test = _fitted(spark, sf, training.LOGISTIC)
    return training.scoring_stats(fitted, test, fx.LOGISTIC)


def batch_respond(spark, sf):
    txns = fx.loaded(spark, sf).select("transaction_id", "label", "txn_text")
    stamp = F.lit(fx.STAMP).cast("timestamp")
    rows = responding.batch_respond(
        txns, fx.rule_responder, F.lit(fx.LOCAL), "few_shot", timestamp=stamp
    )
    return stamped(rows)


def _short_prompts(spark, sf):
    """Transactions whose text is their amount alone, so that many prompts are equal."""
    text = F.format_string("Amount: $%.2f", "Amount").alias("txn_text")
    return fx.loaded(spark, sf).select("transaction_id", "label", text)


def batch_respond_stored(spark, sf):
    """A run over every other transaction, then one over all that uses its answers."""
    store, txns = new_path(spark, "answers"), _short_prompts(spark, sf)
    stamp = F.lit(fx.STAMP).cast("timestamp")
    half = txns.filter("transaction_id % 2 = 0")
    for rows in (half, txns):
        log = responding.batch_respond(
            rows, fx.rule_responder, F.lit(fx.LOCAL), "few_shot", timestamp=stamp, store=store
        )
    return stamped(log)


def answers_asked(spark, sf):
    """How many prompts each of the two runs had to ask."""
    store, txns = new_path(spark, "answers"), _short_prompts(spark, sf)
    runs = (("first", txns.filter("transaction_id % 2 = 0")), ("second", txns))
    for run, rows in runs:
        responding.batch_respond(
            rows, fx.rule_responder, F.lit(fx.LOCAL), "few_shot", store=store, run=run
        )
    return answers.read(spark, store).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def full_experiment(spark, sf):
    return flat_matrix(
        experiment.run_experiment(fx.txn(spark, sf), fx.rule_responder, "local_llama", "team/rule")
    )


def full_experiment_checked(spark, sf):
    """All counts of the text model, whose rule SQL can follow; rows and support of the fits."""
    rule = ~F.col("model_name").isin(experiment.FOREST_RUN, experiment.LOGISTIC_RUN)
    counts = [F.when(rule, F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")]
    rows = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")
    return full_experiment(spark, sf).select("model_name", "support", rows, *counts)


def disagreement_details_latest(spark, sf):
    """The last run of each model only, so that every transaction has one row."""
    return compare.disagreement_details(runlog.latest_only(fx.run_log(spark, sf)), *PAIR)


def disagreement_details_page(spark, sf):
    """The first transactions only, as a page shows them."""
    return compare.disagreement_details(fx.run_log(spark, sf), *PAIR, rows=20)


def disagreements_raw(spark, sf):
    """Compared and shown as logged."""
    return compare.disagreements(fx.run_log(spark, sf), *PAIR, raw=True)


def log_metrics_stream(spark, sf):
    """The log followed as a stream; the last batch holds the metrics of all rows."""
    path = new_path(spark, "streamed-log")
    runlog.append(fx.run_log(spark, sf), path)
    target = new_path(spark, "streamed-metrics")
    query = log_metrics.start(spark, path, target, new_path(spark, "stream-state"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return flat_matrix(spark.read.parquet(f"{target}/batch={last}"))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "load_transactions": load_transactions,
    "load_transactions_csv": load_transactions_csv,
    "load_transactions_strict": load_transactions_strict,
    "row_index": numbered_by_amount,
    "row_index_file_order": numbered_by_file,
    "log_append": log_append,
    "log_append_repeated": log_append_repeated,
    "log_read": log_read,
    "log_read_tolerant": log_read_tolerant,
    "model_save_load": model_save_load,
    "model_save_load_checked": model_save_load_checked,
    "corpus_build": corpus_build,
    "profile_load": profile_load,
    # projections and filters
    "label_to_int": label_forms,
    "txn_text": txn_text,
    "txn_text_short": txn_text_short,
    "amount_coerce": amount_coerce,
    "log_amount": log_amount,
    "hour": hour,
    "high_amount_flag": high_amount_flag,
    "features": feature_rows,
    "model_inputs": model_inputs,
    "model_filter": model_filter,
    "log_project": log_project,
    "model_run_name": model_run_name,
    "classify_model": classify_model,
    "score_threshold": score_threshold,
    "display_projection": display_projection,
    # joins
    "disagreement_details": disagreement_details,
    "disagreement_details_latest": disagreement_details_latest,
    "disagreement_details_page": disagreement_details_page,
    "retrieve_topk": retrieve_topk,
    "retrieve_topk_bucketed": retrieve_topk_bucketed,
    "retrieve_topk_probed": retrieve_topk_probed,
    "retrieve_recall": retrieve_recall,
    "attach_labels": attach_labels,
    "attach_responses": attach_responses,
    "model_presence": model_presence,
    # aggregates
    "amount_quantile": amount_quantile,
    "confusion_counts": confusion_counts,
    "model_metrics": model_metrics,
    "compare_models": compare_models,
    "selected_metrics": selected_metrics,
    "log_stats": log_stats,
    "model_inventory": model_inventory,
    "prediction_pivot": prediction_pivot,
    "class_weights": class_weights,
    "scaler_stats": scaler_stats,
    "class_balance": class_balance,
    # sorts, samples, sets, comparison
    "top_features": top_features,
    "top_features_checked": top_features_checked,
    "disagreements_top": disagreements_top,
    "log_sample": log_sample,
    "models_sorted": models_sorted,
    "retrieval_corpus": retrieval_corpus,
    "log_union": log_union,
    "corpus_replace": corpus_replace,
    "disagreements": disagreements,
    "disagreements_raw": disagreements_raw,
    "disagreement_count": disagreement_count,
    # text
    "embed_text": embed_text,
    "embed_text_checked": embed_text_checked,
    "prompt_base": prompt_base,
    "prompt_few_shot": prompt_few_shot,
    "prompt_with_context": prompt_with_context,
    "response_parse": response_parse,
    "response_errors": response_errors,
    "label_normalise": label_normalise,
    "strip_echo": strip_echo,
    "response_json_text": response_json_text,
    "tuning_examples": tuning_examples,
    # split and models
    "stratified_split": stratified_split,
    "split_hash": split_hash,
    "train_random_forest": train_random_forest,
    "train_random_forest_checked": _classes_known(training.FOREST),
    "train_logistic": train_logistic,
    "train_logistic_checked": _classes_known(training.LOGISTIC),
    "feature_importance": feature_importance,
    "feature_importance_checked": feature_importance_checked,
    "score_and_log": score_and_log,
    "score_and_log_checked": score_and_log_checked,
    "scoring_stats": scoring_stats,
    "scoring_stats_checked": scoring_stats_checked,
    "batch_respond": batch_respond,
    "batch_respond_stored": batch_respond_stored,
    "answers_asked": answers_asked,
    "full_experiment": full_experiment,
    "full_experiment_checked": full_experiment_checked,
    "log_metrics_stream": log_metrics_stream,
}
