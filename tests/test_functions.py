import math

import pytest
from conftest import values
from pyspark.sql import functions as F

from scorewright.functions import amounts, labels, names, prompts, responses
from scorewright.functions.text import float_text, strip, to_number


def one_column(spark, items, kind):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")


def apply(spark, items, kind, column):
    return [r[0] for r in one_column(spark, items, kind).orderBy("i").select(column).collect()]


def test_labels_from_words(spark):
    words = ["1", "TRUE ", " Fraudulent", "yes\n", "fraud", "no", "2", "1.0", "0.7", "", None]
    got = apply(spark, words, "string", labels.word_to_int(F.col("x")))
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_labels_from_numbers(spark):
    df = one_column(spark, [1.0, 0.0, 2.0, 0.7, -1.5, math.nan, None], "double")
    got = df.orderBy("i").select(labels.label_to_int(F.col("x"), df.schema["x"].dataType)).collect()
    assert [r[0] for r in got] == [1, 0, 2, 0, -1, None, None]
    flags = one_column(spark, [True, False], "boolean")
    got = flags.orderBy("i").select(labels.label_to_int(F.col("x"), flags.schema["x"].dataType))
    assert [r[0] for r in got.collect()] == [1, 0]


def test_amounts_from_text(spark):
    df = spark.createDataFrame(
        [(i, x) for i, x in enumerate(["12.5", "abc", "", None, "-1", "0.9d", " 3 ", "1e2", "."])],
        "i int, Amount string",
    )
    got = values(df.withColumn("v", amounts.amount(df)).orderBy("i"), "v")
    assert [v for (v,) in got] == [12.5, 0.0, 0.0, 0.0, -1.0, 0.0, 3.0, 100.0, 0.0]


def test_amount_columns(spark):
    other = spark.createDataFrame([(5.0, 7.0)], "TransactionAmt double, x double")
    assert other.select(amounts.amount(other)).first()[0] == 5.0
    both = spark.createDataFrame([(5.0, 7.0)], "TransactionAmt double, Amount double")
    assert both.select(amounts.amount(both)).first()[0] == 7.0
    none = spark.createDataFrame([(1,)], "x int")
    assert none.select(amounts.amount(none)).first()[0] == 0.0
    missing = spark.createDataFrame([(math.nan,), (None,)], "Amount double")
    assert [r[0] for r in missing.select(amounts.amount(missing)).collect()] == [0.0, 0.0]


def test_hours(spark):
    seconds = [-1.0, 0.0, 3599.9, 3600.0, 86400.0, 90000.0, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(seconds)], "i int, Time double")
    got = [v for (v,) in values(df.withColumn("h", amounts.hour(df)).orderBy("i"), "h")]
    assert got == [23.0, 0.0, 0.0, 1.0, 0.0, 1.0, None]
    text = spark.createDataFrame([("noon",)], "Time string")
    assert text.select(amounts.hour(text)).first()[0] == 0.0
    assert text.select(amounts.hour(text.drop("Time").withColumn("a", F.lit(1)))).first()[0] == 0.0


def test_log_amount(spark):
    got = apply(spark, [0.0, math.e - 1, -1.0, -2.0], "double", amounts.log_amount(F.col("x")))
    assert got[:2] == [0.0, pytest.approx(1.0)] and got[2:] == [None, None]


def test_float_text(spark):
    numbers = [0.0, 1.0, 0.01, 12.3, 0.0005, 1e7, 12345678.25, 9007199254740993.0, -2.5e8, 0.1]
    assert apply(spark, numbers, "double", float_text(F.col("x"))) == [repr(n) for n in numbers]


def test_transaction_text(spark):
    full = spark.createDataFrame(
        [(7, 12.5, 3.2), (8, None, math.nan)], "transaction_id long, Time double, Amount double"
    ).orderBy("transaction_id")
    assert [r[0] for r in full.select(amounts.txn_text(full)).collect()] == [
        "Transaction TID: 7 — Time: 12.5 — Amount: $3.2",
        "Transaction TID: 8 — Time: NA — Amount: $NA",
    ]
    bare = spark.createDataFrame([(7, 1)], "transaction_id long, Time int")
    assert bare.select(amounts.txn_text(bare)).first()[0] == (
        "Transaction TID: 7 — Time: 1 — Amount: $NA"
    )
    assert bare.select(amounts.txn_text_short(bare)).first()[0] == "Time: 1 — Amount: $NA"


def test_strip_and_numbers(spark):
    spaced = ["　a b ", "\t\n x ", "y", "", None]
    assert apply(spark, spaced, "string", strip(F.col("x"))) == ["a b", "x", "y", "", None]
    texts = ["1", " .5 ", "5.", "+1e-2", "1f", "nan", "1_0", "", None]
    assert apply(spark, texts, "string", to_number(F.col("x"))) == (
        [1.0, 0.5, 5.0, 0.01] + [None] * 5
    )


def test_model_names(spark):
    runs = ["LOCAL_LOCAL_LLAMA_x", "local_y", "LLM_openai_m", " RandomForest ", "LOCALX", "", " ", None]
    kinds = apply(spark, runs, "string", names.engine_type(F.col("x")))
    assert kinds == ["Local HF", "Local HF", "Cloud LLM", "ML Model", "ML Model"] + ["Unknown"] * 3
    shown = apply(spark, runs, "string", names.display_label(F.col("x")))
    assert shown == ["LLAMA_x", "local_y", "openai_m", "RandomForest", "LOCALX", "", " ", None]
    made = spark.range(1).select(
        names.local_run_name(F.lit("local_llama"), F.lit("a/b/c")),
        names.cloud_run_name(F.lit("openai"), F.lit("gpt-4o-mini")),
    ).first()
    assert list(made) == ["LOCAL_LOCAL_LLAMA_a_b_c", "LLM_openai_gpt-4o-mini"]


ANSWERS = [
    ("LABEL: FRAUD\nCONFIDENCE: 0.42\nREASON: unusual: large",
     "FRAUD", 0.42, "unusual: large", "FRAUD", 0.42, "unusual: large"),
    ("label: not_fraud\r\nconfidence: 0.05\rreason: routine",
     "not_fraud", 0.05, "routine", "NOT_FRAUD", 0.05, "routine"),
    ("Sure.\n\n  LABEL : fraudulent  \nREASON: new device",
     "fraudulent", None, "new device", "FRAUD", 0.5, "new device"),
    ("LABEL FRAUD\nCONFIDENCE high",
     "LABEL FRAUD", None, "CONFIDENCE high", "NOT_FRAUD", 0.5, "CONFIDENCE high"),
    ("LABEL: NOT_FRAUD\nLABEL: FRAUD\nCONFIDENCE: high\ndone",
     "FRAUD", None, "done", "FRAUD", 0.5, "done"),
    ("ERROR: timeout",
     "ERROR: timeout", None, "ERROR: timeout", "NOT_FRAUD", 0.5, "ERROR: timeout"),
    ("", None, None, None, "NOT_FRAUD", 0.5, ""),
    (None, None, None, None, "NOT_FRAUD", 0.5, None),
    (" \n ", None, None, None, "NOT_FRAUD", 0.5, " \n "),
    ("FRAUD\nCONFIDENCE: 0.9d\nlooks odd",
     "FRAUD", None, "looks odd", "FRAUD", 0.5, "looks odd"),
    ("LABEL:\nCONFIDENCE: 1\nREASON:",
     "", 1.0, "", "NOT_FRAUD", 1.0, "LABEL:\nCONFIDENCE: 1\nREASON:"),
    ("CONFIDENCE: 0.2\nCONFIDENCE: x Reason why\x85Label: Fraud",
     "Fraud", None, "Reason why", "FRAUD", 0.5, "Reason why"),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, raw string")
    got = responses.normalise(responses.parse(df, "raw"), "raw").orderBy("i")
    columns = ["raw", "parsed_label", "parsed_conf", "parsed_reason"]
    columns += ["predicted_label", "predicted_prob", "reason"]
    assert values(got, *columns) == ANSWERS


def test_reply_shapes(spark):
    replies = ['{"generated_text":"a"}', '[{"generated_text":"b"},{"generated_text":"c"}]', "plain",
               '{"other":1}', "[]", None]
    got = apply(spark, replies, "string", responses.generated_text(F.col("x")))
    assert got == ["a", "b", "plain", '{"other":1}', "[]", None]


def test_echo(spark):
    rows = [("ask: ", "ask:  yes \n"), ("ask: ", " no "), ("a.c", "abc x"), ("p", "p")]
    df = spark.createDataFrame(rows, "prompt string, output string")
    got = df.select(responses.without_echo(F.col("output"), F.col("prompt"))).collect()
    assert [r[0] for r in got] == ["yes", "no", "abc x", ""]


def test_errors_become_text(spark):
    df = spark.createDataFrame([("a", None), (None, "late"), (None, None)], "o string, e string")
    got = df.select(responses.with_errors(F.col("o"), F.col("e"))).collect()
    assert [r[0] for r in got] == ["a", "ERROR: late", None]


def test_prompts(spark):
    variants = ["few_shot", "base", "few=shot", None]
    got = apply(spark, variants, "string", prompts.prompt(F.lit("T"), F.col("x")))
    assert got[0].endswith("Now classify:\nTransaction:\nT\n\nAnswer now.\n")
    assert got[1] == got[2] == got[3]
    assert got[1].endswith("Transaction:\nT\n\nNow provide the answer adhering to the format exactly.\n")


def test_context(spark):
    df = spark.sql(
        """select array(named_struct('rank', 2, 'text', 'b'), named_struct('rank', 1, 'text', 'a'),
             named_struct('rank', 10, 'text', 'c')) as hits
           union all select cast(array() as array<struct<rank:int,text:string>>)"""
    )
    got = {r[0] for r in df.select(prompts.context_block(F.col("hits"))).collect()}
    assert got == {
        "",
        "Retrieved similar transactions (for context):\n"
        "Example 1: a\nExample 2: b\nExample 10: c\n\n",
    }


def test_old_context(spark):
    hits = F.expr("array(named_struct('rank', 1, 'text', 'a'))")
    got = spark.range(1).select(prompts.old_context_block(hits)).first()[0]
    assert got == "\n\nRetrieved similar transactions:\nExample 1: \na\n\n\n"


def test_tuning_example(spark):
    got = spark.range(1).select(prompts.tuning_example(F.lit("T"), F.lit(1))).first()[0]
    assert got == "Transaction:\nT\n\nIs this fraud? FRAUD"
