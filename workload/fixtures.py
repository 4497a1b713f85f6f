"""Domain tables derived from the given Parquet tables, as Spark frames and as SQL.

Every table keeps all rows of its source.  ``FIXTURES.md`` describes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.sources.transactions import standardise

FOREST = "RandomForest"
LOGISTIC = "LogisticRegression"
LOCAL = "LOCAL_LOCAL_LLAMA_tiny"
CLOUD = "LLM_openai_gpt-4o-mini"
MODELS = [CLOUD, LOCAL, LOGISTIC, FOREST]
STAMP = "2024-02-01 00:00:00"
LATER = "2024-02-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- transactions

RAW_LABEL = """case event_type when 'error' then ' Fraud' when 'signup' then 'no'
    when 'view' then '0' when 'click' then 'false' else 'NOT_FRAUD' end"""


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions: events with seconds, an amount and a label in mixed spellings."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as transaction_id",
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D as Time",
        "value as Amount",
        "event_type",
        "user_id",
        f"{RAW_LABEL} as label",
    )


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise(txn(spark, sf_dir))


TXN_SQL = f"""
txn as (
  select event_id as transaction_id,
    date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) / 1e6::double as "Time",
    value as "Amount", event_type, user_id,
    {RAW_LABEL} as raw_label
  from events),
loaded as (
  select *,
    case when lower(trim(raw_label)) in ('1', 'true', 'fraud', 'fraudulent', 'yes')
      then 1 else 0 end as label,
    'Transaction TID: ' || transaction_id || ' — Time: ' || "Time"::varchar
      || ' — Amount: $' || "Amount"::varchar as txn_text
  from txn)"""

FEATURES_SQL = f"""{TXN_SQL},
features as (
  select transaction_id, "Amount" as amount, round(ln(1 + "Amount"), 6) as log_amount,
    (floor("Time" / 3600)::bigint % 24)::double as hour,
    case when "Amount" > (select quantile_cont("Amount", 0.95) from loaded)
      then 1 else 0 end as is_high_amount,
    label, txn_text
  from loaded)"""


# ----------------------------------------------------------------------- split


def _cut_sql(source: str, name: str, percent: int, of: int, salt: int) -> str:
    """Rank inside each class; a row leaves when its rank passes the class quota."""
    return f"""
{name}_ranked as (
  select *, row_number() over (
      partition by label order by md5('{salt}:' || transaction_id), transaction_id) as rk
  from {source}),
{name}_sizes as (
  select label, count(*)::bigint as n, (sum(count(*)) over ())::bigint as nn
  from {source} group by label),
{name}_floors as (
  select label, nn, (nn - (nn * {percent} + {of - 1}) // {of}) as keep,
    n * (nn - (nn * {percent} + {of - 1}) // {of}) // nn as fl,
    n * (nn - (nn * {percent} + {of - 1}) // {of}) % nn as rem
  from {name}_sizes),
{name}_quota as (
  select label, fl + case when row_number() over (order by rem desc, label)
      <= keep - (sum(fl) over ()) then 1 else 0 end as quota
  from {name}_floors),
{name}_kept as (
  select r.* exclude (rk) from {name}_ranked r join {name}_quota q using (label)
  where rk <= quota)"""


SPLIT_SQL = f"""{FEATURES_SQL},{_cut_sql("features", "test", 15, 100, 42)},
{_cut_sql("test_kept", "val", 15, 85, 43)},
parts as (
  select f.*, case when v.transaction_id is not null then 'train'
      when t.transaction_id is not null then 'val' else 'test' end as split
  from features f
  left join test_kept t using (transaction_id)
  left join val_kept v using (transaction_id))"""


# --------------------------------------------------------------------- run log


def _run(
    model: str, guess: Column, variant: str, reason: Column, stamp: str = STAMP
) -> Column:
    positive = F.lower(guess).isin("1", "fraud")
    return F.struct(
        guess.alias("predicted_label"),
        F.when(guess.isNotNull(), F.when(positive, 0.9).otherwise(0.1)).alias("predicted_prob"),
        F.lit(model).alias("model_name"),
        F.lit(variant).alias("prompt_variant"),
        reason.alias("reason"),
        F.lit(stamp).cast("timestamp").alias("timestamp"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four model runs over all transactions, built in one scan.

    The logistic run has missing predictions; the forest was run again on the error
    events, so those transactions carry two of its rows.
    """
    key, label = F.col("transaction_id"), F.col("label")

    def wrong_every(n: int) -> Column:
        flipped = F.when(key % n == 0, 1 - label).otherwise(label)
        return flipped.cast("string")

    word = F.when(label == 1, "FRAUD").otherwise("NOT_FRAUD")
    blank = F.lit("")
    seen = F.concat(F.lit("event: "), F.col("event_type"), F.lit('\nsaid "'), word, F.lit('"'))
    runs = F.array(
        _run(FOREST, wrong_every(10), "", blank),
        _run(LOGISTIC, F.when(key % 11 != 0, wrong_every(7)), "", blank),
        _run(LOCAL, F.when(key % 3 == 0, "NOT_FRAUD").otherwise(word), "base", seen),
        _run(CLOUD, F.when(key % 4 == 0, "FRAUD").otherwise(word), "few_shot_rag", seen),
    )
    again = F.array(_run(FOREST, F.lit("1"), "", blank, LATER))
    rows = F.when(F.col("event_type") == "error", F.concat(runs, again)).otherwise(runs)
    return loaded(spark, sf_dir).select(
        "transaction_id", label.alias("true_label"), F.inline(rows)
    ).select(
        "transaction_id",
        "true_label",
        "predicted_label",
        "predicted_prob",
        "model_name",
        "prompt_variant",
        "reason",
        "timestamp",
    )


_SEEN_SQL = """'event: ' || event_type || chr(10) || 'said "'
    || case when label = 1 then 'FRAUD' else 'NOT_FRAUD' end || '"'"""


def _run_sql(model: str, guess: str, variant: str, reason: str, stamp: str, rest: str = "") -> str:
    return f"""
  select transaction_id, label as true_label, {guess} as predicted_label,
    '{model}' as model_name, '{variant}' as prompt_variant, {reason} as reason,
    '{stamp}' as "timestamp" from loaded {rest}"""


_WORD_SQL = "case when label = 1 then 'FRAUD' else 'NOT_FRAUD' end"


def _wrong_sql(n: int) -> str:
    return f"(case when transaction_id % {n} = 0 then 1 - label else label end)::varchar"


LOG_SQL = f"""{TXN_SQL},
log_runs as ({
    " union all ".join([
        _run_sql(FOREST, _wrong_sql(10), "", "''", STAMP),
        _run_sql(
            LOGISTIC,
            f"case when transaction_id % 11 <> 0 then {_wrong_sql(7)} end",
            "", "''", STAMP,
        ),
        _run_sql(
            LOCAL,
            f"case when transaction_id % 3 = 0 then 'NOT_FRAUD' else {_WORD_SQL} end",
            "base", _SEEN_SQL, STAMP,
        ),
        _run_sql(
            CLOUD,
            f"case when transaction_id % 4 = 0 then 'FRAUD' else {_WORD_SQL} end",
            "few_shot_rag", _SEEN_SQL, STAMP,
        ),
        _run_sql(FOREST, "'1'", "", "''", LATER, "where event_type = 'error'"),
    ])
}),
log as (
  select transaction_id, true_label, predicted_label,
    case when predicted_label in ('1', 'FRAUD') then 0.9::double
      when predicted_label is not null then 0.1::double end as predicted_prob,
    model_name, prompt_variant, reason, "timestamp",
    case when lower(trim(coalesce(predicted_label, ''))) in
      ('1', 'true', 'fraud', 'fraudulent', 'yes') then 1 else 0 end as guess
  from log_runs)"""

LOG_COLUMNS_SQL = """transaction_id, true_label, predicted_label, predicted_prob, model_name,
    prompt_variant, reason, "timestamp\""""

METRICS_SQL = f"""{LOG_SQL},
counts as (
  select model_name,
    count(*) filter (true_label = 1 and guess = 1) as tp,
    count(*) filter (true_label = 0 and guess = 1) as fp,
    count(*) filter (true_label = 1 and guess = 0) as fn,
    count(*) filter (true_label = 0 and guess = 0) as tn
  from log group by model_name),
metrics as (
  select model_name,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
    tp, fp, fn, tn, tp + fn as support
  from counts)"""

FIRST_SQL = f"""{LOG_SQL},
firsts as (
  select transaction_id, model_name, predicted_label, guess,
    row_number() over (partition by transaction_id, model_name
      order by "timestamp", 1 - guess, predicted_label) as nth
  from log where predicted_label is not null),
wide as (
  select transaction_id,
    {", ".join(f'''max(predicted_label) filter (model_name = '{m}' and nth = 1) as "{m}"'''
               for m in MODELS)}
  from firsts group by transaction_id),
classes as (
  select transaction_id,
    {", ".join(f'''max(guess) filter (model_name = '{m}' and nth = 1) as "{m}"'''
               for m in MODELS)}
  from firsts group by transaction_id)"""


# ------------------------------------------------------------------- responses


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text answer per transaction, in ten shapes; some missing."""
    key = F.col("transaction_id")
    sure = (key % 90 + 10).cast("string")
    shapes = [
        F.concat(F.lit("LABEL: FRAUD\nCONFIDENCE: 0."), sure, F.lit("\nREASON: unusual: large")),
        F.lit("label: not_fraud\nconfidence: 0.05\nreason: routine"),
        F.lit("Sure.\n\n  LABEL : fraudulent  \nREASON: new device"),
        F.lit("LABEL FRAUD\nCONFIDENCE high"),
        F.lit("LABEL: NOT_FRAUD\nLABEL: FRAUD\nCONFIDENCE: high\ndone"),
        F.lit("ERROR: timeout"),
        F.lit(""),
        F.lit(None).cast("string"),
        F.lit("FRAUD\nCONFIDENCE: 0.9d\nlooks odd"),
        F.lit("LABEL:\nCONFIDENCE: 1\nREASON:"),
    ]
    shape = (key % len(shapes)).cast("int") + 1
    return loaded(spark, sf_dir).select(
        "transaction_id", "label", "txn_text", F.element_at(F.array(*shapes), shape).alias("raw")
    )


RESPONSES_SQL = f"""{TXN_SQL},
responses as (
  select transaction_id, label, txn_text, case transaction_id % 10
    when 0 then 'LABEL: FRAUD' || chr(10) || 'CONFIDENCE: 0.' || (transaction_id % 90 + 10)
      || chr(10) || 'REASON: unusual: large'
    when 1 then 'label: not_fraud' || chr(10) || 'confidence: 0.05' || chr(10) || 'reason: routine'
    when 2 then 'Sure.' || chr(10) || chr(10) || '  LABEL : fraudulent  ' || chr(10)
      || 'REASON: new device'
    when 3 then 'LABEL FRAUD' || chr(10) || 'CONFIDENCE high'
    when 4 then 'LABEL: NOT_FRAUD' || chr(10) || 'LABEL: FRAUD' || chr(10) || 'CONFIDENCE: high'
      || chr(10) || 'done'
    when 5 then 'ERROR: timeout' when 6 then '' when 7 then null
    when 8 then 'FRAUD' || chr(10) || 'CONFIDENCE: 0.9d' || chr(10) || 'looks odd'
    else 'LABEL:' || chr(10) || 'CONFIDENCE: 1' || chr(10) || 'REASON:' end as raw
  from loaded)"""


def parse_sql(source: str, key: str, text: str) -> str:
    """CTEs ``{source}_parsed`` and ``{source}_normal`` over one text column."""
    blanks = "' ' || chr(9) || chr(10) || chr(13)"
    number = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

    def last(prefix: str) -> str:
        return f"list_filter(ls, lambda x: starts_with(lower(x), '{prefix}'))[-1]"

    def after(line: str) -> str:
        return (
            f"case when position(':' in {line}) > 0 "
            f"then trim(substr({line}, position(':' in {line}) + 1), {blanks}) end"
        )

    return f"""
{source}_lines as (
  select *, case when {text} <> '' then list_filter(
      list_transform(string_split({text}, chr(10)), lambda x: trim(x, {blanks})),
      lambda x: x <> '') end as ls
  from {source}),
{source}_found as (
  select *, {last("label")} as l_line, {last("confidence")} as c_line, {last("reason")} as r_line
  from {source}_lines),
{source}_parsed as (
  select * exclude (ls, l_line, c_line, r_line),
    coalesce({after("l_line")}, l_line, ls[1]) as parsed_label,
    case when regexp_matches({after("c_line")}, '{number}')
      then try_cast({after("c_line")} as double) end as parsed_conf,
    coalesce({after("r_line")}, r_line, ls[-1]) as parsed_reason
  from {source}_found),
{source}_normal as (
  select *,
    case when starts_with(lower(trim(parsed_label)), 'fraud') then 'FRAUD'
      else 'NOT_FRAUD' end as predicted_label,
    coalesce(parsed_conf, 0.5) as predicted_prob,
    coalesce(nullif(parsed_reason, ''), {text}) as reason
  from {source}_parsed)"""


# --------------------------------------------------------------- text and vectors


def vectors(spark: SparkSession, sf_dir: str, id_name: str) -> DataFrame:
    """All given vectors, as queries or as documents."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(id_name), "embedding"
    )


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given vectors with the text of the transaction of the same number."""
    texts = loaded(spark, sf_dir).select(F.col("transaction_id").alias("vec_id"), "txn_text")
    return (
        table(spark, sf_dir, "embeddings")
        .join(texts, "vec_id", "left")
        .select(
            F.col("vec_id").cast("string").alias("doc_id"),
            F.coalesce("txn_text", F.lit("")).alias("text"),
            "embedding",
        )
    )


HITS_SQL = f"""{TXN_SQL},
pairs as (
  select q.vec_id as query_id, d.vec_id::varchar as doc_id,
    round(pow(list_distance(q.embedding::double[], d.embedding::double[]), 2), 6) as distance
  from embeddings q, embeddings d),
hits as (
  select p.query_id, p.rk::int as rank, p.doc_id, coalesce(l.txn_text, '') as text, p.distance
  from (
    select *, row_number() over (partition by query_id order by distance, doc_id) as rk
    from pairs) p
  left join loaded l on l.transaction_id = p.doc_id::bigint
  where p.rk <= 3)"""


def rule_responder():
    """A stand-in for a text model: judges by the amount in the prompt's last transaction."""
    import re

    amount = re.compile(r"Amount: \$([0-9.]+)")

    def respond(prompts: list[str]) -> list[str]:
        answers = []
        for prompt in prompts:
            value = float(amount.findall(prompt)[-1])
            label = "FRAUD" if value > 60 else "NOT_FRAUD"
            sure = min(0.99, 0.5 + abs(value - 60) / 200)
            answers.append(f"LABEL: {label}\nCONFIDENCE: {sure:.2f}\nREASON: amount {value:.2f}")
        return answers

    return respond
