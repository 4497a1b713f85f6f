"""The same results as plain SQL over the given tables."""

from __future__ import annotations

from scorewright.functions import prompts
from workload import fixtures as fx

STAMPED = """transaction_id, true_label, predicted_label, predicted_prob, model_name,
    prompt_variant, reason, "timestamp\""""
PAIR = f'"{fx.FOREST}" is distinct from "{fx.CLOUD}" or "{fx.FOREST}" is null'
ASKED = f"""asked as (
  select * from (values (0, '{fx.FOREST}'), (1, 'NotThere'), (2, '{fx.LOCAL}'))
    as a(position, model_name))"""
CLASS_COLUMNS = ", ".join(f'"{m}"' for m in fx.MODELS)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


BASE_PROMPT = f"{text(prompts.BASE_HEAD)} || txn_text || {text(prompts.BASE_TAIL)}"
FEW_SHOT_PROMPT = f"{text(prompts.FEW_SHOT_HEAD)} || txn_text || {text(prompts.FEW_SHOT_TAIL)}"


def with_txn(select: str) -> str:
    return f"with {fx.TXN_SQL} {select}"


def with_features(select: str) -> str:
    return f"with {fx.FEATURES_SQL} {select}"


def with_split(select: str) -> str:
    return f"with {fx.SPLIT_SQL} {select}"


def with_log(select: str) -> str:
    return f"with {fx.LOG_SQL} {select}"


def _details(model: str, truth: str) -> str:
    return f"""(select transaction_id, {truth} predicted_label as "pred_{model}",
      predicted_prob as "prob_{model}", reason as "reason_{model}"
    from log where model_name = '{model}')"""


def _pair_counts() -> str:
    selects = []
    for i, a in enumerate(fx.MODELS):
        for b in fx.MODELS[i + 1 :]:
            selects.append(
                f"""select '{a}' as model_a, '{b}' as model_b, count(*) filter (
                  coalesce("{a}" <> "{b}", true)) as n from classes"""
            )
    return f"with {fx.FIRST_SQL} " + " union all ".join(selects)


INPUTS = ("amount", "log_amount", "hour", "is_high_amount")
KNOWN_CLASSES = with_split(
    """select transaction_id, is_high_amount as label, is_high_amount as predicted_label,
      true as in_range from parts where split = 'test'"""
)
RULE_RUN = "LOCAL_LOCAL_LLAMA_team_rule"


def _details_of(source: str, log: str, wanted: str) -> str:
    return f"""with {fx.FIRST_SQL}, {source}
        select d.*, a.true_label,
          a.predicted_label as "pred_{fx.FOREST}", a.predicted_prob as "prob_{fx.FOREST}",
          a.reason as "reason_{fx.FOREST}", b.predicted_label as "pred_{fx.CLOUD}",
          b.predicted_prob as "prob_{fx.CLOUD}", b.reason as "reason_{fx.CLOUD}"
        from ({wanted}) d
        left join {log} a on a.transaction_id = d.transaction_id and a.model_name = '{fx.FOREST}'
        left join {log} b on b.transaction_id = d.transaction_id and b.model_name = '{fx.CLOUD}'"""


ORACLES: dict[str, str] = {
    "load_transactions": with_txn(
        """select transaction_id, "Time", "Amount", event_type, user_id, label, txn_text
        from loaded"""
    ),
    "load_transactions_csv": with_txn(
        """select row_number() over (order by transaction_id) - 1 as transaction_id,
          transaction_id as event_id, "Time", "Amount", label from loaded"""
    ),
    "model_save_load_checked": with_split(
        "select transaction_id, split, true as same from parts"
    ),
    "disagreement_details_latest": _details_of(
        """latest as (
          select * from log qualify row_number() over (
            partition by transaction_id, model_name order by "timestamp" desc) = 1),
        last_classes as (
          select transaction_id, """
        + ", ".join(f'''max(case when predicted_label is not null then guess end)
            filter (model_name = '{m}') as "{m}"''' for m in fx.MODELS)
        + " from latest group by transaction_id)",
        "latest",
        f"select * from last_classes where {PAIR}",
    ),
    "disagreement_details_page": _details_of(
        "one as (select 1)",
        "log",
        f"select * from classes where {PAIR} order by transaction_id limit 20",
    ),
    "disagreements_raw": f"""with {fx.FIRST_SQL} select * from wide where {PAIR}""",
    "top_features_checked": " union all ".join(
        f"select '{c}' as feature, {str(c == 'hour').lower()} as is_least" for c in INPUTS
    ),
    "embed_text_checked": "select doc_id, 64 as n_dims, true as unit from documents",
    "train_random_forest_checked": KNOWN_CLASSES,
    "train_logistic_checked": KNOWN_CLASSES,
    "feature_importance_checked": " union all ".join(
        f"select '{c}' as feature, {str(c == 'hour').lower()} as is_least, 1.0::double as total"
        for c in INPUTS
    ),
    "score_and_log_checked": with_split(
        f"""select transaction_id, is_high_amount as true_label,
          is_high_amount::varchar as predicted_label, '{fx.LOGISTIC}' as model_name,
          true as in_range from parts where split = 'test'"""
    ),
    "scoring_stats_checked": with_split(
        f"select '{fx.LOGISTIC}' as model_name, count(*) as n from parts where split = 'test'"
    ),
    "batch_respond": with_txn(
        f"""select transaction_id, label as true_label,
          case when "Amount" > 60 then 'FRAUD' else 'NOT_FRAUD' end as predicted_label,
          printf('%.2f', least(0.99::double, 0.5::double + abs("Amount" - 60) / 200))::double
            as predicted_prob,
          '{fx.LOCAL}' as model_name, 'few_shot' as prompt_variant,
          'amount ' || printf('%.2f', "Amount") as reason, '{fx.STAMP}' as "timestamp"
        from loaded"""
    ),
    "batch_respond_stored": with_txn(
        f"""select transaction_id, label as true_label,
          case when "Amount" > 60 then 'FRAUD' else 'NOT_FRAUD' end as predicted_label,
          printf('%.2f', least(0.99::double, 0.5::double + abs("Amount" - 60) / 200))::double
            as predicted_prob,
          '{fx.LOCAL}' as model_name, 'few_shot' as prompt_variant,
          'amount ' || printf('%.2f', "Amount") as reason, '{fx.STAMP}' as "timestamp"
        from loaded"""
    ),
    "answers_asked": with_txn(
        """select case when even then 'first' else 'second' end as run, count(*) as n from (
          select printf('%.2f', "Amount") as amount, bool_or(transaction_id % 2 = 0) as even
          from loaded group by amount) group by even"""
    ),
    "full_experiment_checked": with_split(
        f""", test as (select label, amount > 60 as guess from parts where split = 'test'),
        runs as (select unnest(['{fx.FOREST}', '{fx.LOGISTIC}', '{RULE_RUN}']) as model_name)
        select model_name, sum(label)::bigint as support, count(*) as n,
          case when model_name = '{RULE_RUN}' then count(*) filter (label = 1 and guess) end as tp,
          case when model_name = '{RULE_RUN}' then count(*) filter (label = 0 and guess) end as fp,
          case when model_name = '{RULE_RUN}' then count(*) filter (label = 1 and not guess) end as fn,
          case when model_name = '{RULE_RUN}' then count(*) filter (label = 0 and not guess) end as tn
        from test, runs group by model_name"""
    ),
    "load_transactions_strict": with_txn(
        """select transaction_id, "Time", "Amount", quality, toxic as label,
          'Time: ' || "Time"::varchar || ' — Amount: $' || "Amount"::varchar as txn_text
        from txn join labels on doc_id = transaction_id
        where quality is not null and toxic is not null and event_type is not null
          and user_id is not null and "Time" is not null and "Amount" is not null"""
    ),
    "row_index": """select row_number() over (order by value, event_id) - 1 as transaction_id,
        event_id, value from events""",
    "row_index_file_order": """select row_number() over (order by event_id) - 1 as transaction_id,
        event_id from events""",
    "log_append": with_log(f"select {STAMPED} from log"),
    "log_append_repeated": with_log(f"select {STAMPED} from log"),
    "log_read": with_log(f"select {STAMPED} from log"),
    "log_read_tolerant": with_log(
        """select transaction_id, true_label, predicted_label, null::double as predicted_prob,
          model_name, prompt_variant, '' as reason, "timestamp" from log"""
    ),
    "corpus_build": "select doc_id::varchar as doc_id, text from documents",
    "profile_load": with_split(
        """select split, count(*) as n, min("Time") as first_time, max("Time") as last_time
        from parts join txn using (transaction_id) group by split"""
    ),
    "label_to_int": with_txn(
        """select transaction_id, label as from_word, trunc("Amount")::int as from_number
        from loaded"""
    ),
    "txn_text": with_txn("select transaction_id, txn_text from loaded"),
    "txn_text_short": with_txn(
        """select transaction_id,
          'Time: ' || "Time"::varchar || ' — Amount: $' || "Amount"::varchar as txn_text
        from txn"""
    ),
    "amount_coerce": """select event_id, case event_type when 'view' then 0.0::double
        when 'signup' then 0.0::double when 'purchase' then -value else value end as amount
        from events""",
    "log_amount": "select o_orderkey, round(ln(1 + o_totalprice), 6) as log_amount from orders",
    "hour": with_txn(
        """select transaction_id, (floor("Time" / 3600)::bigint % 24)::double as hour from txn"""
    ),
    "high_amount_flag": """select o_orderkey, case when o_totalprice >
        (select quantile_cont(o_totalprice, 0.95) from orders) then 1 else 0 end as is_high_amount
        from orders""",
    "features": with_features("select * from features"),
    "model_inputs": with_features(
        "select transaction_id, amount, log_amount, hour, is_high_amount from features"
    ),
    "model_filter": with_log(f"select {STAMPED} from log where model_name = '{fx.LOCAL}'"),
    "log_project": with_txn(
        f"""select transaction_id, label as true_label,
          case when "Amount" / ("Amount" + 50) >= 0.5 then '1' else '0' end as predicted_label,
          round("Amount" / ("Amount" + 50), 6) as predicted_prob,
          'AmountRule' as model_name, '' as prompt_variant, '' as reason,
          '{fx.STAMP}' as "timestamp" from loaded"""
    ),
    "model_run_name": with_txn(
        """select transaction_id,
          'LOCAL_' || upper(event_type) || '_team_' || event_type || '_' || user_id as local_name,
          'LLM_' || event_type || '_team/' || event_type || '/' || user_id as cloud_name
        from txn"""
    ),
    "classify_model": with_txn(
        """select transaction_id,
          case event_type when 'view' then 'Local HF' when 'click' then 'Local HF'
            when 'signup' then 'Cloud LLM' when 'error' then 'Unknown'
            else 'ML Model' end as engine_type,
          case event_type when 'view' then 'LLAMA_' || user_id
            when 'click' then 'local_' || user_id when 'signup' then 'openai_' || user_id
            when 'error' then '  ' else 'Forest' || user_id end as display_label
        from txn"""
    ),
    "score_threshold": with_txn(
        """select transaction_id,
          case when "Amount" / ("Amount" + 50) >= 0.5 then 1 else 0 end as predicted_label
        from txn"""
    ),
    "display_projection": with_log(
        """select transaction_id::varchar as transaction_id, "timestamp", model_name,
          true_label::varchar as true_label, coalesce(predicted_label, '') as predicted_label,
          coalesce(predicted_prob::varchar, '') as predicted_prob, reason from log"""
    ),
    "disagreement_details": f"""with {fx.FIRST_SQL}
        select * from (select * from classes where {PAIR}) d
        left join {_details(fx.FOREST, "true_label,")} a using (transaction_id)
        left join {_details(fx.CLOUD, "")} b using (transaction_id)""",
    "retrieve_topk": f"with {fx.HITS_SQL} select query_id, rank, doc_id, text, distance from hits",
    "retrieve_topk_bucketed": f"""with {fx.HITS_SQL}
        select query_id, rank, doc_id, text, distance from hits""",
    "retrieve_recall": f"""with {fx.HITS_SQL}
        select count(*) as n_hits, true as reached from hits""",
    "attach_labels": with_features(
        """select transaction_id, amount, log_amount, hour, is_high_amount, label as y
        from features"""
    ),
    "attach_responses": f"""with {fx.RESPONSES_SQL}
        select o_orderkey as transaction_id, o_totalprice,
          coalesce(raw, 'ERROR: no response') as response
        from orders left join responses on transaction_id = o_orderkey""",
    "model_presence": with_log(
        f""", {ASKED} select position, model_name,
          model_name in (select model_name from log) as present from asked"""
    ),
    "amount_quantile": """select 0.95::double as share,
        round(quantile_cont(value, 0.95), 6) as quantile from events""",
    "confusion_counts": f"with {fx.METRICS_SQL} select * from counts",
    "model_metrics": f"with {fx.METRICS_SQL} select * from metrics",
    "compare_models": f"""with {fx.METRICS_SQL}, {ASKED}
        select metrics.* from metrics join asked using (model_name) order by position""",
    "selected_metrics": f"""with {fx.METRICS_SQL}, {ASKED}
        select model_name as model, precision, recall, f1, coalesce(support, 0) as support
        from asked left join metrics using (model_name) order by position""",
    "log_stats": with_log(
        "select count(*) as n_rows, count(distinct transaction_id) as n_transactions from log"
    ),
    "model_inventory": with_log(
        """select model_name as raw_name,
          case when starts_with(upper(model_name), 'LOCAL_') then 'Local HF'
            when starts_with(upper(model_name), 'LLM_') then 'Cloud LLM'
            else 'ML Model' end as engine_type,
          case when starts_with(upper(model_name), 'LOCAL_') then replace(model_name, 'LOCAL_', '')
            when starts_with(upper(model_name), 'LLM_') then replace(model_name, 'LLM_', '')
            else model_name end as display_label,
          bool_or(contains(lower(prompt_variant), 'rag'))
            or contains(lower(model_name), 'rag') as rag_used
        from log group by model_name order by 1"""
    ),
    "prediction_pivot": f"with {fx.FIRST_SQL} select * from wide",
    "class_weights": with_txn(
        """select label, count(*) as n,
          round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight
        from loaded group by label"""
    ),
    "scaler_stats": with_features(
        " union all ".join(
            f"""select '{c}' as feature, round(avg({c}), 6) as mean,
            round(stddev_pop({c}), 6) as std from exact"""
            for c in ("amount", "log_amount", "hour", "is_high_amount")
        ).replace(
            "select 'amount'",
            """, exact as (select * replace (ln(1 + amount) as log_amount) from features)
            select 'amount'""",
            1,
        )
    ),
    "class_balance": with_split(
        "select split, label, count(*) as n from parts group by split, label"
    ),
    "disagreements_top": f"""with {fx.FIRST_SQL}
        select * from classes where {PAIR} order by transaction_id limit 20""",
    "log_sample": with_log(
        f"""select {STAMPED} from log
        order by md5('42:' || transaction_id || ':' || model_name || ':' || "timestamp"),
          transaction_id, model_name limit 50"""
    ),
    "models_sorted": with_log("select distinct model_name from log order by model_name"),
    "retrieval_corpus": with_split(
        """select transaction_id::varchar as doc_id, txn_text as text
        from parts where split in ('train', 'val')"""
    ),
    "log_union": with_log(
        f"""select * replace (case when model_name in ('{fx.FOREST}', '{fx.LOGISTIC}')
          then null else reason end as reason) from (select {STAMPED} from log)"""
    ),
    "corpus_replace": """select conv_id::varchar as doc_id, min(text) as text
        from conversations group by conv_id""",
    "disagreements": f"with {fx.FIRST_SQL} select * from classes where {PAIR}",
    "disagreement_count": _pair_counts(),
    "prompt_base": with_txn(f"select transaction_id, {BASE_PROMPT} as prompt from loaded"),
    "prompt_few_shot": with_txn(
        f"""select transaction_id, case when event_type = 'purchase' then {FEW_SHOT_PROMPT}
          else {BASE_PROMPT} end as prompt from loaded"""
    ),
    "prompt_with_context": f"""with {fx.HITS_SQL},
        contexts as (
          select query_id as transaction_id, {text(prompts.CONTEXT_HEAD)}
            || string_agg('Example ' || rank || ': ' || text || chr(10), '' order by rank)
            || chr(10) as context
          from hits group by query_id)
        select transaction_id, coalesce(context, '') || {BASE_PROMPT} as prompt
        from loaded left join contexts using (transaction_id)""",
    "response_parse": f"""with {fx.RESPONSES_SQL},
        everything as (
          select 'r' || transaction_id as key, raw from responses union all
          select 'c' || conv_id || '-' || turn, text from conversations),
        {fx.parse_sql("everything", "key", "raw")}
        select key, parsed_label, parsed_conf, parsed_reason from everything_parsed""",
    "response_errors": f"""with {fx.RESPONSES_SQL},
        texts as (
          select transaction_id, coalesce(raw, 'ERROR: no answer') as response from responses),
        {fx.parse_sql("texts", "transaction_id", "response")}
        select transaction_id, response, predicted_label, predicted_prob, reason
        from texts_normal""",
    "label_normalise": f"""with {fx.RESPONSES_SQL},
        {fx.parse_sql("responses", "transaction_id", "raw")}
        select transaction_id, predicted_label, predicted_prob, reason from responses_normal""",
    "strip_echo": with_txn(
        """select transaction_id, 'LABEL: FRAUD for ' || event_type as answer from txn"""
    ),
    "response_json_text": """with replies as (
          select *, case role
            when 'user' then json_object('generated_text', text)::varchar
            when 'assistant' then json_array(json_object('generated_text', text))::varchar
            else text end as reply
          from conversations)
        select conv_id, turn, coalesce(
          case when json_valid(reply) then json_extract_string(reply, '$.generated_text') end,
          case when json_valid(reply) then json_extract_string(reply, '$[0].generated_text') end,
          reply) as answer
        from replies""",
    "tuning_examples": with_split(
        """select transaction_id, 'Transaction:' || chr(10) || txn_text || chr(10) || chr(10)
          || 'Is this fraud? ' || case when label = 1 then 'FRAUD' else 'NOT_FRAUD' end as text
        from parts where split = 'train'"""
    ),
    "stratified_split": with_split("select transaction_id, label, split from parts"),
    "split_hash": with_txn(
        """, hashed as (
          select transaction_id, label,
            ('0x' || substr(md5('42:' || transaction_id), 1, 8))::bigint / 4294967296.0::double as p
          from loaded)
        select transaction_id, label, case when p < 0.15 then 'test' when p < 0.15 + 0.15 then 'val'
          else 'train' end as split from hashed"""
    ),
    "log_metrics_stream": f"with {fx.METRICS_SQL} select * from metrics",
}
