"""Fixed column sets and types of the domain tables."""

from pyspark.sql import types as T

FEATURE_COLUMNS = [
    "transaction_id",
    "amount",
    "log_amount",
    "hour",
    "is_high_amount",
    "label",
    "txn_text",
]

MODEL_INPUTS = ["amount", "log_amount", "hour", "is_high_amount"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("predicted_prob", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_variant", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# Reading order of the log sample report.
LOG_DISPLAY_ORDER = [
    "transaction_id",
    "timestamp",
    "model_name",
    "prompt_variant",
    "true_label",
    "predicted_label",
    "predicted_prob",
    "reason",
]
