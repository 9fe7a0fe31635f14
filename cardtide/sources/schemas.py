"""Table and message schemas. Nothing is inferred. Column names, types, precisions and scales are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = [
    "trans_num",
    "trans_date_trans_time",
    "cc_num",
    "merchant",
    "category",
    "amt",
    "lat",
    "long",
    "merch_lat",
    "merch_long",
    "city_pop",
    "dob",
    "is_fraud",
]
TRAINING_COLUMNS = [name for name in RAW_COLUMNS if name != "merchant"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("customer_lat", T.DoubleType()),
        T.StructField("customer_long", T.DoubleType()),
        T.StructField("merchant_lat", T.DoubleType()),
        T.StructField("merchant_long", T.DoubleType()),
        T.StructField("city_population", T.LongType()),
        T.StructField("customer_age", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("order_margin_pct", T.DoubleType()),
        T.StructField("customer_ltv_band", T.StringType()),
        T.StructField("fraud_label", T.BooleanType()),
    ]
)
EVENT_FIELDS = EVENT_SCHEMA.fieldNames()

CONTRIBUTIONS_TYPE = "array<struct<feature:string,value:string,contribution:double>>"
SNAPSHOT_TYPE = (
    "struct<amount:double,log_amount:double,distance_km:double,transaction_hour:int,"
    "transaction_day_of_week:int,customer_age:int,city_population:bigint,is_night:int,"
    "order_margin_pct:double,merchant_category:string,channel:string,customer_ltv_band:string>"
)

# Decimal columns of the decision table: precision and scale.
SCORED_DECIMALS = {
    "amount": (14, 2),
    "order_margin_pct": (6, 4),
    "fraud_probability": (10, 8),
    "verify_threshold": (10, 8),
    "decline_threshold": (10, 8),
    "expected_cost_approve": (14, 4),
    "expected_cost_verify": (14, 4),
    "expected_cost_decline": (14, 4),
    "realized_policy_cost": (14, 4),
    "baseline_cost": (14, 4),
    "estimated_savings": (14, 4),
}

# One row per transaction. The four explanation_* text columns live in their own table
# (see operators.explanations) and are joined on read.
SCORED_COLUMNS = [
    "transaction_id",
    "event_time",
    "processed_at",
    "customer_id",
    "merchant",
    "merchant_category",
    "channel",
    "amount",
    "order_margin_pct",
    "customer_ltv_band",
    "fraud_label",
    "fraud_probability",
    "decision",
    "verify_threshold",
    "decline_threshold",
    "expected_cost_approve",
    "expected_cost_verify",
    "expected_cost_decline",
    "realized_policy_cost",
    "baseline_cost",
    "estimated_savings",
    "model_version",
    "explanation",
    "feature_snapshot",
]

_plain_scored_types = {
    "event_time": "timestamp",
    "processed_at": "timestamp",
    "fraud_label": "boolean",
    "explanation": CONTRIBUTIONS_TYPE,
    "feature_snapshot": SNAPSHOT_TYPE,
}
SCORED_SCHEMA = ", ".join(
    f"{name} decimal({SCORED_DECIMALS[name][0]},{SCORED_DECIMALS[name][1]})"
    if name in SCORED_DECIMALS
    else f"{name} {_plain_scored_types.get(name, 'string')}"
    for name in SCORED_COLUMNS
)

SAFE_PAYLOAD_TYPE = (
    "struct<payload_sha256:string,payload_bytes:int,safe_fields:string>"
)
REJECTED_SCHEMA = (
    "rejected_at timestamp, source_topic string, error_type string, error_message string, "
    f"transaction_id string, payload {SAFE_PAYLOAD_TYPE}"
)
METRICS_SCHEMA = "metric_time timestamp, metric_name string, metric_value double, labels string"
OUTBOX_SCHEMA = (
    "dedupe_key string, created_at timestamp, available_at timestamp, topic string, "
    "message_key string, payload string, published_at timestamp"
)
DRIFT_REPORT_SCHEMA = (
    "generated_at timestamp, model_version string, reference_rows bigint, current_rows bigint, "
    "drifted_features int, total_features int, drift_share double, drift_threshold double, "
    "health_status string, current_window_start timestamp, current_window_end timestamp, "
    "details string"
)
EXPLANATION_SCHEMA = (
    "transaction_id string, model_version string, explanation_text string, "
    "explanation_source string, explanation_model string, explanation_generated_at timestamp"
)
