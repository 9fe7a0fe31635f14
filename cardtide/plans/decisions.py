"""Card rows to events, scores, decisions and the decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.fixed_values import (
    CATEGORICAL_FEATURES,
    DEFAULT_DECLINE,
    DEFAULT_VERIFY,
    FEATURES,
    HEURISTIC_VERSION,
)
from cardtide.functions import costs, features, scoring
from cardtide.sources.schemas import (
    CONTRIBUTIONS_TYPE,
    EVENT_FIELDS,
    SCORED_COLUMNS,
    SCORED_DECIMALS,
    SNAPSHOT_TYPE,
)


def card_rows_to_events(rows: DataFrame, salt: str) -> DataFrame:
    """Pseudonymise and enrich. An allow-list: card number, names and birth date end here."""
    at, category = F.col("trans_date_trans_time"), F.col("category")
    return rows.withColumn("_person", features.pseudonym(F.col("cc_num"), salt)).select(
        F.col("trans_num").alias("transaction_id"),
        at.alias("event_time"),
        F.col("_person").alias("customer_id"),
        features.merchant_name(F.col("merchant")).alias("merchant"),
        category.alias("merchant_category"),
        F.col("amt").cast("double").alias("amount"),
        F.col("lat").cast("double").alias("customer_lat"),
        F.col("long").cast("double").alias("customer_long"),
        F.col("merch_lat").cast("double").alias("merchant_lat"),
        F.col("merch_long").cast("double").alias("merchant_long"),
        F.col("city_pop").cast("long").alias("city_population"),
        features.age_in_years("dob", "trans_date_trans_time").alias("customer_age"),
        features.channel(category).alias("channel"),
        features.margin("category").alias("order_margin_pct"),
        features.ltv_band(F.col("_person")).alias("customer_ltv_band"),
        F.col("is_fraud").cast("int").cast("boolean").alias("fraud_label"),
    )


def with_model_features(events: DataFrame) -> DataFrame:
    return events.withColumns(features.model_feature_columns())


def training_frame(rows: DataFrame, salt: str) -> DataFrame:
    """Features and label for training. Rows outside the event contract stay in."""
    prepared = rows if "merchant" in rows.columns else rows.withColumn("merchant", F.lit(None).cast("string"))
    return (
        with_model_features(card_rows_to_events(prepared, salt))
        .withColumn("is_fraud", F.col("fraud_label").cast("int"))
        .select("transaction_id", "event_time", *FEATURES, "is_fraud")
    )


def with_heuristic_score(featured: DataFrame) -> DataFrame:
    return featured.withColumns(
        {
            "fraud_probability": scoring.heuristic_probability(),
            "explanation": scoring.heuristic_contributions(),
            "model_version": F.lit(HEURISTIC_VERSION),
        }
    )


def with_thresholds(
    scored: DataFrame,
    thresholds: DataFrame | None = None,
    verify: float = DEFAULT_VERIFY,
    decline: float = DEFAULT_DECLINE,
) -> DataFrame:
    """Per-category thresholds where the table has them, else the global pair.

    ``thresholds`` has one row per merchant category (14 at most, checked by the event contract),
    which is why it may be broadcast.
    """
    if thresholds is None:
        return scored.withColumns({"verify_threshold": F.lit(verify), "decline_threshold": F.lit(decline)})
    table = thresholds.select(
        "merchant_category", F.col("verify").alias("_verify"), F.col("decline").alias("_decline")
    )
    return (
        scored.join(F.broadcast(table), "merchant_category", "left")
        .withColumns(
            {
                "verify_threshold": F.coalesce("_verify", F.lit(verify)),
                "decline_threshold": F.coalesce("_decline", F.lit(decline)),
            }
        )
        .drop("_verify", "_decline")
    )


def with_decisions(
    scored: DataFrame, verify: float = DEFAULT_VERIFY, decline: float = DEFAULT_DECLINE
) -> DataFrame:
    """Decision, expected, realized and baseline dollars.

    The baseline is the realized cost under the *global* thresholds ``verify`` / ``decline``; it is
    not the approve-everything baseline of ``operators.evaluation``.
    """
    base = scored.withColumns(
        {
            "decision": costs.decide("fraud_probability", "verify_threshold", "decline_threshold"),
            "_friction": costs.friction(),
            "_base_action": costs.decide("fraud_probability", f"{verify!r}D", f"{decline!r}D"),
        }
    )
    money = ("fraud_label", "amount", "_friction")
    expected = costs.expected_costs("fraud_probability", "amount", "_friction")
    return (
        base.withColumns(
            {
                **{f"expected_cost_{action}": cost for action, cost in expected.items()},
                "realized_policy_cost": costs.realized_cost("decision", *money),
                "baseline_cost": costs.realized_cost("_base_action", *money),
            }
        )
        .withColumn("estimated_savings", F.col("baseline_cost") - F.col("realized_policy_cost"))
        .drop("_friction", "_base_action")
    )


def heuristic_decisions(events: DataFrame) -> DataFrame:
    return with_decisions(with_thresholds(with_heuristic_score(with_model_features(events))))


SCORE_FIELDS = [
    "transaction_id", "fraud_probability", "decision", "verify_threshold", "decline_threshold",
    "expected_cost_approve", "expected_cost_verify", "expected_cost_decline", "model_version",
]


def score_is_good(model_version: str | None = None) -> Column:
    """Whether a row keeps the score contract: all fields there, finite and in range, the named model's."""
    number = {name: F.col(name).cast("double") for name in SCORE_FIELDS if name not in ("transaction_id", "decision", "model_version")}
    good = F.col("decision").isin("approve", "verify", "decline")
    for name in SCORE_FIELDS:
        good = good & F.col(name).isNotNull()
    for name, value in number.items():
        # NaN is above every number in Spark.
        good = good & ((value <= 1) & (value >= 0) if not name.startswith("expected") else (value < float("inf")) & (value > float("-inf")))
    if model_version is not None:
        good = good & (F.col("model_version") == model_version)
    return F.coalesce(good, F.lit(False))


def score_contract_breaks(scored: DataFrame, model_version: str | None = None) -> DataFrame:
    """Rows a scorer must never emit."""
    return scored.filter(~score_is_good(model_version))


def enforce_score_contract(scored: DataFrame, model_version: str | None = None) -> DataFrame:
    """Fail the job, rather than write, when a score leaves its contract."""
    message = F.concat(F.lit("invalid score for "), F.coalesce("transaction_id", F.lit("a row without id")))
    return scored.withColumn(
        "fraud_probability",
        F.when(score_is_good(model_version), F.col("fraud_probability")).otherwise(F.raise_error(message).cast("double")),
    )


def snapshot_column() -> Column:
    return F.struct(*[F.col(name).cast("string") if name in CATEGORICAL_FEATURES else F.col(name) for name in FEATURES])


def to_decision_table(scored: DataFrame, processed_at: Column, keep: list[str] | None = None) -> DataFrame:
    """Stored form: decimals of fixed scale, drivers and feature snapshot as nested columns."""
    row = scored.withColumns(
        {
            "processed_at": processed_at.cast("timestamp"),
            "explanation": F.col("explanation").cast(CONTRIBUTIONS_TYPE),
            "feature_snapshot": snapshot_column().cast(SNAPSHOT_TYPE),
        }
    )
    stored = {
        name: F.col(name).cast(f"decimal({p},{s})")
        if name in ("fraud_probability", "verify_threshold", "decline_threshold")
        else costs.to_numeric(F.col(name), p, s)
        for name, (p, s) in SCORED_DECIMALS.items()
    }
    return row.select(
        *[stored[name].alias(name) if name in stored else F.col(name) for name in SCORED_COLUMNS], *(keep or [])
    )


def outbound_payload(scored: DataFrame) -> Column:
    """Message body: the event's fields, then the score's fields, as compact JSON."""
    event_fields = [name for name in EVENT_FIELDS if name in scored.columns]
    score_fields = [
        name
        for name in SCORED_COLUMNS
        if name in scored.columns and name not in EVENT_FIELDS and name not in ("processed_at", "feature_snapshot")
    ]
    snapshot = snapshot_column().cast(SNAPSHOT_TYPE).alias("feature_snapshot")
    return F.to_json(F.struct(*event_fields, *score_fields, snapshot), {"ignoreNullFields": "false"})
