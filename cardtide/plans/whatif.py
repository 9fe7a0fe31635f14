"""Row scans behind the what-if and review screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardtide.operators.ordered import first_rows


def simulation_rows(
    decisions: DataFrame, start: str, end: str, category: str, limit: int | None = None
) -> DataFrame:
    """Labelled rows of one category inside a date range; with ``limit``, the newest of them.

    The range is a half-open comparison on ``event_time``, so it reaches the scan.
    """
    first = F.lit(start).cast("timestamp")
    after = F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    rows = decisions.filter(
        (F.col("event_time") >= first)
        & (F.col("event_time") < after)
        & (F.col("merchant_category") == category)
        & F.col("fraud_label").isNotNull()
    ).select(
        "transaction_id",
        "event_time",
        F.col("amount").cast("double").alias("amount"),
        F.col("order_margin_pct").cast("double").alias("order_margin_pct"),
        "customer_ltv_band",
        "fraud_label",
        F.col("fraud_probability").cast("double").alias("fraud_probability"),
        F.col("realized_policy_cost").cast("double").alias("current_policy_cost"),
    )
    if limit is not None:
        rows = first_rows(rows, limit, "event_time", "transaction_id", newest=True)
    return rows.drop("event_time")


def recent_transactions(decisions: DataFrame, category: str, limit: int) -> DataFrame:
    """Newest decisions of one category."""
    return first_rows(
        decisions.filter(F.col("merchant_category") == category), limit, "event_time", "transaction_id", newest=True
    )
