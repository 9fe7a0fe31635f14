"""Staging view, KPI marts and the figures that dashboards read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.functions import costs

STAGED_DOUBLES = [
    "amount",
    "order_margin_pct",
    "fraud_probability",
    "verify_threshold",
    "decline_threshold",
    "realized_policy_cost",
    "baseline_cost",
    "estimated_savings",
]
COUNT_MEASURES = [
    "transaction_count",
    "fraud_transaction_count",
    "fraud_intervened_count",
    "false_decline_count",
    "legitimate_verified_count",
    "approved_count",
    "verified_count",
    "declined_count",
]
DOLLAR_MEASURES = [
    "gross_fraud_exposure",
    "policy_cost",
    "baseline_cost",
    "estimated_savings",
    "fraud_caught_value",
    "fraud_missed_cost",
    "friction_cost",
    "normal_approval_value",
]
SEGMENT_MEASURES = [
    "transaction_count",
    "fraud_transaction_count",
    "fraud_intervened_count",
    "false_decline_count",
    "policy_cost",
    "baseline_cost",
    "estimated_savings",
]


def _flag(condition: str) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.expr(f"if({condition}, 1, 0)")


def staged(decisions: DataFrame) -> DataFrame:
    """Decision table with doubles, the transaction date, outcome flags and outcome dollars."""
    typed = decisions.withColumns({name: F.col(name).cast("double") for name in STAGED_DOUBLES}).withColumn(
        "transaction_date", F.to_date("event_time")
    )
    return typed.withColumn("_friction", costs.friction()).withColumns(
        {
            "fraud_intervened": _flag("fraud_label AND decision IN ('verify', 'decline')"),
            "false_decline": _flag("NOT fraud_label AND decision = 'decline'"),
            "legitimate_verified": _flag("NOT fraud_label AND decision = 'verify'"),
            **costs.outcome_dollars("decision", "fraud_label", "amount", "_friction"),
        }
    ).drop("_friction")


def daily_segment_kpis(stage: DataFrame) -> DataFrame:
    """One row per transaction date and category; one shuffle of partial sums."""

    def total(value: Column, name: str) -> Column:
        return F.sum(value).alias(name)

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return stage.groupBy(F.col("transaction_date").alias("metric_date"), "merchant_category").agg(
        F.count("*").alias("transaction_count"),
        total(F.col("fraud_label").cast("int"), "fraud_transaction_count"),
        total(F.col("fraud_intervened"), "fraud_intervened_count"),
        total(F.col("false_decline"), "false_decline_count"),
        total(F.col("legitimate_verified"), "legitimate_verified_count"),
        total((F.col("decision") == "approve").cast("int"), "approved_count"),
        total((F.col("decision") == "verify").cast("int"), "verified_count"),
        total((F.col("decision") == "decline").cast("int"), "declined_count"),
        total(F.when(F.col("fraud_label"), F.col("amount")).otherwise(0.0), "gross_fraud_exposure"),
        total(known("realized_policy_cost"), "policy_cost"),
        total(known("baseline_cost"), "baseline_cost"),
        total(known("estimated_savings"), "estimated_savings"),
        *[
            total(F.col(name), name)
            for name in ("fraud_caught_value", "fraud_missed_cost", "friction_cost", "normal_approval_value")
        ],
        F.avg("fraud_probability").alias("average_fraud_probability"),
        F.max("processed_at").alias("source_freshness"),
    )


def segment_kpis(daily: DataFrame) -> DataFrame:
    """Category totals re-aggregated from the daily mart; rates are NULL without a denominator."""
    fraud, total = F.sum("fraud_transaction_count"), F.sum(F.col("transaction_count") - F.col("fraud_transaction_count"))
    return daily.groupBy("merchant_category").agg(
        *[F.sum(name).alias(name) for name in COUNT_MEASURES + DOLLAR_MEASURES],
        F.try_divide(F.sum("fraud_intervened_count").cast("double"), F.nullif(fraud, F.lit(0))).alias(
            "fraud_intervention_rate"
        ),
        F.try_divide(F.sum("false_decline_count").cast("double"), F.nullif(total, F.lit(0))).alias(
            "false_decline_rate"
        ),
        F.max("source_freshness").alias("source_freshness"),
    )


def available_window(daily: DataFrame, default_days: int = 30) -> DataFrame:
    """First and last date, freshness, and the default analysis window inside them."""
    window = daily.agg(
        F.min("metric_date").alias("min_date"),
        F.max("metric_date").alias("max_date"),
        F.max("source_freshness").alias("freshness"),
    )
    start = F.greatest("min_date", F.date_sub("max_date", default_days - 1))
    empty = F.raise_error(F.lit("No scored transactions are available yet")).cast("date")
    return window.withColumns(
        {
            "min_date": F.when(F.col("min_date").isNull(), empty).otherwise(F.col("min_date")),
            "default_start": start,
        }
    )


def _at_least_one(value: Column) -> Column:
    return F.greatest(value, F.lit(1))


def dashboard_totals(daily: DataFrame) -> DataFrame:
    """Grand totals and rates whose denominators are at least 1."""
    totals = daily.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNT_MEASURES + DOLLAR_MEASURES],
        F.sum("average_fraud_probability").alias("average_fraud_probability"),
    )
    fraud, rows = F.col("fraud_transaction_count"), F.col("transaction_count")
    return totals.withColumns(
        {
            "fraud_rate": fraud / _at_least_one(rows),
            "intervention_rate": F.col("fraud_intervened_count") / _at_least_one(fraud),
            "false_decline_rate": F.col("false_decline_count") / _at_least_one(rows - fraud),
        }
    )


def daily_totals(daily: DataFrame) -> DataFrame:
    measures = ["policy_cost", "baseline_cost", "approved_count", "verified_count", "declined_count"]
    return daily.groupBy("metric_date").agg(*[F.sum(name).alias(name) for name in measures])


def daily_costs_long(totals: DataFrame) -> DataFrame:
    return totals.unpivot("metric_date", ["policy_cost", "baseline_cost"], "cost_type", "cost")


def daily_decisions_long(totals: DataFrame) -> DataFrame:
    return totals.unpivot(
        "metric_date", ["approved_count", "verified_count", "declined_count"], "decision", "transactions"
    )


def segment_performance(daily: DataFrame, best_first: bool = True) -> DataFrame:
    """Category totals with clamped rates, ranked by savings."""
    totals = daily.groupBy("merchant_category").agg(*[F.sum(name).alias(name) for name in SEGMENT_MEASURES])
    fraud, rows = F.col("fraud_transaction_count"), F.col("transaction_count")
    order = F.col("estimated_savings").desc() if best_first else F.col("estimated_savings").asc()
    return totals.withColumns(
        {
            "fraud_intervention_rate": F.col("fraud_intervened_count") / _at_least_one(fraud),
            "false_decline_rate": F.col("false_decline_count") / _at_least_one(rows - fraud),
        }
    ).orderBy(order, "merchant_category")


def categories(daily: DataFrame) -> DataFrame:
    return daily.select("merchant_category").distinct().orderBy("merchant_category")


def publish_marts(decisions: DataFrame, daily_table: str, segment_table: str) -> None:
    """Staging stays a view; both marts become tables, the second from the first."""
    spark = decisions.sparkSession
    stage = staged(decisions)
    stage.createOrReplaceTempView("staged_transactions")
    daily_segment_kpis(stage).write.mode("overwrite").saveAsTable(daily_table)
    segment_kpis(spark.table(daily_table)).write.mode("overwrite").saveAsTable(segment_table)
