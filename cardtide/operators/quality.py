"""Warehouse tests as data: each returns the rows, or counts, that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns tested on the decision table and on the marts.
NOT_NULL = {
    "scored_transactions": ["transaction_id", "event_time", "decision"],
    "mart_daily_segment_kpis": [
        "metric_date",
        "merchant_category",
        "fraud_caught_value",
        "fraud_missed_cost",
        "friction_cost",
        "normal_approval_value",
    ],
    "mart_segment_kpis": ["merchant_category", "transaction_count"],
}
UNIQUE = {"scored_transactions": ["transaction_id"], "mart_segment_kpis": ["merchant_category"]}
ACCEPTED = {"scored_transactions": {"decision": ["approve", "verify", "decline"]}}
RECONCILE_TOLERANCE = 0.02


def not_null(table: DataFrame, name: str) -> DataFrame:
    """All not-null tests of a table in one pass."""
    columns = NOT_NULL[name]
    counts = table.agg(*[F.count_if(F.col(column).isNull()).alias(column) for column in columns])
    return counts.unpivot([], columns, "column_name", "failures").select(
        F.lit(name).alias("table_name"), F.lit("not_null").alias("test"), "column_name", "failures"
    )


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; counts are combined before the shuffle."""
    return table.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def unique(table: DataFrame, name: str) -> DataFrame:
    tests = None
    for column in UNIQUE.get(name, []):
        test = (
            duplicates(table.filter(F.col(column).isNotNull()), [column])
            .agg(F.count("*").alias("failures"))
            .select(
                F.lit(name).alias("table_name"), F.lit("unique").alias("test"), F.lit(column).alias("column_name"), "failures"
            )
        )
        tests = test if tests is None else tests.unionByName(test)
    return tests


def accepted_values(table: DataFrame, name: str) -> DataFrame:
    allowed = ACCEPTED[name]
    counts = table.agg(*[F.count_if(~F.col(column).isin(values)).alias(column) for column, values in allowed.items()])
    return counts.unpivot([], list(allowed), "column_name", "failures").select(
        F.lit(name).alias("table_name"), F.lit("accepted_values").alias("test"), "column_name", "failures"
    )


def column_tests(tables: dict[str, DataFrame]) -> DataFrame:
    results = None
    for name, table in tables.items():
        parts = [not_null(table, name)]
        if name in UNIQUE:
            parts.append(unique(table, name))
        if name in ACCEPTED:
            parts.append(accepted_values(table, name))
        for part in parts:
            results = part if results is None else results.unionByName(part)
    return results


def unreconciled(daily: DataFrame, tolerance: float = RECONCILE_TOLERANCE) -> DataFrame:
    """Daily rows whose policy cost differs from missed fraud plus friction.

    Verified rows without a label carry friction but no realized cost, so run it on labelled rows;
    on all rows it reports that gap.
    """
    rebuilt = F.col("fraud_missed_cost") + F.col("friction_cost")
    return daily.select(
        "metric_date", "merchant_category", "policy_cost", rebuilt.alias("reconstructed_policy_cost")
    ).filter(F.abs(F.col("policy_cost") - F.col("reconstructed_policy_cost")) > tolerance)


def duplicate_segments(daily: DataFrame) -> DataFrame:
    return duplicates(daily, ["metric_date", "merchant_category"])
