"""Pipeline metrics over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cardtide.operators import operations

LATENESS = "1 minute"


def volume(metrics: DataFrame, name: str = "transactions_scored", width: str = "10 seconds") -> DataFrame:
    return operations.metric_sums(metrics.withWatermark("metric_time", LATENESS), name, width)


def failure_rate(metrics: DataFrame, width: str = "1 minute") -> DataFrame:
    return operations.failure_rate(metrics.withWatermark("metric_time", LATENESS), width)
