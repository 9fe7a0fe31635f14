"""The scheduled drift job: compare, record, and record failures too."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardtide.fixed_values import DRIFT_MIN_ROWS, DRIFT_SHARE, FEATURES
from cardtide.operators import drift
from cardtide.operators.ordered import first_rows
from cardtide.session import checkpointed
from cardtide.sources.schemas import DRIFT_REPORT_SCHEMA


def reference_features(training: DataFrame, rows: int | None = None) -> DataFrame:
    """Features of the training rows; with ``rows``, of the earliest of them."""
    if rows is not None:
        training = first_rows(training, rows, "event_time", "transaction_id")
    return training.select(*FEATURES)


def report_row(spark: SparkSession, now: Column, **values) -> DataFrame:
    filled = {
        "reference_rows": 0,
        "current_rows": 0,
        "drifted_features": 0,
        "total_features": len(FEATURES),
        "drift_share": 0.0,
        "current_window_start": None,
        "current_window_end": None,
        **values,
    }
    columns = []
    for part in DRIFT_REPORT_SCHEMA.split(", "):
        name, kind = part.split(" ")
        value = now if name == "generated_at" else F.lit(filled[name])
        columns.append(value.cast(kind).alias(name))
    return spark.range(1, numPartitions=1).select(*columns)


def run_report(
    training: DataFrame,
    decisions: DataFrame,
    reports: str,
    now: Column,
    model_version: str = "unknown",
    simulate_shift: bool = False,
    rows: int | None = None,
    needed: int = DRIFT_MIN_ROWS,
    limit: float = DRIFT_SHARE,
    details_path: str | None = None,
) -> dict:
    """Append one report row to ``reports``. A failure appends a sanitised row and is raised again."""
    spark = decisions.sparkSession

    def record(**values) -> None:
        row = report_row(spark, now, model_version=model_version, drift_threshold=limit, **values)
        row.write.mode("append").parquet(reports)

    try:
        # Written once, because several passes follow.
        current = checkpointed(drift.latest_snapshots(decisions, rows))
        reference = checkpointed(reference_features(training, rows))
        window = drift.snapshot_window(current).first()
        sizes = {"reference_rows": reference.count(), "current_rows": current.count()}
        span = {"current_window_start": window[0], "current_window_end": window[1]}
        if sizes["current_rows"] < needed:
            reason = json.dumps({"reason": f"requires at least {needed} current rows"})
            record(health_status="insufficient_data", details=reason, **sizes, **span)
            return {"status": "insufficient_data", "drifted_features": 0, "drift_share": 0.0, **sizes}
        sample = drift.shifted(current) if simulate_shift else current
        features = checkpointed(drift.drift_features(reference, sample))
        if details_path:
            features.coalesce(1).write.mode("overwrite").json(details_path)
        summary = drift.drift_summary(features, limit).first()
        result = {
            "drifted_features": summary["drifted_features"],
            "total_features": summary["total_features"],
            "drift_share": summary["drift_share"],
        }
        details = json.dumps({"simulated_shift": simulate_shift, "features": FEATURES})
        record(health_status=summary["health_status"], details=details, **sizes, **span, **result)
        return {"status": summary["health_status"], **result, **sizes}
    except Exception as error:
        message = {
            "error_type": type(error).__name__,
            "message": "drift report failed; see the job's log",
            "simulated_shift": simulate_shift,
        }
        record(health_status="error", details=json.dumps(message))
        raise
