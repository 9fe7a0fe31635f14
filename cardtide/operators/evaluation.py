"""Chronological windows, probability metrics and policy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.functions import costs
from cardtide.functions.scoring import clamp
from cardtide.operators.ordered import running_totals, time_order_cuts

WINDOWS = ["train", "calibration", "threshold_validation"]


def with_windows(
    rows: DataFrame, train: float = 0.70, calibration: float = 0.15, identifier: str = "transaction_id"
) -> DataFrame:
    """Label rows by position in time: first 70 %, next 15 %, the rest. Row counts are truncated.

    Rows without a time are left out: they belong to no window.
    """
    rows = rows.filter(F.col("event_time").isNotNull())

    def ends(total: int) -> list[int]:
        return [int(total * train), int(total * train) + int(total * calibration)]

    before_train, before_calibration = time_order_cuts(rows, "event_time", identifier, ends)
    return rows.withColumn(
        "window",
        F.when(before_train, WINDOWS[0]).when(before_calibration, WINDOWS[1]).otherwise(WINDOWS[2]),
    )


def window_metadata(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy("window").agg(
        F.count("*").alias("row_count"),
        F.sum(F.col("is_fraud").cast("bigint")).alias("fraud_rows"),
        F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"),
        F.min("event_time").alias("event_time_start"),
        F.max("event_time").alias("event_time_end"),
    )


def require_both_classes(metadata: DataFrame, names: list[str] = WINDOWS) -> None:
    """Every window needs fraud and legitimate rows. ``metadata`` has one row per window."""
    found = {row["window"]: row for row in metadata.collect()}
    for name in names:
        row = found.get(name)
        if row is None or not 0 < (row["fraud_rows"] or 0) < row["row_count"]:
            raise ValueError(f"{name} window must contain fraud and legitimate examples")


def score_counts(scored: DataFrame, label: str = "fraud_label", probability: str = "fraud_probability") -> DataFrame:
    """Positives and negatives per distinct score, so that a score shared by many rows is one row."""
    fraud = F.col(label).cast("int")
    return (
        scored.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
        .groupBy(clamp(F.col(probability).cast("double"), 1e-7, 1 - 1e-7).alias("score"))
        .agg(F.sum(fraud).alias("positives"), F.sum(1 - fraud).alias("negatives"))
    )


def ranked_scores(counts: DataFrame) -> DataFrame:
    """Scores from high to low with the positives and negatives strictly above each."""
    return running_totals(counts, "score", ["positives", "negatives"], descending=True)


def brier_and_log_loss(scored: DataFrame, label: str = "fraud_label", probability: str = "fraud_probability") -> DataFrame:
    """Both averages in one aggregation; they need no order."""
    known = F.col(label).isNotNull() & F.col(probability).isNotNull()
    fraud, score = F.col(label).cast("int"), clamp(F.col(probability).cast("double"), 1e-7, 1 - 1e-7)
    return scored.filter(known).agg(
        F.avg((fraud - score) * (fraud - score)).alias("brier_score"),
        F.avg(-(fraud * F.log(score) + (1 - fraud) * F.log(1 - score))).alias("log_loss"),
    )


def probability_metrics(scored: DataFrame, label: str = "fraud_label", probability: str = "fraud_probability") -> DataFrame:
    """ROC AUC, average precision, Brier score, log loss and best-F1 threshold as one row."""
    ranked = ranked_scores(score_counts(scored, label, probability))
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    above_pos, above_neg = F.col("positives_before"), F.col("negatives_before")
    at_or_above_pos = (above_pos + F.col("positives")).cast("double")
    at_or_above = at_or_above_pos + above_neg + F.col("negatives")
    score = F.col("score")
    summed = ranked.agg(
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        # A pair of equal scores counts one half.
        F.sum(neg * (above_pos + pos / 2)).alias("_ordered_pairs"),
        F.sum(pos * at_or_above_pos / at_or_above).alias("_precision_steps"),
        F.sum(pos * (1 - score) * (1 - score) + neg * score * score).alias("_squared"),
        F.sum(-(pos * F.log(score) + neg * F.log(1 - score))).alias("_log"),
    )
    rows = F.col("_p") + F.col("_n")
    metrics = summed.select(
        F.try_divide(F.col("_ordered_pairs"), F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_precision_steps"), F.col("_p")).alias("average_precision"),
        F.try_divide(F.col("_squared"), rows).alias("brier_score"),
        F.try_divide(F.col("_log"), rows).alias("log_loss"),
        "_p",
    )
    # F1 at a threshold is 2TP / (predicted + positives); the ranking needs the total positives.
    total = F.coalesce(metrics.select("_p").scalar(), F.lit(0.0))
    precision, recall = at_or_above_pos / at_or_above, F.try_divide(at_or_above_pos, total)
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    best = ranked.withColumn("_f1", f1).agg(
        F.coalesce(F.max_by("score", F.struct(F.col("_f1"), -score)), F.lit(0.5)).alias("threshold")
    )
    return metrics.withColumn("best_f1_threshold", best.scalar()).drop("_p")


def policy_metrics(decided: DataFrame) -> DataFrame:
    """What a policy costs against approving everything. Input: labelled rows with a decision.

    The baseline is the plain sum of fraud amounts, not the global-threshold ``baseline_cost``.
    """
    fraud, decision = F.col("fraud_label"), F.col("decision")
    cost = costs.realized_cost("decision", "fraud_label", "amount", "_friction")
    intervened = (decision != "approve").cast("double")

    def money(value: Column) -> Column:
        return F.sum(value.cast("decimal(38,6)")).cast("double")

    return (
        decided.filter(fraud.isNotNull())
        .withColumn("_friction", costs.friction())
        .agg(
            money(cost).alias("policy_cost"),
            money(F.when(fraud, F.col("amount")).otherwise(0.0)).alias("approve_all_baseline_cost"),
            F.avg(F.when(fraud, intervened)).alias("fraud_intervention_rate"),
            F.avg(F.when(~fraud, intervened)).alias("false_intervention_rate"),
            F.count_if(decision == "approve").alias("approve_count"),
            F.count_if(decision == "verify").alias("verify_count"),
            F.count_if(decision == "decline").alias("decline_count"),
        )
        .withColumn(
            "estimated_savings_vs_approve_all", F.col("approve_all_baseline_cost") - F.col("policy_cost")
        )
    )


def positive_class_weight(train: DataFrame) -> DataFrame:
    return train.agg(
        (F.sum(1 - F.col("is_fraud")) / F.sum("is_fraud")).cast("double").alias("positive_weight")
    )
