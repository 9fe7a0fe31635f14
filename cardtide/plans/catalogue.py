"""Named queries over a folder of Parquet tables. Each reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cardtide.fixed_values import FEATURES
from cardtide.operators import (
    contract,
    decision_log,
    drift,
    evaluation,
    explanations,
    marts,
    operations,
    quality,
    thresholds,
)
from cardtide.plans import boosting, contributions, decisions, training, whatif
from cardtide.session import checkpointed
from cardtide.sources.tables import dealt, events_as_card_rows, read_table, training_rows

SALT = "salt"
# "Now" is a parameter everywhere; the provided events lie in January 2024.
NOW = "2024-02-01 00:00:00"


def presented(frame: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """Comparable output: doubles to 6 places, times and dates as text, integers as bigint.

    ``places`` names columns whose values lie half-way between two 6-digit numbers.
    """
    columns = []
    for field in frame.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            # Adding zero turns -0.0 into 0.0.
            value = F.round(value.cast("double"), (places or {}).get(field.name, 6)) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            value = value.cast("bigint")
        columns.append(value.alias(field.name))
    return frame.select(*columns)


def card_rows(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_card_rows(read_table(spark, folder, "events"))


def dealt_card_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same card rows on all cores, for queries with long work on each row. A single file may have a single split."""
    return events_as_card_rows(dealt(read_table(spark, folder, "events")))


def all_events(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.card_rows_to_events(card_rows(spark, folder), SALT)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that satisfy the contract."""
    return contract.valid_events(all_events(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.heuristic_decisions(events(spark, folder))


def decision_table(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.to_decision_table(scored(spark, folder), F.col("event_time"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    return marts.staged(decision_table(spark, folder))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return marts.daily_segment_kpis(staged(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows whose label is known, as training and what-if read them."""
    return staged(spark, folder).filter("fraud_label IS NOT NULL")


def windowed(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder).withColumn("is_fraud", F.col("fraud_label").cast("int"))
    return evaluation.with_windows(rows)


def messages(spark: SparkSession, folder: str, keep: list[str] | None = None) -> DataFrame:
    """Every event as a JSON message with its position, as a message topic would deliver it."""
    body = F.struct(
        *[
            F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name) if name == "event_time" else F.col(name)
            for name in decisions.EVENT_FIELDS
        ]
    )
    return decisions.card_rows_to_events(dealt_card_rows(spark, folder), SALT).select(
        F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
        F.lit("txns.raw").alias("topic"),
        F.lit(0).alias("partition"),
        F.substring("transaction_id", 5, 20).cast("bigint").alias("offset"),
        "event_time",
        *(keep or []),
    )


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return contract.parse_messages(messages(spark, folder).withColumnRenamed("event_time", "arrived_at"))


def pipeline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rejected = contract.rejected_events(all_events(spark, folder)).withColumn("error_type", F.lit("ValidationError"))
    return operations.scored_metrics(scored(spark, folder), F.col("event_time")).unionByName(
        operations.rejected_metrics(rejected, F.col("event_time"))
    )


def delivery_log(spark: SparkSession, folder: str) -> DataFrame:
    """Decision rows as delivered: everything once, remote purchases again with a corrected amount,
    then remote purchases and high-value customers a third time, the latter under a new model."""
    remote, valued = F.col("channel") == "card_not_present", F.col("customer_ltv_band") == "high"
    batches = F.array_compact(F.array(F.lit(0), F.when(remote, 1), F.when(remote | valued, 2)))
    batches = batches.cast("array<bigint>")
    renewed = (F.col("batch_id") == 2) & valued
    return (
        decision_table(spark, folder)
        .withColumn("batch_id", F.explode(batches))
        .withColumns(
            {
                "partition": F.lit(0),
                "offset": F.substring("transaction_id", 5, 20).cast("bigint"),
                "amount": (F.col("amount") + F.col("batch_id")).cast("decimal(14,2)"),
                "model_version": F.when(renewed, "heuristic-v1").otherwise(F.col("model_version")),
            }
        )
    )


# ------------------------------------------------------------------- queries


def txn_features(spark, folder):
    rows = decisions.with_model_features(all_events(spark, folder))
    return presented(
        rows.select(
            "transaction_id", "customer_id", "merchant", "channel", "customer_ltv_band", "event_time",
            *[name for name in FEATURES if name not in ("channel", "customer_ltv_band")],
        )
    )


def txn_valid(spark, folder):
    return presented(
        events(spark, folder).select(
            "transaction_id", "merchant_category", "amount", "customer_age", "city_population", "fraud_label"
        )
    )


def txn_rejected_counts(spark, folder):
    return presented(contract.rejected_counts(contract.rejected_events(all_events(spark, folder))))


def dead_letters(spark, folder):
    letters = contract.dead_letters(parsed(spark, folder), F.lit(NOW))
    return presented(
        letters.select(
            "transaction_id", "source_topic", "error_type", "error_message",
            F.col("payload.payload_sha256").alias("payload_sha256"),
            F.col("payload.payload_bytes").alias("payload_bytes"),
            F.col("payload.safe_fields").alias("safe_fields"),
        )
    )


def scored_heuristic(spark, folder):
    rows = scored(spark, folder)
    return presented(
        rows.select(
            "transaction_id", "fraud_probability", "decision", "verify_threshold", "decline_threshold",
            "realized_policy_cost", "baseline_cost", "estimated_savings", "model_version",
            *[F.col("explanation")[i]["contribution"].alias(f"contribution_{i + 1}") for i in range(3)],
            F.col("explanation")[2]["value"].alias("night_value"),
        )
    )


def expected_costs(spark, folder):
    return presented(
        scored(spark, folder).select(
            "transaction_id", "expected_cost_approve", "expected_cost_verify", "expected_cost_decline"
        )
    )


def staged_transactions(spark, folder):
    return presented(
        staged(spark, folder).select(
            "transaction_id", "transaction_date", "amount", "realized_policy_cost", "fraud_intervened",
            "false_decline", "legitimate_verified", "fraud_caught_value", "fraud_missed_cost", "friction_cost",
            "normal_approval_value",
        )
    )


def mart_daily_segment(spark, folder):
    return presented(daily(spark, folder))


def mart_segment(spark, folder):
    return presented(marts.segment_kpis(daily(spark, folder)))


def available_window(spark, folder):
    return presented(marts.available_window(daily(spark, folder)))


def dashboard_totals(spark, folder):
    return presented(marts.dashboard_totals(daily(spark, folder)))


def daily_kpis_default_window(spark, folder):
    table = daily(spark, folder)
    window = marts.available_window(table)
    start, end = window.select("default_start").scalar(), window.select("max_date").scalar()
    chosen = table.filter(F.col("metric_date").between(start, end))
    return presented(
        chosen.select("metric_date", "merchant_category", "transaction_count", "policy_cost").orderBy(
            "metric_date", "merchant_category"
        )
    )


def daily_costs_long(spark, folder):
    return presented(marts.daily_costs_long(marts.daily_totals(daily(spark, folder))))


def daily_decisions_long(spark, folder):
    return presented(marts.daily_decisions_long(marts.daily_totals(daily(spark, folder))))


def segment_performance(spark, folder):
    return presented(marts.segment_performance(daily(spark, folder)))


def merchant_categories(spark, folder):
    return marts.categories(daily(spark, folder))


def whatif_threshold(spark, folder):
    return presented(thresholds.whatif_totals(labelled(spark, folder), 0.50))


def threshold_sweep(spark, folder):
    return presented(thresholds.threshold_sweep(labelled(spark, folder)))


def optimal_thresholds(spark, folder):
    rows = windowed(spark, folder).filter(F.col("window") == "threshold_validation")
    return presented(thresholds.optimal_by_category(rows))


def optimal_global(spark, folder):
    return presented(thresholds.optimal_global(labelled(spark, folder)))


def policy_metrics(spark, folder):
    """Policy of the category thresholds found on the whole labelled table."""
    rows = labelled(spark, folder)
    table = thresholds.optimal_by_category(rows)
    chosen = decisions.with_thresholds(rows.drop("verify_threshold", "decline_threshold"), table)
    decided = chosen.withColumn(
        "decision",
        decisions.costs.decide("fraud_probability", "verify_threshold", "decline_threshold"),
    )
    return presented(evaluation.policy_metrics(decided))


def window_metadata(spark, folder):
    return presented(evaluation.window_metadata(windowed(spark, folder)))


def roc_auc(spark, folder):
    return presented(evaluation.probability_metrics(labelled(spark, folder)).select("roc_auc"))


def average_precision(spark, folder):
    return presented(evaluation.probability_metrics(labelled(spark, folder)).select("average_precision"))


def brier_logloss(spark, folder):
    return presented(evaluation.brier_and_log_loss(labelled(spark, folder)))


def best_f1(spark, folder):
    return presented(evaluation.probability_metrics(labelled(spark, folder)).select("best_f1_threshold"), {"best_f1_threshold": 8})


def positive_class_weight(spark, folder):
    rows = labelled(spark, folder).withColumn("is_fraud", F.col("fraud_label").cast("int"))
    return presented(evaluation.positive_class_weight(rows))


def _drift_sides(spark, folder):
    """Reference: the earlier half of January by event time. Current: the rest."""
    rows = decision_table(spark, folder).select("event_time", "feature_snapshot.*")
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return rows.filter(F.col("event_time") < middle), rows.filter(F.col("event_time") >= middle)


def drift_features(spark, folder):
    reference, current = _drift_sides(spark, folder)
    return presented(drift.drift_features(reference, current))


def drift_summary(spark, folder):
    reference, current = _drift_sides(spark, folder)
    return presented(drift.drift_summary(drift.drift_features(reference, current)))


def drift_shifted(spark, folder):
    reference, current = _drift_sides(spark, folder)
    return presented(drift.drift_features(reference, drift.shifted(current)))


def drift_statistics(spark, folder):
    reference, current = _drift_sides(spark, folder)
    return presented(drift.drift_statistics(reference, current))


def drift_ks(spark, folder):
    """Every feature by the same test, whatever the sample's size; words have no order and so no score."""
    reference, current = _drift_sides(spark, folder)
    found = drift.drift_features(reference, current, "ks")
    return presented(found.select("feature", "test", "threshold", "reference_rows", "current_rows"))


def latest_snapshots(spark, folder):
    rows = drift.latest_snapshots(decision_table(spark, folder))
    return presented(
        rows.agg(
            F.count("*").alias("row_count"),
            F.min("processed_at").alias("current_window_start"),
            F.max("processed_at").alias("current_window_end"),
            F.sum("amount").alias("amount"),
        )
    )


def daily_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A drift report per day, whose drift share is that day's share of non-approved decisions."""
    return (
        staged(spark, folder)
        .groupBy("transaction_date")
        .agg(
            F.max("processed_at").alias("generated_at"),
            F.avg((F.col("decision") != "approve").cast("double")).alias("drift_share"),
        )
        .withColumn("health_status", drift.health_status(F.col("drift_share")))
        .drop("transaction_date")
    )


def model_health(spark, folder):
    return presented(drift.model_health(daily_reports(spark, folder), F.lit("2024-02-10 00:00:00")))


def upsert_latest(spark, folder):
    log = delivery_log(spark, folder).select(
        "transaction_id", "batch_id", "partition", "offset", "amount", "decision", "model_version"
    )
    return presented(decision_log.latest_versions(log).drop("partition"))


def upsert_explanations(spark, folder):
    """Explanation texts written after the first delivery: only unchanged models keep theirs."""
    log = delivery_log(spark, folder).withColumn(
        "processed_at", F.timestamp_seconds(F.lit(1706745600) + F.col("batch_id") * 3600)
    )
    texts = log.filter("batch_id = 0").select(
        "transaction_id",
        "model_version",
        F.concat(F.lit("text of "), F.col("transaction_id")).alias("explanation_text"),
        F.lit("template").alias("explanation_source"),
        F.lit(None).cast("string").alias("explanation_model"),
        F.timestamp_seconds(F.lit(1706745600 + 60)).alias("explanation_generated_at"),
    )
    slim = log.select("transaction_id", "model_version", "processed_at", "batch_id", "partition", "offset")
    latest = decision_log.with_explanation_text(decision_log.latest_versions(slim), slim, texts)
    return presented(latest.select("transaction_id", "model_version", "explanation_text", "explanation_generated_at"))


def outbox_new(spark, folder):
    log = delivery_log(spark, folder)
    key = F.concat_ws(":", F.lit("scored"), "transaction_id", "model_version").alias("dedupe_key")
    arrival = ["batch_id", "partition", "offset"]
    existing = log.filter("customer_ltv_band = 'low'").select(key)
    fresh = decision_log.new_messages(log.select(key, "transaction_id", "amount", *arrival), existing, arrival)
    return presented(fresh.select("dedupe_key", "transaction_id", "amount", "batch_id"))


def pending_outbox(spark, folder):
    outbox = scored(spark, folder).select(
        F.concat_ws(":", F.lit("scored"), "transaction_id", "model_version").alias("dedupe_key"),
        F.col("event_time").alias("created_at"),
        (F.col("event_time") + F.expr("INTERVAL 1 DAY")).alias("available_at"),
        F.when(F.col("decision") == "approve", F.col("event_time")).alias("published_at"),
        F.col("transaction_id").alias("message_key"),
    )
    pending = decision_log.pending_messages(outbox, F.lit("2024-01-16 00:00:00").cast("timestamp"), 100)
    return presented(pending.select("dedupe_key", "created_at", "message_key"))


def metrics_10s(spark, folder):
    return presented(operations.metric_sums(pipeline_metrics(spark, folder), "transactions_scored"))


def failure_rate_1m(spark, folder):
    return presented(operations.failure_rate(pipeline_metrics(spark, folder)))


def metric_totals(spark, folder):
    return presented(operations.metric_totals(pipeline_metrics(spark, folder)))


def dataset_profile(spark, folder):
    return presented(contract.dataset_profile(card_rows(spark, folder)))


def dataset_check(spark, folder):
    return presented(contract.dataset_checks(card_rows(spark, folder)))


def dq_reconcile(spark, folder):
    """The unlabelled gap: verified rows without a label carry friction but no realized cost."""
    return presented(quality.unreconciled(daily(spark, folder)))


def dq_reconcile_labelled(spark, folder):
    rows = marts.daily_segment_kpis(labelled(spark, folder))
    return presented(quality.unreconciled(rows).agg(F.count("*").alias("failures")))


def dq_unique(spark, folder):
    return presented(quality.duplicate_segments(daily(spark, folder)).agg(F.count("*").alias("failures")))


def dq_columns(spark, folder):
    days = daily(spark, folder)
    return presented(
        quality.column_tests(
            {
                "scored_transactions": decision_table(spark, folder),
                "mart_daily_segment_kpis": days,
                "mart_segment_kpis": marts.segment_kpis(days),
            }
        )
    )


def recent_transactions(spark, folder):
    rows = whatif.recent_transactions(decision_table(spark, folder), "shopping_net", 200)
    return presented(
        rows.select("transaction_id", "event_time", "merchant", "amount", "fraud_probability", "decision", "model_version"),
        {"fraud_probability": 8},
    )


def simulation_rows(spark, folder):
    rows = whatif.simulation_rows(decision_table(spark, folder), "2024-01-10", "2024-01-25", "grocery_pos")
    return presented(rows, {"fraud_probability": 8})


def whatif_category(spark, folder):
    rows = whatif.simulation_rows(decision_table(spark, folder), "2024-01-01", "2024-01-31", "travel")
    return presented(thresholds.whatif_totals(rows, 0.30))


def high_risk_alerts(spark, folder):
    return presented(decision_log.high_risk_alerts(scored(spark, folder)))


def alerts_half(spark, folder):
    return presented(decision_log.high_risk_alerts(scored(spark, folder), 0.50))


def replay_schedule(spark, folder):
    return presented(operations.replay_schedule(events(spark, folder), "demo"), {"delay_seconds": 10})


def replay_realtime(spark, folder):
    return presented(operations.replay_schedule(events(spark, folder), "realtime"))


def risk_drivers(spark, folder):
    rows = explanations.with_risk_drivers(decision_table(spark, folder))
    return presented(
        rows.select("transaction_id", F.posexplode("drivers").alias("rank", "driver")).select(
            "transaction_id", "rank", "driver.*"
        )
    )


def template_explanations(spark, folder):
    rows = explanations.template_explanations(decision_table(spark, folder))
    return presented(rows.select("transaction_id", "decision", "explanation_text", "sentence_problem"))


def explanation_inputs(spark, folder):
    return explanations.explanation_inputs(decision_table(spark, folder))


def retention_counts(spark, folder):
    rejected = contract.rejected_events(all_events(spark, folder))
    tables = {
        "scored_transactions": decision_table(spark, folder),
        "rejected_transactions": rejected.withColumn("rejected_at", F.col("event_time")),
        "pipeline_metrics": pipeline_metrics(spark, folder),
        "outbox": scored(spark, folder).withColumn(
            "published_at", F.when(F.col("decision") == "approve", F.col("event_time"))
        ),
    }
    return presented(operations.expired_counts(tables, F.lit("2024-04-15 00:00:00")))


def training_cap(spark, folder):
    """All card rows, as the training scan reads them without a cap."""
    rows = training_rows(card_rows(spark, folder))
    return presented(rows.select("trans_num", "trans_date_trans_time", "amt"))


def isotonic_calibration(spark, folder):
    """Isotonic regression of the label on the heuristic score, evaluated at every distinct score."""
    rows = windowed(spark, folder).filter(F.col("window") == "calibration")
    return presented(training.calibration_table(rows, "fraud_probability", "is_fraud"))


@cache
def _trained(application: str, folder: str) -> training.TrainingResult:
    """One training per application and folder; the queries about the model share it."""
    spark = SparkSession.active()
    return training.train(training.labelled_training_rows(card_rows(spark, folder), SALT))


def boosted_stump(spark, folder):
    """The first split of the booster on all labelled rows, over features whose every value is a border."""
    rows = training.labelled_training_rows(card_rows(spark, folder), SALT)
    weight = evaluation.positive_class_weight(rows).scalar()
    inputs = {
        "transaction_hour": F.col("transaction_hour"),
        "transaction_day_of_week": F.col("transaction_day_of_week"),
        "order_margin_pct": F.col("order_margin_pct"),
        "is_card_present": (F.col("channel") == "card_present").cast("int"),
        "is_low": (F.col("customer_ltv_band") == "low").cast("int"),
        "is_medium": (F.col("customer_ltv_band") == "medium").cast("int"),
    }
    prepared = rows.select(
        array_to_vector(F.array(*[value.cast("double") for value in inputs.values()])).alias("features"),
        F.col("is_fraud").cast("double").alias("label"),
        F.when(F.col("is_fraud") == 1, weight).otherwise(1.0).alias("weight"),
    )
    settings = boosting.Settings(1, 1, training.LEARNING_RATE, 1.0, 1.0, training.MIN_CHILD_HESSIAN, training.L2_TERM, training.SEED)
    edges, (tree,) = boosting.trees(checkpointed(prepared), "features", "label", "weight", settings)
    feature = int(tree.feature[0])
    found = [(list(inputs)[feature], float(edges[feature][tree.cut[0]]), *[float(v) for v in (tree.gain[0], *tree.value[1:3], *tree.cover[1:3])])]
    names = "feature string, border double, gain double, left_value double, right_value double, left_hessian double, right_hessian double"
    return presented(spark.createDataFrame(found, names))


def gbt_metrics(spark, folder):
    return presented(_trained(spark.sparkContext.applicationId, folder).metrics)


def tree_contributions(spark, folder):
    rows = training.labelled_training_rows(dealt_card_rows(spark, folder), SALT)
    bundle = _trained(spark.sparkContext.applicationId, folder).bundle
    explained = contributions.with_contributions(bundle.raw_scores(rows), bundle)
    return presented(
        explained.select("transaction_id", F.posexplode("explanation").alias("rank", "driver")).select(
            "transaction_id", "rank", "driver.feature", "driver.contribution"
        )
    )


def model_checks(spark, folder):
    """Per window, how many rows break what must hold for every score and its contributions."""
    rows = evaluation.with_windows(training.labelled_training_rows(dealt_card_rows(spark, folder), SALT))
    bundle = _trained(spark.sparkContext.applicationId, folder).bundle
    explained = bundle.calibrated(contributions.with_contributions(bundle.raw_scores(rows), bundle, total="_total"))
    probability, raw = F.col("fraud_probability"), F.col("raw_probability")
    margin = F.log(raw / (1 - raw))

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 0).otherwise(1)).cast("bigint")

    return presented(
        explained.groupBy("window").agg(
            F.count("*").alias("row_count"),
            F.sum("is_fraud").cast("bigint").alias("fraud_rows"),
            count(probability.between(0, 1) & raw.between(0, 1)).alias("not_probabilities"),
            count(F.size("explanation").between(1, 6)).alias("not_explained"),
            count(F.abs(F.col("_total") - margin) < 1e-6).alias("not_adding_up"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        txn_features, txn_valid, txn_rejected_counts, dead_letters, scored_heuristic, expected_costs,
        staged_transactions, mart_daily_segment, mart_segment, available_window, dashboard_totals,
        daily_kpis_default_window, daily_costs_long, daily_decisions_long, segment_performance,
        merchant_categories, whatif_threshold, threshold_sweep, optimal_thresholds, optimal_global,
        policy_metrics, window_metadata, roc_auc, average_precision, brier_logloss, best_f1,
        positive_class_weight, drift_features, drift_summary, drift_shifted, drift_statistics, drift_ks, latest_snapshots,
        model_health, upsert_latest, upsert_explanations, outbox_new, pending_outbox, metrics_10s,
        failure_rate_1m, metric_totals, dataset_profile, dataset_check, dq_reconcile,
        dq_reconcile_labelled, dq_unique, dq_columns, recent_transactions, simulation_rows,
        whatif_category, high_risk_alerts, alerts_half, replay_schedule, replay_realtime, risk_drivers,
        template_explanations, explanation_inputs, retention_counts, training_cap,
        isotonic_calibration, boosted_stump, gbt_metrics, tree_contributions, model_checks,
    )
}
