"""Named queries over contracts, serialised forms and inputs of the model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from cardtide.fixed_values import FEATURES, NUMERIC_FEATURES
from cardtide.operators import contract, decision_log, drift, evaluation, explanations, thresholds
from cardtide.plans import catalogue, decisions, drift_report, training
from cardtide.plans.log_queries import written_log
from cardtide.session import working_folder
from cardtide.sources import tables

presented = catalogue.presented
MANIFEST_NAME = "events.csv"
#: What every fiftieth message is turned into, by its offset's remainder.
BROKEN = {1: b"{broken", 2: b"[1]", 3: None, 4: b"\xff{}", 5: b'{"extra":1}'}


def card_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Card rows written as text with a header and read again: columns by name, then typed."""
    path = working_folder(spark, "csv")
    rows = catalogue.card_rows(spark, folder)
    rows.withColumn("trans_date_trans_time", F.date_format("trans_date_trans_time", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).csv(path)
    typed = tables.typed_card_rows(tables.read_card_csv(spark, path))
    return presented(typed.select("trans_num", "trans_date_trans_time", "cc_num", "category", "amt", "city_pop", "dob", "is_fraud"))


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """The table against a manifest that has its times but one row more."""
    rows, path = catalogue.card_rows(spark, folder), working_folder(spark, "manifest")
    facts = rows.agg(F.count("*"), *[F.date_format(f("trans_date_trans_time"), "yyyy-MM-dd HH:mm:ss") for f in (F.min, F.max)]).first()
    entry = {"rows": facts[0] + 1, "min_timestamp": facts[1], "max_timestamp": facts[2], "sha256": ""}
    training.write_json_row(spark, {MANIFEST_NAME: entry}, path)
    return presented(contract.dataset_checks(rows, tables.read_manifest(spark, path), MANIFEST_NAME))


def dead_letter_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Error types of all dead letters, with messages of every broken form among those of the table."""
    turn = F.col("offset") % 50
    value = F.col("value")
    for remainder, broken in BROKEN.items():
        value = F.when(turn == remainder, F.lit(broken).cast("binary")).otherwise(value)
    messages = catalogue.messages(spark, folder).drop("event_time").withColumn("value", value)
    letters = contract.dead_letters(contract.parse_messages(messages), F.lit(catalogue.NOW))
    message = F.when(turn.isin(1, 2, 3, 4), F.col("error_message"))
    size = F.when(turn.isin(*BROKEN), F.col("payload.payload_bytes"))
    return presented(letters.select("offset", "error_type", message.alias("error_message"), size.alias("payload_bytes")))


def outbound_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the event, of the score and of the snapshot, read back from the outbound messages."""
    sent = decision_log.scored_messages(catalogue.scored(spark, folder))
    body = {name: F.get_json_object("payload", f"$.{path}") for name, path in (
        ("merchant_category", "merchant_category"), ("decision", "decision"), ("model_version", "model_version"),
    )}
    numbers = {name: F.get_json_object("payload", f"$.{path}").cast("double") for name, path in (
        ("amount", "amount"), ("fraud_probability", "fraud_probability"), ("snapshot_hour", "feature_snapshot.transaction_hour"),
        ("snapshot_amount", "feature_snapshot.amount"),
    )}
    return presented(sent.select("message_key", "topic", *[value.alias(name) for name, value in (body | numbers).items()]))


def json_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots kept as text: one band's lack the age, another band's are empty."""
    rows, band = catalogue.decision_table(spark, folder), F.col("customer_ltv_band")
    kept = F.to_json(F.struct(*[F.col(f"feature_snapshot.{name}") for name in FEATURES if name != "customer_age"]))
    text = F.when(band == "high", kept).when(band == "low", "{}").otherwise(F.to_json("feature_snapshot"))
    found = drift.snapshots_from_json(rows.select("transaction_id", text.alias("feature_snapshot")))
    return presented(found.select("transaction_id", *[F.col(f"feature_snapshot.{name}") for name in ("amount", "customer_age", "channel", "is_night")]))


def score_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that leave the score contract, with a fault in each of five categories."""
    category = F.col("merchant_category")
    faults = {
        "verify_threshold": ("travel", F.lit(None).cast("double")),
        "fraud_probability": ("home", F.lit(1.5)),
        "decision": ("kids_pets", F.lit("hold")),
        "expected_cost_decline": ("misc_net", F.lit(float("nan"))),
        "model_version": ("misc_pos", F.lit("other")),
    }
    rows = catalogue.scored(spark, folder).withColumns(
        {name: F.when(category == where, value).otherwise(F.col(name)) for name, (where, value) in faults.items()}
    )
    breaks = decisions.score_contract_breaks(rows, decisions.HEURISTIC_VERSION)
    return presented(breaks.groupBy("merchant_category").agg(F.count("*").alias("broken_rows")))


def threshold_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A map of thresholds as a table, and which pairs may not be used."""
    segments = catalogue.scored(spark, folder).groupBy("merchant_category").agg(
        F.round(F.avg("fraud_probability"), 6).alias("verify"), (F.count("*") % 3).cast("double").alias("n")
    )
    pair = F.struct("verify", (F.col("verify") * F.col("n")).alias("decline"))
    # One entry per merchant category.
    mapped = segments.agg(F.map_from_entries(F.collect_list(F.struct("merchant_category", pair))).alias("category_thresholds"))
    table = thresholds.thresholds_from_map(mapped)
    broken = thresholds.threshold_breaks(table).select("merchant_category", F.lit(True).alias("broken"))
    joined = table.join(broken, "merchant_category", "left")
    return presented(joined.select("merchant_category", "verify", "decline", F.coalesce("broken", F.lit(False)).alias("broken")))


def rejected_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Every rejected transaction of the written log has one dead letter and no decision."""
    _, sinks = written_log(spark, folder)
    return presented(decision_log.rejected_routing(sinks.read(spark, "rejected_transactions"), sinks.read(spark, "scored_transactions")))


def ranked_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Contributions from low to high, and the two of the largest size."""
    def names(items):
        return F.array_join(F.transform(items, lambda item: item["feature"]), ",")

    rows = catalogue.scored(spark, folder)
    given = F.col("explanation")
    return rows.select(
        "transaction_id", names(explanations.contributions_by_value(given)).alias("by_value"), names(explanations.top_contributions(given, 2)).alias("largest")
    )


def drift_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the 500 earliest training rows, summed up."""
    rows = training.labelled_training_rows(catalogue.card_rows(spark, folder), catalogue.SALT)
    found = drift_report.reference_features(rows, 500)
    return presented(found.agg(F.count("*").alias("row_count"), F.sum("amount").alias("amount"), F.sum("customer_age").alias("ages"), F.max("distance_km").alias("farthest")))


def preprocessed(spark: SparkSession, folder: str) -> DataFrame:
    """What standardising subtracts and divides by, and the share of each category's column."""
    rows = training.labelled_training_rows(catalogue.card_rows(spark, folder), catalogue.SALT)
    fitted = Pipeline(stages=training.preprocessing_stages()).fit(rows)
    scaler, names = fitted.stages[3], training.feature_names(fitted)
    shares = fitted.transform(rows).select(Summarizer.mean(F.col("features"))).first()[0]
    size = len(NUMERIC_FEATURES)
    found = [(n, float(m), float(d)) for n, m, d in zip(names, scaler.mean, scaler.std)]
    found += [(n, float(share), None) for n, share in zip(names[size:], shares[size:])]
    return presented(spark.createDataFrame(found, "feature string, mean double, deviation double"))


def class_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each window has rows of both classes, and the check that training makes."""
    metadata = evaluation.window_metadata(catalogue.windowed(spark, folder))
    evaluation.require_both_classes(metadata)
    fraud, rows = F.col("fraud_rows"), F.col("row_count")
    return presented(metadata.select("window", ((fraud > 0) & (fraud < rows)).alias("both_classes")))


QUERIES = {
    query.__name__: query
    for query in (
        card_csv, manifest_check, dead_letter_kinds, outbound_payloads, json_snapshots, score_breaks, threshold_contract,
        rejected_routing, ranked_contributions, drift_reference, preprocessed, class_windows,
    )
}
