import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from cardtide.fixed_values import DECLINE_GRID, REACQUISITION_BY_BAND, VERIFY_GRID
from cardtide.functions.costs import whatif_verify
from cardtide.operators import decision_log, drift, evaluation, operations, thresholds
from cardtide.operators.ordered import first_rows, running_totals, time_order_cuts
from cardtide.plans import catalogue, whatif

MONEY_COLUMNS = (
    "fraud_probability double, fraud_label boolean, amount double, order_margin_pct double, "
    "customer_ltv_band string, merchant_category string"
)


def money_rows(spark, rows):
    return spark.createDataFrame(rows, MONEY_COLUMNS)


def random_rows(count, seed):
    pick = random.Random(seed)
    scores = VERIFY_GRID + DECLINE_GRID + [pick.random() for _ in range(40)]
    return [
        (pick.choice(scores), pick.random() < 0.3, round(pick.uniform(1, 500), 2), 0.25, pick.choice(["low", "medium", "high"]),
         pick.choice(["home", "travel"]))
        for _ in range(count)
    ]


def realized(row, verify, decline):
    p, fraud, amount, margin, band, _ = row
    friction = amount * margin + REACQUISITION_BY_BAND[band]
    if p >= decline:
        return 0.0 if fraud else friction
    if p >= verify:
        return 3.0 + (amount * (1 - 0.85) if fraud else friction * 0.08)
    return amount if fraud else 0.0


def brute_force(rows):
    best = None
    for verify in VERIFY_GRID:
        for decline in DECLINE_GRID:
            if verify < decline:
                total = round(sum(realized(row, verify, decline) for row in rows), 6)
                if best is None or total < best[0]:
                    best = (total, verify, decline)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_search_equals_brute_force(spark, seed):
    rows = random_rows(300, seed)
    found = thresholds.optimal_global(money_rows(spark, rows)).first()
    cost, verify, decline = brute_force(rows)
    assert (found["verify"], found["decline"]) == (verify, decline)
    assert found["validation_cost"] == pytest.approx(cost, abs=1e-4)


def test_category_search_and_fallback(spark):
    rows = [r for r in random_rows(300, 3) if r[5] == "home"] + [
        (0.2, i == 0, 50.0, 0.25, "low", "travel") for i in range(10)
    ]
    found = {row["merchant_category"]: row for row in thresholds.optimal_by_category(money_rows(spark, rows)).collect()}
    _, verify, decline = brute_force(rows)
    assert found["travel"]["fallback"] == "global" and found["travel"]["validation_cost"] is None
    assert (found["travel"]["verify"], found["travel"]["decline"]) == (verify, decline)
    _, verify, decline = brute_force([row for row in rows if row[5] == "home"])
    assert (found["home"]["verify"], found["home"]["decline"]) == (verify, decline)


def test_whatif_adds_up(spark):
    rows = money_rows(
        spark,
        [(0.01, False, 20.0, 0.2, "low", "home"), (0.2, False, 40.0, 0.2, "medium", "home"), (0.9, True, 500.0, 0.2, "high", "home")],
    )
    low = thresholds.whatif_totals(rows, 0.15).first()
    half = thresholds.whatif_totals(rows, 0.5).first()
    for result in (low, half):
        assert result["approve_count"] + result["verify_count"] + result["decline_count"] == 3
        assert result["total_cost"] == pytest.approx(result["fraud_missed_cost"] + result["friction_cost"])
    assert half["fraud_intervened"] == 1 and half["verify_threshold"] == whatif_verify(0.5)
    assert low["total_cost"] != half["total_cost"]


def test_whatif_of_nothing_is_zero(spark):
    result = thresholds.whatif_totals(money_rows(spark, []), 0.5).first()
    assert result["total_cost"] == 0.0 and result["approve_count"] == 0


def test_threshold_contract(spark):
    table = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.8, 0.2), ("c", 0.1, None)], "c string, verify double, decline double")
    assert {row["c"] for row in thresholds.threshold_breaks(table).collect()} == {"b", "c"}


def test_thresholds_from_map(spark):
    rows = spark.sql(
        "SELECT map('a', named_struct('verify', 0.1D, 'decline', 0.9D), 'b', named_struct('verify', 0.1D, 'decline', 0.3D)) "
        "AS category_thresholds"
    )
    assert [row["merchant_category"] for row in thresholds.thresholds_from_map(rows).collect()] == ["b", "a"]


def test_snapshots_from_json(spark):
    rows = spark.createDataFrame([('{"amount": 5.0}',), ("{}",), (None,)], "feature_snapshot string")
    found = drift.snapshots_from_json(rows).collect()
    assert len(found) == 1 and found[0][0]["amount"] == 5.0 and found[0][0]["channel"] is None


def test_running_totals(spark):
    values = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") * 2).alias("n"))
    rows = running_totals(values, "x", ["n"], by=["g"], previous="p").collect()
    assert len(rows) == 1000
    for row in rows:
        earlier = range(row["g"], row["x"], 3)
        assert row["n_before"] == sum(2 * x for x in earlier)
        assert row["p"] == (row["x"] - 3 if row["x"] >= 3 else None)


def test_windows_by_position(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"t-{i:07d}", start + datetime.timedelta(hours=i), i % 2) for i in range(20)]
    frame = spark.createDataFrame(rows, "transaction_id string, event_time timestamp, is_fraud int")
    counts = {r["window"]: r["row_count"] for r in evaluation.window_metadata(evaluation.with_windows(frame)).collect()}
    assert counts == {"train": 14, "calibration": 3, "threshold_validation": 3}
    evaluation.require_both_classes(evaluation.window_metadata(evaluation.with_windows(frame)))
    with pytest.raises(ValueError, match="must contain fraud and legitimate"):
        one_class = frame.withColumn("is_fraud", F.lit(0))
        evaluation.require_both_classes(evaluation.window_metadata(evaluation.with_windows(one_class)))


def test_rows_without_time_belong_to_no_window(spark):
    frame = spark.range(100).select(
        F.format_string("t-%07d", "id").alias("transaction_id"),
        F.when(F.col("id") >= 20, F.timestamp_seconds(F.lit(1700000000) + F.floor(F.col("id") / 30))).alias("event_time"),
        (F.col("id") % 2).cast("int").alias("is_fraud"),
    )
    counts = {r["window"]: r["row_count"] for r in evaluation.window_metadata(evaluation.with_windows(frame)).collect()}
    assert counts == {"train": 56, "calibration": 12, "threshold_validation": 12}
    (all_known,) = time_order_cuts(frame, "event_time", "transaction_id", lambda _: [1000])
    assert frame.filter(all_known).count() == 80


def test_windows_split_a_hot_timestamp_exactly(spark):
    frame = spark.range(3000).select(
        F.format_string("t-%07d", "id").alias("transaction_id"),
        F.when(F.col("id") < 500, F.lit("2024-01-01 10:00:00")).otherwise("2024-01-02 10:00:00").cast("timestamp").alias("event_time"),
    )
    cut = time_order_cuts(frame, "event_time", "transaction_id", lambda _: [1234])[0]
    assert frame.filter(cut).count() == 1234


@pytest.mark.parametrize("newest", [True, False])
def test_first_rows(spark, newest):
    frame = spark.range(5000).select(
        F.format_string("t-%07d", "id").alias("i"),
        F.timestamp_seconds(F.lit(1700000000) + F.floor(F.col("id") / 7) * 997).alias("t"),
    )
    expected = frame.orderBy(F.col("t").desc() if newest else F.col("t"), "i").limit(321).collect()
    assert first_rows(frame, 321, "t", "i", newest).collect() == expected
    assert first_rows(frame, 9999, "t", "i", newest).count() == 5000


def test_probability_metrics(spark):
    rows = [(0.1, False), (0.4, False), (0.35, True), (0.8, True)]
    frame = spark.createDataFrame(rows, "fraud_probability double, fraud_label boolean")
    found = evaluation.probability_metrics(frame).first()
    assert found["roc_auc"] == pytest.approx(0.75)
    assert found["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert found["brier_score"] == pytest.approx((0.01 + 0.16 + 0.65**2 + 0.04) / 4)
    assert found["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.6) + math.log(0.35) + math.log(0.8)) / 4)
    assert found["best_f1_threshold"] == 0.35


def test_ties_count_one_half(spark):
    frame = spark.createDataFrame([(0.5, True), (0.5, False)], "fraud_probability double, fraud_label boolean")
    assert evaluation.probability_metrics(frame).first()["roc_auc"] == 0.5


def feature_rows(spark, count, shift=0.0):
    return spark.range(count).select(
        (F.col("id") % 97 + shift).alias("amount"),
        F.log1p(F.col("id") % 97).alias("log_amount"),
        (F.col("id") % 31).cast("double").alias("distance_km"),
        (F.col("id") % 24).alias("transaction_hour"),
        (F.col("id") % 7).alias("transaction_day_of_week"),
        (F.col("id") % 60 + 20).alias("customer_age"),
        (F.col("id") % 53 * 100).alias("city_population"),
        (F.col("id") % 2).alias("is_night"),
        (F.col("id") % 14 / 100.0).alias("order_margin_pct"),
        F.element_at(F.array(F.lit("home"), F.lit("travel"), F.lit("misc_net")), (F.col("id") % 3 + 1).cast("int")).alias("merchant_category"),
        F.lit("card_present").alias("channel"),
        F.lit("low").alias("customer_ltv_band"),
    )


@pytest.mark.parametrize("count", [500, 2000])
def test_drift_sees_only_the_shift(spark, count):
    reference = feature_rows(spark, count)
    same = {row["feature"]: row for row in drift.drift_features(reference, feature_rows(spark, count)).collect()}
    assert len(same) == 12 and not any(row["drifted"] for row in same.values())
    assert same["amount"]["test"] == ("wasserstein" if count > 1000 else "ks")
    assert same["is_night"]["test"] == ("jensen_shannon" if count > 1000 else "z")
    assert same["merchant_category"]["test"] == ("jensen_shannon" if count > 1000 else "chi_square")
    moved = drift.drift_features(reference, drift.shifted(feature_rows(spark, count)))
    drifted = {row["feature"] for row in moved.collect() if row["drifted"]}
    assert {"amount", "log_amount", "distance_km", "city_population", "merchant_category", "channel", "customer_ltv_band"} <= drifted
    summary = drift.drift_summary(moved).first()
    assert summary["health_status"] == "drifting" and summary["total_features"] == 12


def test_wasserstein_of_a_shift(spark):
    row = drift.drift_features(feature_rows(spark, 1940), feature_rows(spark, 1940, 10.0)).filter("feature = 'amount'").first()
    spread = math.sqrt(sum((x - 48) ** 2 for x in range(97)) / 97)
    assert row["score"] == pytest.approx(10 / spread)


def test_health_limits(spark):
    shares = spark.createDataFrame([(0.29,), (0.30,)], "s double").select(drift.health_status(F.col("s"))).collect()
    assert [row[0] for row in shares] == ["ok", "drifting"]
    reports = spark.createDataFrame(
        [(datetime.datetime(2024, 1, 1), "ok"), (datetime.datetime(2024, 1, 5), "error")], "generated_at timestamp, health_status string"
    )
    fresh = drift.model_health(reports, F.lit("2024-01-06 00:00:00")).first()
    assert fresh["effective_health_status"] == "error" and fresh["age_seconds"] == 86400
    assert drift.model_health(reports, F.lit("2024-01-20 00:00:00")).first()["effective_health_status"] == "stale"
    assert drift.model_health(reports, F.lit("2024-01-01 00:00:00")).first()["age_seconds"] == 0
    assert drift.model_health(reports.limit(0), F.lit("2024-01-06")).count() == 0


def test_drift_job_records_every_outcome(spark, folder, tmp_path):
    from cardtide.plans.drift_report import run_report

    table = catalogue.decision_table(spark, folder)
    training = catalogue.decisions.training_frame(catalogue.card_rows(spark, folder), "salt")
    reports, now = str(tmp_path / "reports"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert run_report(training, table, reports, now, "v1", needed=5000)["status"] == "insufficient_data"
    assert run_report(training, table, reports, now, "v1", simulate_shift=True)["status"] == "drifting"
    with pytest.raises(Exception):
        run_report(training.drop("amount"), table, reports, now, "v1")
    rows = spark.read.parquet(reports).collect()
    assert sorted(row["health_status"] for row in rows) == ["drifting", "error", "insufficient_data"]
    error = [row for row in rows if row["health_status"] == "error"][0]
    assert "amount" not in error["details"] and error["current_rows"] == 0


def test_latest_version_wins_by_arrival(spark):
    log = spark.createDataFrame(
        [("a", 0, 0, 5, "old", "v1"), ("a", 1, 0, 2, "new", "v1"), ("a", 0, 0, 9, "mid", "v1"), ("b", 0, 0, 1, "only", "v1")],
        "transaction_id string, batch_id bigint, partition int, offset bigint, x string, model_version string",
    )
    assert {r["transaction_id"]: r["x"] for r in decision_log.latest_versions(log).collect()} == {"a": "new", "b": "only"}


def test_outbox_keeps_the_first_of_each_key(spark):
    rows = spark.createDataFrame([("k1", 1, "b"), ("k1", 0, "a"), ("k2", 2, "c"), ("k3", 3, "d")], "dedupe_key string, offset int, x string")
    fresh = decision_log.new_messages(rows, spark.createDataFrame([("k2",)], "dedupe_key string"), ["offset"])
    assert {(r["dedupe_key"], r["x"]) for r in fresh.collect()} == {("k1", "a"), ("k3", "d")}


def test_alerts_start_at_the_limit(spark):
    rows = spark.createDataFrame(
        [("txn-1", 0.90, "decline", "travel", 1234.5), ("txn-2", 0.8999, "decline", "home", 1.0)],
        "transaction_id string, fraud_probability double, decision string, merchant_category string, amount double",
    )
    alert = decision_log.high_risk_alerts(rows).collect()
    assert len(alert) == 1 and alert[0]["amount_text"] == "$1,234.50" and alert[0]["risk"] == "90.0%"
    assert "customer_id" not in alert[0].asDict()


def test_retention_keeps_unpublished_rows(spark):
    rows = spark.createDataFrame(
        [(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 1, 30),), (None,)], "published_at timestamp"
    )
    now = F.lit("2024-02-01 00:00:00")
    assert operations.retained(rows, "outbox", now).count() == 2
    assert operations.expired_counts({"outbox": rows}, now).first()["expired_rows"] == 1


def test_replay_gaps_cross_hours_and_days(spark):
    times = ["2024-01-01 00:10:00", "2024-01-01 05:10:00", "2024-01-01 05:10:00", "2024-01-04 00:00:01"]
    events = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(times)], "transaction_id string, event_time string").withColumn(
        "event_time", F.col("event_time").cast("timestamp")
    )
    gaps = {r["transaction_id"]: r["gap_seconds"] for r in operations.replay_schedule(events, "demo").collect()}
    assert gaps == {"t0": None, "t1": 18000.0, "t2": 0.0, "t3": 240601.0}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, folder, tmp_path):
    path = str(tmp_path / "decisions")
    catalogue.decision_table(spark, folder).write.parquet(path)
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(whatif.simulation_rows(stored, "2024-01-10", "2024-01-25", "home"))
    assert "EqualTo(merchant_category,home)" in text and "GreaterThanOrEqual(event_time" in text
    assert "explanation" not in text.split("ReadSchema")[1]
