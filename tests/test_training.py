from dataclasses import replace
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from cardtide.fixed_values import FEATURES
from cardtide.plans import catalogue, contributions, decisions, margins, training
from cardtide.streaming import decision_stream as stream


@pytest.fixture(scope="module")
def rows(spark):
    return training.labelled_training_rows(catalogue.card_rows(spark, "/root/testdata/sf0.01"), "salt").persist()


@pytest.fixture(scope="module")
def result(rows):
    return training.train(rows, rounds=12, depth=4)


def test_windows_and_weights(result, rows):
    counts = {row["window"]: row["row_count"] for row in result.windows.collect()}
    total = rows.count()
    assert counts["train"] == int(total * 0.7) and counts["calibration"] == int(total * 0.15)
    assert sum(counts.values()) == total


def test_quality(result):
    metrics = {(row["window"], row["version"]): row for row in result.metrics.collect()}
    assert set(metrics) == {("calibration", "raw"), ("calibration", "calibrated"), ("threshold_validation", "calibrated")}
    # The label also depends on a field that is no feature; about 0.87 is the best possible.
    assert metrics[("threshold_validation", "calibrated")]["roc_auc"] > 0.80
    assert metrics[("calibration", "calibrated")]["brier_score"] < metrics[("calibration", "raw")]["brier_score"]
    policy = metrics[("threshold_validation", "calibrated")]
    assert policy["policy_cost"] < policy["approve_all_baseline_cost"]
    assert policy["approve_count"] + policy["verify_count"] + policy["decline_count"] > 0


def test_feature_names(result):
    names = result.bundle.feature_names
    assert len(names) == 28 and names[:9] == FEATURES[:9]
    assert "merchant_category_shopping_net" in names and "customer_ltv_band_high" in names


def test_unseen_categories_become_zeros(result, rows):
    odd = rows.limit(5).withColumns({"merchant_category": F.lit("nowhere"), "channel": F.lit("phone"), "customer_ltv_band": F.lit("none")})
    vectors = result.bundle.raw_scores(odd).select(vector_to_array("features").alias("v")).collect()
    assert all(len(row["v"]) == 28 and not any(row["v"][9:]) for row in vectors)


def test_calibration_is_monotone(spark, result, rows):
    table = training.calibration_table(rows.limit(2000), "amount", "is_fraud").orderBy("score").collect()
    values = [row["calibrated"] for row in table]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_contributions_add_up_to_the_margin(spark, result, rows):
    booster = result.bundle.pipeline.stages[-1]
    tables = contributions.leaf_tables(booster, spark)
    sample = result.bundle.pipeline.transform(rows.limit(200)).select(
        vector_to_array("features").alias("v"), vector_to_array("rawPrediction").alias("raw")
    ).collect()
    matrix = np.array([row["v"] for row in sample])
    values = contributions.contribution_values(matrix, tables)
    margins = np.array([2 * row["raw"][1] for row in sample])
    assert np.allclose(values.sum(axis=1) + tables.expected, margins, atol=1e-8)
    assert np.abs(values).max() > 0
    for leaf in tables.leaves:
        leaf.table = None
    assert np.allclose(contributions.contribution_values(matrix, tables), values, atol=1e-9)


def test_leaf_table_is_symmetric_and_efficient():
    table = 4.0 * contributions.path_values(contributions._patterns(2), np.array([0.5, 0.5]))
    assert np.allclose(table[3], [1.5, 1.5]) and np.allclose(table.sum(axis=1), [-1, -1, -1, 3])


def test_path_values_match_the_sum_over_coalitions():
    rng = np.random.default_rng(3)
    shares, met = rng.random(4), np.array([1.0, 0.0, 1.0, 1.0])
    for i in range(4):
        others = [j for j in range(4) if j != i]
        expected = 0.0
        for count in range(4):
            for chosen in combinations(others, count):
                rest = np.prod([met[j] if j in chosen else shares[j] for j in others])
                expected += (met[i] - shares[i]) * rest * factorial(count) * factorial(3 - count) / factorial(4)
        assert np.isclose(contributions.path_values(met, shares)[i], expected)


def test_version_follows_the_content(result):
    bundle = result.bundle
    assert bundle.model_version == training.content_version(bundle) == result.metadata["model_version"]
    other = replace(bundle, global_thresholds={"verify": 0.01, "decline": 0.02})
    assert training.content_version(other) != bundle.model_version


def test_bundle_round_trip_and_last_good_model(spark, result, rows, tmp_path):
    path = str(tmp_path / "model")
    training.save_result(result, path)
    loaded = training.load_bundle(spark, f"{path}/bundle")
    events = catalogue.events(spark, "/root/testdata/sf0.001")
    featured = decisions.with_model_features(events)
    columns = ["transaction_id", "fraud_probability", "decision", "realized_policy_cost"]
    before = result.bundle.decide(featured).select(*columns)
    after = loaded.decide(featured).select(*columns)
    assert before.count() == events.count() and before.exceptAll(after).count() == 0
    assert training.load_or_keep(spark, str(tmp_path / "nothing"), loaded) is loaded
    assert spark.read.json(f"{path}/metrics").count() == 3 and spark.read.parquet(f"{path}/windows").count() == 3


@pytest.mark.parametrize("pair", [{"verify": 0.8, "decline": 0.2}, {"verify": 0.1}, {"verify": "x", "decline": 0.5}])
def test_bad_thresholds_are_refused(result, pair):
    broken = training.ModelBundle(
        result.bundle.pipeline, result.bundle.calibrator, [], pair, "v", result.bundle.feature_names
    )
    with pytest.raises(training.BundleError):
        training.check_bundle(broken)


def test_model_in_a_stream(spark, result, tmp_path, monkeypatch):
    builds, build = [], contributions.leaf_tables
    monkeypatch.setattr(contributions, "leaf_tables", lambda *given: builds.append(1) or build(*given))
    result.bundle.tables = None
    incoming, sinks = str(tmp_path / "in"), stream.DecisionSinks(str(tmp_path / "out"))
    stream.write_replay(catalogue.all_events(spark, "/root/testdata/sf0.001"), incoming, 2, limit=50)
    query = stream.start(
        stream.message_files(spark, incoming, 1), sinks, str(tmp_path / "checkpoint"), stream.model_scorer(result.bundle)
    )
    query.awaitTermination(300)
    assert query.exception() is None
    table = stream.current_decisions(spark, sinks)
    assert table.count() == 50
    assert table.filter((F.size("explanation") <= 6) & (F.size("explanation") > 0)).count() == 50
    assert table.filter(F.col("model_version") == result.bundle.model_version).count() == 50
    assert len(builds) == 1 and sinks.read(spark, "commits").count() > 1


def test_failed_explanations_become_a_metric(spark):
    rows = spark.createDataFrame(
        [("v1", []), ("v1", [("amount", "1", 0.1)])],
        "model_version string, explanation array<struct<feature:string,value:string,contribution:double>>",
    )
    metric = contributions.explanation_failures(rows, F.lit("2024-01-01 00:00:00")).collect()
    assert len(metric) == 1 and metric[0]["metric_value"] == 1.0


def test_leaves_are_looked_up_in_groups(spark, result, rows):
    booster = result.bundle.pipeline.stages[-1]
    tables = contributions.leaf_tables(booster, spark)
    sample = result.bundle.pipeline.transform(rows.limit(300)).select(vector_to_array("features").alias("v")).collect()
    matrix = np.array([row["v"] for row in sample])
    expected = contributions.leaf_values(matrix, tables.leaves)
    assert np.allclose(contributions.contribution_values(matrix, tables), expected, atol=1e-10) and np.abs(expected).max() > 0
    assert not tables.alone and len(tables.groups) * 2 <= len(tables.leaves)
    assert all(group.table.shape[1] <= 1 << contributions.GROUP_SPLITS for group in tables.groups)


def test_leaves_with_too_many_splits_are_worked_out_alone(spark, result, rows, monkeypatch):
    booster = result.bundle.pipeline.stages[-1]
    whole = contributions.leaf_tables(booster, spark)
    monkeypatch.setattr(contributions, "GROUP_SPLITS", 1)
    tables = contributions.leaf_tables(booster, spark)
    matrix = np.array([row["v"] for row in result.bundle.pipeline.transform(rows.limit(50)).select(vector_to_array("features").alias("v")).collect()])
    assert tables.alone
    assert np.allclose(contributions.contribution_values(matrix, tables), contributions.contribution_values(matrix, whole), atol=1e-10)


def test_a_row_that_cannot_be_explained_is_an_error(spark, result, rows):
    """It used to have no contributions, as had all rows of its batch, and the query lost them without a word (F5)."""
    cut = F.udf(lambda vector: Vectors.dense(vector.toArray()[:1]), VectorUDT())
    raw = result.bundle.raw_scores(rows.limit(20).coalesce(1))
    broken = raw.withColumn("features", F.when(F.col("transaction_id") == raw.first()["transaction_id"], cut("features")).otherwise(F.col("features")))
    with pytest.raises(PythonException):
        contributions.with_contributions(broken, result.bundle).select("explanation").collect()
    sizes = [len(row["explanation"]) for row in contributions.with_contributions(broken, result.bundle, tolerant=True).select("explanation").collect()]
    assert sizes.count(0) == 1 and len(sizes) == 20


def test_scores_are_those_of_the_spark_model(spark, result, rows):
    """Trees are walked a batch at a time (F1, F3), to the probabilities that Spark's model gives."""
    sample = rows.limit(400)
    whole = result.bundle.pipeline.transform(sample).select("transaction_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    ours = result.bundle.raw_scores(sample)
    assert ours.columns == [*sample.columns, "features", "raw_probability"]
    pairs = whole.join(ours, "transaction_id").select("p", "raw_probability").collect()
    assert len(pairs) == 400 and len({row["p"] for row in pairs}) > 50
    assert [row["raw_probability"] for row in pairs] == pytest.approx([row["p"] for row in pairs], abs=1e-14)
    assert "predict" not in ours._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_value_on_a_border_or_no_number_goes_as_in_spark():
    tree = margins.WalkedTree(np.array([0, 0, 0]), np.array([1.5, np.inf, np.inf]), np.array([1, 2, 1, 1, 2, 2]), np.array([0.0, -1.0, 1.0]), 1)
    assert margins.margins(np.array([[1.5], [1.6], [np.nan]]), [tree]).tolist() == [-1.0, 1.0, 1.0]
