"""Drift methods as arguments, and statistics that keep their digits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardtide.fixed_values import CATEGORICAL_FEATURES, FEATURES
from cardtide.operators import drift


def sample(spark, rows, shift=0.0, seed=1):
    rng = np.random.default_rng(seed)
    made = [
        [float(rng.normal(1e9 + shift, 1.0)) if name == "amount" else "ab"[int(rng.integers(2))] if name in CATEGORICAL_FEATURES else float(rng.integers(4)) for name in FEATURES]
        for _ in range(rows)
    ]
    schema = ", ".join(f"{name} {'string' if name in CATEGORICAL_FEATURES else 'double'}" for name in FEATURES)
    return spark.createDataFrame(made, schema).repartition(3), np.array([row[0] for row in made])


def test_a_large_mean_costs_no_digits(spark):
    reference, left = sample(spark, 1500)
    current, right = sample(spark, 1500, shift=0.5, seed=2)
    row = drift.drift_features(reference, current).filter("feature = 'amount'").first()
    expected = np.abs(np.sort(left) - np.sort(right)).mean() / left.std()
    assert row["test"] == "wasserstein" and row["score"] == pytest.approx(expected, rel=1e-6)


def test_methods_and_switches_are_arguments(spark):
    reference, _ = sample(spark, 300)
    current, _ = sample(spark, 200, seed=3)

    def tests(**more):
        return {r["feature"]: (r["test"], r["threshold"]) for r in drift.drift_features(reference, current, **more).collect()}

    default = tests()
    assert default["amount"] == ("ks", 0.05) and default["channel"] == ("z", 0.05)
    assert tests(small_sample=100)["amount"] == ("wasserstein", 0.1)
    assert set(tests(method="jensen_shannon").values()) == {("jensen_shannon", 0.1)}
    chosen = tests(method={"amount": "wasserstein"}, few_values=3)
    assert chosen["amount"] == ("wasserstein", 0.1) and chosen["customer_age"] == ("ks", 0.05) and chosen["channel"] == default["channel"]
    for wrong in ("psi", {"amount": "psi"}, {"nothing": "ks"}):
        with pytest.raises(ValueError):
            drift.drift_features(reference, current, wrong)


def test_nulls_and_nothing_in_common(spark):
    reference, _ = sample(spark, 50)
    current = reference.withColumns({"channel": F.lit("new"), "amount": F.lit(None).cast("double")})
    found = {(r["feature"], r["test"]): r["statistic"] for r in drift.drift_statistics(reference, current).collect()}
    assert found[("channel", "chi_square")] == math.inf and found[("channel", "jensen_shannon")] == pytest.approx(math.sqrt(math.log(2)))
    assert found[("merchant_category", "jensen_shannon")] == 0.0 and found[("amount", "wasserstein")] is None
    row = drift.drift_features(reference, current).filter("feature = 'amount'").first()
    assert row["score"] is None and not row["drifted"] and row["current_rows"] == 0
    assert drift.drift_features(reference.limit(0), reference.limit(0)).count() == 0
