"""Feature drift between a reference and a current sample, and the model's health."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardtide.fixed_values import (
    CATEGORICAL_FEATURES,
    DRIFT_DISTANCE_LIMIT,
    DRIFT_FEW_VALUES,
    DRIFT_HEALTH_MAX_AGE_SECONDS,
    DRIFT_MIN_ROWS,
    DRIFT_P_LIMIT,
    DRIFT_SHARE,
    DRIFT_SMALL_SAMPLE,
    FEATURES,
    NUMERIC_FEATURES,
)
from cardtide.operators.ordered import first_rows, running_totals
from cardtide.session import checkpointed
from cardtide.sources.schemas import SNAPSHOT_TYPE


def latest_snapshots(decisions: DataFrame, rows: int | None = None) -> DataFrame:
    """Non-empty feature snapshots; with ``rows``, the newest of them."""
    found = decisions.filter(F.col("feature_snapshot").isNotNull()).select(
        "transaction_id", "processed_at", "feature_snapshot"
    )
    if rows is not None:
        found = first_rows(found, rows, "processed_at", "transaction_id", newest=True)
    return found.select("processed_at", "feature_snapshot.*")


def snapshots_from_json(rows: DataFrame, column: str = "feature_snapshot") -> DataFrame:
    """Snapshots kept as JSON text: absent features become NULL, empty snapshots are left out."""
    return rows.filter(F.col(column).isNotNull() & (F.col(column) != "{}")).withColumn(
        column, F.from_json(column, SNAPSHOT_TYPE)
    )


def snapshot_window(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.min("processed_at").alias("current_window_start"), F.max("processed_at").alias("current_window_end")
    )


def shifted(features: DataFrame) -> DataFrame:
    """A controlled shift that a drift monitor must notice."""
    amount = F.col("amount").cast("double") * 25 + 1000
    return features.withColumns(
        {
            "amount": amount,
            "log_amount": F.log1p(amount),
            "distance_km": F.col("distance_km").cast("double") + 5000,
            "transaction_hour": (F.col("transaction_hour").cast("double") + 12) % 24,
            "city_population": F.col("city_population").cast("double") * 50 + 1_000_000,
            "merchant_category": F.lit("shifted_demo_category"),
            "channel": F.lit("shifted_demo_channel"),
            "customer_ltv_band": F.lit("shifted_demo_band"),
        }
    )


_COUNTS = "feature string, number double, word string, reference_n bigint, current_n bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each feature and how often each side has them, column by column of a batch. The last column is the side."""
    kinds = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
    names = [part.split(" ")[0] for part in _COUNTS.split(", ")]
    for batch in batches:
        sides = batch.column(batch.num_columns - 1)
        for feature, column in zip(batch.schema.names[:-1], batch.columns[:-1]):
            for k, side in enumerate((sides, pc.invert(sides))):
                found = column.filter(side).drop_null().value_counts()
                if not len(found):
                    continue
                values, counts = found.field(0), found.field(1)
                empty = pa.nulls(len(found), kinds[1 + (feature in NUMERIC_FEATURES)])
                zeros = pa.array(np.zeros(len(found), np.int64))
                both = [values, empty] if feature in NUMERIC_FEATURES else [empty, values]
                columns = [pa.array([feature] * len(found)), *both, *([counts, zeros] if k == 0 else [zeros, counts])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names)


def _value_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row per feature and different value. Both sides are one tagged scan, counted batch by batch where it is read, so
    only different values are shuffled and no row is multiplied by the number of features."""

    def side(rows: DataFrame, is_reference: bool) -> DataFrame:
        cells = [F.col(name).cast("double" if name in NUMERIC_FEATURES else "string").alias(name) for name in FEATURES]
        return rows.select(*cells, F.lit(is_reference).alias("_side"))

    tagged = side(reference, True).unionByName(side(current, False))
    return tagged.mapInArrow(_counted, _COUNTS).groupBy("feature", "number", "word").agg(
        F.sum("reference_n").alias("reference_n"), F.sum("current_n").alias("current_n")
    )


def _totals(counts: DataFrame) -> DataFrame:
    """Per feature: row counts, the reference's mean and the number of different values."""
    n = F.col("reference_n")
    return (
        counts.groupBy("feature")
        .agg(
            F.sum(n).alias("reference_rows"),
            F.sum("current_n").alias("current_rows"),
            F.count_if((n > 0) | (F.col("current_n") > 0)).alias("all_values"),
            F.sum(n * F.col("number")).alias("_sum"),
        )
        .withColumn("reference_mean", F.try_divide(F.col("_sum"), F.col("reference_rows")))
        .drop("_sum")
    )


def _value_distances(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm), chi-square statistic and the reference's spread over distinct values."""
    # A side without any value of the feature has no shares, and the feature no distances.
    p = F.try_divide("reference_n", "reference_rows")
    q = F.try_divide("current_n", "current_rows")
    middle = (p + q) / 2

    def term(share: Column) -> Column:
        return F.when(share > 0, share * F.log(share / middle)).otherwise(0.0)

    expected = p * F.col("current_rows")
    surprise = F.when(F.col("reference_n") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.pow(F.col("current_n") - expected, 2), expected)
    )
    key = F.struct("number", "word")
    return (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            F.sqrt(F.when(F.sum(term(p) / 2 + term(q) / 2) < 0, 0.0).otherwise(F.sum(term(p) / 2 + term(q) / 2))).alias("js_distance"),
            F.sum(surprise).alias("chi_square"),
            F.max_by(p, key).alias("reference_share"),
            F.max_by(q, key).alias("current_share"),
            # From centred values, so that a large mean costs no digits.
            F.sqrt(F.sum(p * F.pow(F.col("number") - F.col("reference_mean"), 2))).alias("reference_stddev"),
        )
    )


def _cumulative_distances(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Wasserstein and Kolmogorov-Smirnov distances from cumulative shares over distinct values."""
    numeric = counts.filter(F.col("number").isNotNull()).select("feature", "number", "reference_n", "current_n")
    ordered = running_totals(
        numeric, "number", ["reference_n", "current_n"], by=["feature"], previous="previous_number"
    )
    p_before = F.try_divide("reference_n_before", "reference_rows")
    q_before = F.try_divide("current_n_before", "current_rows")
    p_at = F.try_divide(F.col("reference_n_before") + F.col("reference_n"), F.col("reference_rows"))
    q_at = F.try_divide(F.col("current_n_before") + F.col("current_n"), F.col("current_rows"))
    # Between the previous value and this one both shares are constant.
    step = F.abs(p_before - q_before) * (F.col("number") - F.col("previous_number"))
    return (
        ordered.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            # One value alone has no step.
            F.when((F.min("reference_rows") > 0) & (F.min("current_rows") > 0), F.coalesce(F.sum(step), F.lit(0.0))).alias("wasserstein"),
            F.max(F.abs(p_at - q_at)).alias("ks_distance"),
        )
    )


@F.pandas_udf(T.DoubleType())
def _p_value(test, statistic, reference_rows, current_rows, values):  # type: ignore[no-untyped-def]
    """Tail probabilities that SQL functions lack; called on one row per feature."""
    import pandas as pd

    def kolmogorov(distance, n):
        root = math.sqrt(n)
        z = (root + 0.12 + 0.11 / root) * distance
        if z < 0.2:
            return 1.0
        return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))

    def chi_square_tail(x, degrees):
        if math.isinf(x):
            return 0.0
        half, a = x / 2, 0.5 if degrees % 2 else 1.0
        tail = math.erfc(math.sqrt(half)) if degrees % 2 else math.exp(-half)
        while a < degrees / 2:
            tail += half**a * math.exp(-half) / math.gamma(a + 1)
            a += 1
        return tail

    def tail(name, x, left, right, k):
        if x is None or math.isnan(x):
            return None
        if name == "ks":
            return kolmogorov(x, left * right / (left + right))
        if name == "chi_square":
            return 1.0 if k < 2 else chi_square_tail(x, int(k) - 1)
        if name == "z":
            return math.erfc(abs(x) / math.sqrt(2))
        return None

    rows = zip(test, statistic, reference_rows, current_rows, values, strict=True)
    return pd.Series([tail(*row) for row in rows], dtype="float64")


DISTANCES = ("wasserstein", "jensen_shannon")
TESTS = (*DISTANCES, "ks", "chi_square", "z")


def _compared(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row per feature with every statistic that it has."""
    counts = checkpointed(_value_counts(reference, current))
    # Twelve rows: one per feature.
    totals = _totals(counts)
    table = (
        totals.join(F.broadcast(_value_distances(counts, totals)), "feature")
        .join(F.broadcast(_cumulative_distances(counts, totals)), "feature", "left")
    )
    rows = F.col("reference_rows") + F.col("current_rows")
    pooled = (F.col("reference_share") * F.col("reference_rows") + F.col("current_share") * F.col("current_rows")) / rows
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "reference_rows") + F.try_divide(F.lit(1), "current_rows")))
    two_shares = F.coalesce(F.try_divide(F.col("reference_share") - F.col("current_share"), spread), F.lit(0.0))
    return table.withColumns(
        {
            "_wasserstein": F.col("wasserstein") / F.greatest("reference_stddev", F.lit(0.001)),
            "_jensen_shannon": F.col("js_distance"),
            "_ks": F.col("ks_distance"),
            "_chi_square": F.col("chi_square"),
            "_z": F.when(F.col("all_values") <= 2, two_shares),
        }
    )


def drift_statistics(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Every statistic of every feature it fits: distances between distributions for numbers, between shares for words and
    for numbers of few values, the two-share z for at most two values."""
    table = _compared(reference, current)
    number = F.col("feature").isin(NUMERIC_FEATURES)
    few = ~number | (F.col("all_values") <= DRIFT_FEW_VALUES)
    fits = {"wasserstein": number, "ks": number, "jensen_shannon": few, "chi_square": few, "z": F.col("all_values") <= 2}
    listed = F.array(*[F.when(fits[name], F.struct(F.lit(name).alias("test"), F.col(f"_{name}").alias("statistic"))) for name in TESTS])
    return table.select("feature", F.inline(F.array_compact(listed)))


def drift_features(
    reference: DataFrame,
    current: DataFrame,
    method: str | dict[str, str] | None = None,
    small_sample: int = DRIFT_SMALL_SAMPLE,
    few_values: int = DRIFT_FEW_VALUES,
) -> DataFrame:
    """One row per feature: its test, the test's score and the verdict.

    ``method`` names the test for all features or for each; features without one get the published default. With more than
    ``small_sample`` reference rows that is the Wasserstein distance over the reference's standard deviation for numbers
    of more than ``few_values`` values, else the Jensen-Shannon distance; drift at 0.1. With fewer rows it is
    Kolmogorov-Smirnov, chi-square or two-proportion z; drift below p = 0.05. The Kolmogorov p-value is the asymptotic one.
    """
    wanted = {name: method for name in FEATURES} if isinstance(method, str) else dict(method or {})
    unknown = sorted(set(wanted.values()) - set(TESTS)) + sorted(set(wanted) - set(FEATURES))
    if unknown:
        raise ValueError(f"unknown drift methods or features: {unknown}")
    table = _compared(reference, current)
    large = F.col("reference_rows") > small_sample
    ordinal = F.col("feature").isin(NUMERIC_FEATURES) & (F.col("all_values") > few_values)
    test = (
        F.when(large & ordinal, "wasserstein")
        .when(large, "jensen_shannon")
        .when(ordinal, "ks")
        .when(F.col("all_values") > 2, "chi_square")
        .otherwise("z")
    )
    for name, chosen in wanted.items():
        test = F.when(F.col("feature") == name, chosen).otherwise(test)
    table = table.withColumn("test", test)
    statistic = F.coalesce(*[F.when(F.col("test") == name, F.col(f"_{name}")) for name in TESTS])
    scored = table.withColumn("_statistic", statistic)
    distance = F.col("test").isin(*DISTANCES)
    p_value = _p_value("test", "_statistic", "reference_rows", "current_rows", "all_values")
    return (
        scored.withColumn("score", F.when(distance, F.col("_statistic")).otherwise(p_value))
        .withColumns(
            {
                "threshold": F.when(distance, F.lit(DRIFT_DISTANCE_LIMIT)).otherwise(F.lit(DRIFT_P_LIMIT)),
                "drifted": F.coalesce(
                    F.when(distance, F.col("score") >= DRIFT_DISTANCE_LIMIT).otherwise(F.col("score") < DRIFT_P_LIMIT),
                    F.lit(False),
                ),
            }
        )
        .select("feature", "test", "score", "threshold", "drifted", "reference_rows", "current_rows")
    )


def health_status(share: Column, limit: float = DRIFT_SHARE) -> Column:
    return F.when(share >= limit, "drifting").otherwise("ok")


def drift_summary(features: DataFrame, limit: float = DRIFT_SHARE) -> DataFrame:
    summary = features.agg(
        F.count_if("drifted").cast("int").alias("drifted_features"),
        F.count("*").cast("int").alias("total_features"),
    ).withColumn("drift_share", F.try_divide(F.col("drifted_features"), F.col("total_features")))
    return summary.withColumn("health_status", health_status(F.col("drift_share"), limit))


def has_enough_rows(current: DataFrame, needed: int = DRIFT_MIN_ROWS) -> bool:
    """Looks at ``needed`` rows at most."""
    return current.limit(needed).count() >= needed


def model_health(reports: DataFrame, now: Column, max_age: int = DRIFT_HEALTH_MAX_AGE_SECONDS) -> DataFrame:
    """Latest drift report with its age; a report that is too old counts as stale.

    Reports of one instant are told apart by their other columns, so that the choice is always the same.
    """
    others = [F.col(name).desc() for name in reports.columns if name != "generated_at"]
    latest = reports.orderBy(F.col("generated_at").desc(), *others).limit(1)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("generated_at")) / F.lit(1e6)
    return latest.withColumn("age_seconds", F.greatest(age, F.lit(0.0))).withColumns(
        {
            "is_stale": F.col("age_seconds") > max_age,
            "effective_health_status": F.when(F.col("age_seconds") > max_age, "stale").otherwise(
                F.col("health_status")
            ),
        }
    )
