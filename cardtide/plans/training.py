"""Train, calibrate, choose thresholds, evaluate, save and load."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cardtide.fixed_values import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES
from cardtide.functions.scoring import clamp
from cardtide.operators import evaluation, isotonic, thresholds
from cardtide.plans import boosting, decisions, margins
from cardtide.session import checkpointed, ensure_checkpoint_dir

# Boosting settings. Columns are drawn per tree; a child has at least this much hessian.
ROUNDS = 350
DEPTH = 6
LEARNING_RATE = 0.06
ROW_SHARE = 0.85
COLUMN_SHARE = 0.85
MIN_CHILD_HESSIAN = 3.0
L2_TERM = 2.0
SEED = 42

FINAL_TEST = "final_test"
BUNDLE_FORMAT = 1
# At most one entry per merchant category.
THRESHOLD_SCHEMA = (
    "merchant_category string, verify double, decline double, validation_cost double, "
    "validation_rows bigint, validation_fraud_rows bigint, fallback string"
)


class BundleError(ValueError):
    pass


@dataclass
class ModelBundle:
    """Everything needed to score: pipeline, calibrator, thresholds."""

    pipeline: PipelineModel
    calibrator: IsotonicRegressionModel
    category_thresholds: list[dict]
    global_thresholds: dict[str, float]
    model_version: str
    feature_names: list[str]
    model_features: list[str] = field(default_factory=lambda: list(FEATURES))
    #: Broadcast contribution tables, beside the application that holds them; see ``contributions.shared_tables``.
    tables: tuple | None = field(default=None, repr=False, compare=False)
    #: Broadcast trees in the same way; see ``margins.shared_trees``.
    walked: tuple | None = field(default=None, repr=False, compare=False)

    def raw_scores(self, featured: DataFrame) -> DataFrame:
        """Uncalibrated probability, beside the transformed feature vector."""
        vectors = PipelineModel(stages=self.pipeline.stages[:-1]).transform(featured)
        raw = vectors.withColumn("raw_probability", margins.raw_probability(self, featured.sparkSession))
        return raw.drop("_numbers", "_scaled", *_index_columns(), *_onehot_columns())

    def calibrated(self, raw: DataFrame) -> DataFrame:
        score = raw.withColumn("score", F.col("raw_probability"))
        return (
            self.calibrator.transform(score)
            .withColumn("fraud_probability", clamp(F.col("_calibrated")))
            .drop("score", "_calibrated")
        )

    def threshold_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.category_thresholds, THRESHOLD_SCHEMA)

    def decide(self, featured: DataFrame, explain: bool = False) -> DataFrame:
        """Score a table or a stream: probability, drivers, thresholds, decision, dollars."""
        raw = self.raw_scores(featured)
        if explain:
            from cardtide.plans.contributions import with_contributions

            # A score does not wait for its explanation; the decision stream counts rows without one.
            raw = with_contributions(raw, self, tolerant=True)
        else:
            raw = raw.withColumn(
                "explanation", F.array().cast("array<struct<feature:string,value:string,contribution:double>>")
            )
        scored = self.calibrated(raw).withColumn("model_version", F.lit(self.model_version))
        scored = scored.drop("features", "raw_probability")
        verify, decline = self.global_thresholds["verify"], self.global_thresholds["decline"]
        table = self.threshold_table(featured.sparkSession)
        return decisions.with_decisions(
            decisions.with_thresholds(scored, table, verify, decline), verify, decline
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        self.threshold_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/thresholds")
        facts = {
            "bundle_format": BUNDLE_FORMAT,
            "model_version": self.model_version,
            "feature_names": self.feature_names,
            "model_features": self.model_features,
            "global_thresholds": self.global_thresholds,
        }
        write_json_row(spark, facts, f"{path}/facts")


def content_version(bundle: ModelBundle) -> str:
    """Version that differs whenever scores or decisions can: a hash of preprocessing, trees, calibration, thresholds."""
    scaler, booster = bundle.pipeline.stages[3], bundle.pipeline.stages[-1]
    # The first line of the description names the training run, not the trees.
    trees = booster.toDebugString.split("\n", 1)[1]
    parts = [
        bundle.feature_names,
        list(scaler.mean),
        list(scaler.std),
        trees,
        list(booster.treeWeights),
        list(bundle.calibrator.boundaries),
        list(bundle.calibrator.predictions),
        bundle.global_thresholds,
        sorted(bundle.category_thresholds, key=lambda row: row["merchant_category"]),
    ]
    return f"gbt-calibrated-{hashlib.sha256(repr(parts).encode()).hexdigest()[:16]}"


def write_json_row(spark: SparkSession, facts: dict, path: str) -> None:
    """One small JSON document on the shared file system."""
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _index_columns() -> list[str]:
    return [f"_index_{name}" for name in CATEGORICAL_FEATURES]


def _onehot_columns() -> list[str]:
    return [f"_onehot_{name}" for name in CATEGORICAL_FEATURES]


def preprocessing_stages() -> list:
    """Standardised numbers, one-hot categories; an unseen category is all zeros.

    The indexer keeps unseen values under a last index and the encoder drops the last index, so
    every seen category has its own slot and an unseen one has none.
    """
    return [
        StringIndexer(
            inputCols=CATEGORICAL_FEATURES,
            outputCols=_index_columns(),
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=_index_columns(), outputCols=_onehot_columns(), dropLast=True),
        VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *_onehot_columns()], outputCol="features"),
    ]


def feature_names(pipeline: PipelineModel) -> list[str]:
    labels = pipeline.stages[0].labelsArray
    return NUMERIC_FEATURES + [
        f"{name}_{value}" for name, values in zip(CATEGORICAL_FEATURES, labels, strict=True) for value in values
    ]


def labelled_training_rows(rows: DataFrame, salt: str) -> DataFrame:
    """Training frame of all labelled card rows, including those outside the event contract."""
    return decisions.training_frame(rows.filter("is_fraud IS NOT NULL"), salt).withColumn(
        "fraud_label", F.col("is_fraud").cast("boolean")
    )


def fit_booster(train: DataFrame, rounds: int, depth: int = DEPTH) -> PipelineModel:
    """Boosted trees on class-weighted rows."""
    ensure_checkpoint_dir(train.sparkSession)
    weight = evaluation.positive_class_weight(train).first()["positive_weight"]
    weighted = train.withColumns(
        {
            "_label": F.col("is_fraud").cast("double"),
            "_weight": F.when(F.col("is_fraud") == 1, F.lit(float(weight))).otherwise(1.0),
        }
    )
    stages = Pipeline(stages=preprocessing_stages()).fit(weighted)
    # Stored, as binning and every level read it.
    prepared = checkpointed(stages.transform(weighted).select("features", "_label", "_weight"))
    settings = boosting.Settings(rounds, depth, LEARNING_RATE, ROW_SHARE, COLUMN_SHARE, MIN_CHILD_HESSIAN, L2_TERM, SEED)
    booster = boosting.fit(prepared, "features", "_label", "_weight", settings)
    return PipelineModel(stages=[*stages.stages, booster])


def fit_calibrator(scored: DataFrame, score: str, label: str) -> IsotonicRegressionModel:
    """Isotonic regression on one weighted row per distinct score, constant outside the range.

    Equal scores are combined first, and violators are pooled range by range (``operators.isotonic``). Spark's model gets
    the ends of the finished blocks, in which nothing is left to pool.
    """
    points = scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(label).alias("weight")
    )
    return IsotonicRegression(
        featuresCol="score", labelCol="mean", weightCol="weight", predictionCol="_calibrated", isotonic=True
    ).fit(isotonic.block_ends(isotonic.pooled_blocks(points)))


def calibration_table(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with their calibrated probability."""
    model = fit_calibrator(scored, score, label)
    distinct = scored.select(F.col(score).cast("double").alias("score")).distinct()
    return model.transform(distinct).select("score", clamp(F.col("_calibrated")).alias("calibrated"))


@dataclass
class TrainingResult:
    bundle: ModelBundle
    metrics: DataFrame | None
    windows: DataFrame
    metadata: dict


def train(
    rows: DataFrame,
    test_rows: DataFrame | None = None,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    model_version: str | None = None,
    evaluate: bool = True,
) -> TrainingResult:
    """Windows in time order, fit on the first, calibrate on the second, choose thresholds on the third.

    ``rows`` is a frame of ``labelled_training_rows``. ``test_rows`` is an independent later frame. Without
    ``model_version`` the version is ``content_version``, so that a new model's scores are new messages.
    """
    # Written once: every later step reads the same windows without recomputing features.
    windowed = checkpointed(evaluation.with_windows(rows))
    metadata = evaluation.window_metadata(windowed)
    evaluation.require_both_classes(metadata)
    if test_rows is not None:
        test_rows = checkpointed(test_rows.withColumn("window", F.lit(FINAL_TEST)))
        test_metadata = evaluation.window_metadata(test_rows)
        evaluation.require_both_classes(test_metadata, [FINAL_TEST])
        metadata = metadata.unionByName(test_metadata)

    def window(name: str) -> DataFrame:
        return windowed.filter(F.col("window") == name)

    # Every round passes over these rows several times, so they are dealt evenly once, whatever the input's splits are.
    # Their order is fixed, so that a repeated task draws the same row samples.
    dealt = window("train").repartition(F.monotonically_increasing_id()).sortWithinPartitions("event_time", "transaction_id")
    pipeline = fit_booster(checkpointed(dealt), rounds, depth)
    bundle = ModelBundle(pipeline, None, [], {}, model_version or "", feature_names(pipeline))
    held_out = windowed.filter(F.col("window") != "train")
    if test_rows is not None:
        held_out = held_out.unionByName(test_rows)
    raw = checkpointed(bundle.raw_scores(held_out).drop("features"))
    bundle.calibrator = fit_calibrator(raw.filter("window = 'calibration'"), "raw_probability", "is_fraud")
    calibrated = checkpointed(bundle.calibrated(raw))

    validation = calibrated.filter("window = 'threshold_validation'")
    overall = thresholds.optimal_global(validation).first()
    bundle.global_thresholds = {"verify": overall["verify"], "decline": overall["decline"]}
    # One row per merchant category.
    bundle.category_thresholds = [
        row.asDict() for row in thresholds.optimal_by_category(validation).collect()
    ]
    bundle.model_version = model_version or content_version(bundle)
    check_bundle(bundle)
    metrics = evaluation_table(calibrated, bundle) if evaluate else None
    facts = {
        "model_version": bundle.model_version,
        "global_thresholds": bundle.global_thresholds,
        "global_threshold_validation_cost": round(overall["validation_cost"], 2),
        "category_thresholds": {
            row["merchant_category"]: {k: v for k, v in row.items() if k != "merchant_category" and v is not None}
            for row in bundle.category_thresholds
        },
        "feature_names": bundle.feature_names,
        "split_strategy": "time ordered: first 70% train, next 15% calibration, last 15% threshold validation",
        "calibration_method": "isotonic",
    }
    return TrainingResult(bundle, metrics, metadata, facts)


def evaluation_table(calibrated: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Probability metrics per window, before and after calibration, and what the policy costs."""
    names = [row["window"] for row in calibrated.select("window").distinct().orderBy("window").collect()]
    table, verify, decline = bundle.threshold_table(calibrated.sparkSession), *bundle.global_thresholds.values()
    result = None
    for name in names:
        rows = calibrated.filter(F.col("window") == name)
        versions = {"calibrated": "fraud_probability"}
        if name == "calibration":
            versions["raw"] = "raw_probability"
        for version, column in versions.items():
            line = evaluation.probability_metrics(rows, "fraud_label", column)
            if version == "calibrated" and name != "calibration":
                chosen = decisions.with_thresholds(rows, table, verify, decline)
                decided = chosen.withColumn(
                    "decision",
                    decisions.costs.decide("fraud_probability", "verify_threshold", "decline_threshold"),
                )
                line = _beside(line, evaluation.policy_metrics(decided))
            line = line.select(F.lit(name).alias("window"), F.lit(version).alias("version"), "*")
            result = line if result is None else result.unionByName(line, allowMissingColumns=True)
    return result


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two one-row aggregates in one row."""
    packed = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_right", packed).select("*", "_right.*").drop("_right")


def save_result(result: TrainingResult, path: str) -> None:
    """Model bundle, window table, metrics and metadata under one folder."""
    result.bundle.save(f"{path}/bundle")
    spark = result.windows.sparkSession
    result.windows.coalesce(1).write.mode("overwrite").parquet(f"{path}/windows")
    if result.metrics is not None:
        result.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    write_json_row(spark, result.metadata, f"{path}/metadata")


def check_bundle(bundle: ModelBundle) -> None:
    def bad(pair: dict) -> bool:
        try:
            return not 0 <= float(pair["verify"]) < float(pair["decline"]) <= 1
        except (KeyError, TypeError, ValueError):
            return True

    if bundle.calibrator is None or bundle.pipeline is None:
        raise BundleError("bundle lacks a model or a calibrator")
    if not bundle.feature_names or not bundle.model_features or not bundle.model_version:
        raise BundleError("bundle lacks feature names, model features or a version")
    if bad(bundle.global_thresholds):
        raise BundleError("global thresholds are invalid")
    wrong = [row.get("merchant_category") for row in bundle.category_thresholds if bad(row)]
    if wrong:
        raise BundleError(f"thresholds are invalid for {wrong}")


REQUIRED_FACTS = {"bundle_format", "model_version", "feature_names", "model_features", "global_thresholds"}


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    missing = sorted(REQUIRED_FACTS - set(facts))
    if missing:
        raise BundleError(f"bundle is missing {missing}")
    if facts["bundle_format"] != BUNDLE_FORMAT:
        raise BundleError(f"unsupported bundle format {facts['bundle_format']}")
    rows = spark.read.schema(THRESHOLD_SCHEMA).parquet(f"{path}/thresholds").collect()
    bundle = ModelBundle(
        PipelineModel.load(f"{path}/pipeline"),
        IsotonicRegressionModel.load(f"{path}/calibrator"),
        [row.asDict() for row in rows],
        facts["global_thresholds"],
        facts["model_version"],
        facts["feature_names"],
        facts["model_features"],
    )
    check_bundle(bundle)
    return bundle


def load_or_keep(spark: SparkSession, path: str, current: ModelBundle | None) -> ModelBundle | None:
    """A bundle that cannot be loaded leaves the last good one in place."""
    try:
        return load_bundle(spark, path)
    except Exception as error:  # noqa: BLE001 - any defect of a new bundle keeps the old one
        print(f"model bundle at {path} was not loaded: {type(error).__name__}")
        return current


