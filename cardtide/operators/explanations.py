"""Ranked drivers, template sentences and the stored explanation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.fixed_values import FEATURES
from cardtide.functions import text
from cardtide.functions.once import computed_once
from cardtide.sources.schemas import CONTRIBUTIONS_TYPE


def top_contributions(contributions: Column, limit: int = 6) -> Column:
    """Largest contributions by absolute value, descending."""
    keyed = F.transform(
        contributions, lambda item: F.struct((-F.abs(item["contribution"])).alias("by"), item.alias("item"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda pair: pair["item"])


def contributions_by_value(contributions: Column) -> Column:
    keyed = F.transform(contributions, lambda item: F.struct(item["contribution"].alias("by"), item.alias("item")))
    return F.transform(F.array_sort(keyed), lambda pair: pair["item"])


def with_risk_drivers(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Add ``drivers``: allow-listed features with display values, the strongest contribution each.

    Raising drivers come first and alone; lowering ones are used when none raises. Everything is a
    per-row array expression, so no row is shuffled or exploded.
    """
    def candidate(item: Column, position: Column) -> Column:
        amount = item["contribution"].cast("double")
        return F.struct(
            text.canonical_feature(item["feature"]).alias("feature"),
            F.bround(F.abs(amount), 4).alias("strength"),
            amount.alias("contribution"),
            position.alias("position"),
        )

    rows = computed_once(rows, {"_available": text.available_features(F.col("feature_snapshot"))})

    def usable(item: Column) -> Column:
        amount = item["contribution"]
        finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
        return F.coalesce(F.array_contains("_available", item["feature"]), F.lit(False)) & finite

    given = F.coalesce("explanation", F.array().cast(CONTRIBUTIONS_TYPE))
    rows = computed_once(rows, {"_items": F.filter(F.transform(given, candidate), usable)})
    items = F.col("_items")

    def strongest(item: Column) -> Column:
        return ~F.exists(
            items,
            lambda other: (other["feature"] == item["feature"])
            & (
                (other["strength"] > item["strength"])
                | ((other["strength"] == item["strength"]) & (other["position"] < item["position"]))
            ),
        )

    def keyed(item: Column) -> Column:
        first_seen = F.array_position(F.transform(items, lambda other: other["feature"]), item["feature"])
        return F.struct(
            (-item["strength"]).alias("by_strength"), first_seen.alias("by_first_seen"), item.alias("item")
        )

    ranked = F.transform(F.array_sort(F.transform(F.filter(items, strongest), keyed)), lambda pair: pair["item"])
    rows = computed_once(rows, {"_ranked": ranked})
    # Only what is chosen is put into words.
    shown = text.shown_values(F.col("feature_snapshot"))

    def shown_value(feature: Column) -> Column:
        found = None
        for name, value in shown.items():
            found = F.when(feature == name, value) if found is None else found.when(feature == name, value)
        return found

    raising = F.filter("_ranked", lambda item: item["contribution"] > 0)
    chosen = F.slice(F.when(F.size(raising) > 0, raising).otherwise(F.col("_ranked")), 1, limit)
    drivers = F.transform(
        chosen,
        lambda item: F.struct(
            item["feature"].alias("feature"),
            text.feature_label(item["feature"]).alias("label"),
            shown_value(item["feature"]).alias("value"),
            F.when(item["contribution"] > 0, "raised risk").otherwise("lowered risk").alias("effect"),
            item["strength"].alias("strength"),
        ),
    )
    return computed_once(rows, {"drivers": drivers}).drop("_available", "_items", "_ranked")


def template_explanations(rows: DataFrame) -> DataFrame:
    """Explanation texts of decision rows, checked against the sentence rules."""
    explained = with_risk_drivers(rows).withColumn(
        "explanation_text", text.tidy_sentence(text.sentence(F.col("decision"), F.col("drivers")))
    )
    return explained.withColumn("sentence_problem", text.sentence_problem(F.col("explanation_text")))


def explanation_inputs(rows: DataFrame) -> DataFrame:
    """Allow-listed facts for an external writer, as JSON; no free text from the source gets in."""
    category = text.shown_values(F.struct(*[F.col(f"feature_snapshot.{name}") for name in FEATURES]))
    drivers = with_risk_drivers(rows)
    record = F.struct(
        F.struct(
            F.bround(F.col("amount").cast("double"), 2).alias("amount_usd"),
            category["merchant_category"].alias("merchant_category"),
            F.bround(F.col("fraud_probability").cast("double") * 100, 1).alias("risk_percent"),
            F.lower("decision").alias("decision"),
        ).alias("transaction"),
        F.col("drivers").alias("top_risk_drivers"),
    )
    return drivers.select("transaction_id", F.to_json(record).alias("explanation_input"))


def reusable_text(source: str = "template", model: str | None = None, prefix: str = "") -> Column:
    """Whether a stored text may be shown: a template text may not if another source is wanted, unless it was written
    for the wanted model."""
    text = F.col(f"{prefix}explanation_text")
    usable = F.coalesce(text != "", F.lit(False))
    if source != "template":
        same_model = F.coalesce(F.col(f"{prefix}explanation_model") == F.lit(model), F.lit(False))
        usable = usable & (F.coalesce(F.col(f"{prefix}explanation_source") != "template", F.lit(False)) | same_model)
    return usable


def missing_explanations(
    decisions: DataFrame,
    stored: DataFrame,
    now: Column,
    source: str = "template",
    model: str | None = None,
    force: bool = False,
) -> DataFrame:
    """New explanation rows for transactions whose stored text may not be reused.

    A stored text is reused unless ``force`` is set or ``reusable_text`` says no.
    """
    todo = decisions
    if not force:
        reusable = stored.filter(reusable_text(source, model)).select("transaction_id", "model_version").distinct()
        todo = decisions.join(reusable, ["transaction_id", "model_version"], "left_anti")
    return template_explanations(todo).select(
        "transaction_id",
        "model_version",
        "explanation_text",
        F.lit("template").alias("explanation_source"),
        F.lit(None).cast("string").alias("explanation_model"),
        now.cast("timestamp").alias("explanation_generated_at"),
    )
