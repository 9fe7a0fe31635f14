"""The transparent heuristic score, used while no model is trained."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardtide.fixed_values import (
    HEURISTIC_CATEGORY_BOOST,
    HEURISTIC_INTERCEPT,
    HEURISTIC_KM_CAP,
    HEURISTIC_LOG_AMOUNT,
    HEURISTIC_NIGHT,
    HEURISTIC_PER_KM,
)
from cardtide.functions.features import lookup


def _terms() -> dict[str, Column]:
    return {
        "amount": F.lit(HEURISTIC_LOG_AMOUNT) * F.col("log_amount"),
        "distance_km": F.lit(HEURISTIC_PER_KM) * F.least(F.col("distance_km"), F.lit(HEURISTIC_KM_CAP)),
        "is_night": F.lit(HEURISTIC_NIGHT) * F.col("is_night"),
    }


def heuristic_probability() -> Column:
    boost = F.coalesce(lookup("merchant_category", HEURISTIC_CATEGORY_BOOST), F.lit(0.0))
    terms = _terms()
    logit = F.lit(HEURISTIC_INTERCEPT) + terms["amount"] + terms["distance_km"] + terms["is_night"] + boost
    return 1 / (1 + F.exp(-logit))


def contribution(feature: Column, value: Column, amount: Column) -> Column:
    return F.struct(
        feature.alias("feature"), value.cast("string").alias("value"), amount.alias("contribution")
    )


def heuristic_contributions() -> Column:
    """Three additive drivers. Half-even rounding."""
    terms = _terms()
    shown = {
        "amount": F.bround("amount", 2),
        "distance_km": F.bround("distance_km", 2),
        "is_night": F.col("is_night").cast("boolean"),
    }
    return F.array(
        *[contribution(F.lit(name), shown[name], F.bround(term, 4)) for name, term in terms.items()]
    )


def clamp(probability: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(probability, F.lit(low)), F.lit(high))
