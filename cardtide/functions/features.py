"""From raw card fields to event fields and model features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardtide.fixed_values import BANDS, EARTH_RADIUS_KM, FEATURES, MARGIN_BY_CATEGORY


def lookup(key: str, table: dict[str, float]) -> Column:
    """Value of a small fixed table for the key column, NULL for an unknown key."""
    branches = " ".join(f"WHEN '{name}' THEN {value!r}D" for name, value in table.items())
    return F.expr(f"CASE {key} {branches} END")


def pseudonym(identifier: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), identifier.cast("string")), 256)


def ltv_band(pseudonym_hex: Column) -> Column:
    """Stable value band: the first 32 bits of the pseudonym, modulo 100."""
    share = F.conv(F.substring(pseudonym_hex, 1, 8), 16, 10).cast("long") % 100
    low, medium, high = BANDS
    return F.when(share < 50, low).when(share < 85, medium).when(share.isNotNull(), high)


def merchant_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "^fraud_", "")


def channel(category: Column) -> Column:
    remote = category.endswith("_net") | (category == "travel")
    return F.when(remote, "card_not_present").when(category.isNotNull(), "card_present")


def margin(category: str) -> Column:
    return lookup(category, MARGIN_BY_CATEGORY)


def age_in_years(birth: str, at: str) -> Column:
    """Completed years: one less before the birthday of that year."""
    return F.expr(
        f"year({at}) - year({birth}) - int(month({at}) < month({birth}) "
        f"OR (month({at}) = month({birth}) AND day({at}) < day({birth})))"
    )


def distance_km(lat1: str, long1: str, lat2: str, long2: str) -> Column:
    """Great-circle distance. The half-chord is clipped so that antipodes stay finite."""
    half_lat, half_long = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({long2} - {long1}) / 2)"
    chord = F.expr(
        f"least(greatest({half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* {half_long} * {half_long}, 0D), 1D)"
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def is_night(at: Column) -> Column:
    return ((F.hour(at) < 6) | (F.hour(at) >= 22)).cast("int")


def model_feature_columns() -> dict[str, Column]:
    """The features that an event does not carry yet; the rest pass through by name."""
    at = F.col("event_time")
    return {
        "log_amount": F.log1p("amount"),
        "distance_km": distance_km("customer_lat", "customer_long", "merchant_lat", "merchant_long"),
        "transaction_hour": F.hour(at),
        "transaction_day_of_week": F.weekday(at),
        "is_night": is_night(at),
    }


def feature_snapshot() -> Column:
    return F.struct(*FEATURES)
