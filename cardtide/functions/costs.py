"""Decisions and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardtide.fixed_values import (
    REACQUISITION_BY_BAND,
    VERIFY_ABANDON_RATE,
    VERIFY_CATCH_RATE,
    VERIFY_COST,
)
from cardtide.functions.features import lookup

MISSED_SHARE = 1 - VERIFY_CATCH_RATE


def friction(amount: str = "amount", margin: str = "order_margin_pct", band: str = "customer_ltv_band") -> Column:
    """What turning away a legitimate customer costs."""
    return F.col(amount) * F.col(margin) + lookup(band, REACQUISITION_BY_BAND)


def decide(probability: str, verify: str, decline: str) -> Column:
    """Both thresholds are inclusive; decline is tested first. Arguments are SQL expressions."""
    return F.expr(
        f"CASE WHEN {probability} >= {decline} THEN 'decline' WHEN {probability} >= {verify} THEN 'verify' "
        f"WHEN {probability} IS NOT NULL THEN 'approve' END"
    )


def expected_costs(probability: str, amount: str, friction_cost: str) -> dict[str, Column]:
    loss, legitimate = f"{probability} * {amount}", f"(1 - {probability}) * {friction_cost}"
    return {
        "approve": F.expr(loss),
        "verify": F.expr(
            f"{VERIFY_COST}D + {loss} * {MISSED_SHARE!r}D + {legitimate} * {VERIFY_ABANDON_RATE}D"
        ),
        "decline": F.expr(legitimate),
    }


def cost_if(fraud: str, amount: str, friction_cost: str) -> dict[str, str]:
    """SQL for the realized cost of each possible action once the label is known."""
    return {
        "approve": f"if({fraud}, {amount}, 0D)",
        "verify": f"{VERIFY_COST}D + if({fraud}, {amount} * {MISSED_SHARE!r}D, {friction_cost} * {VERIFY_ABANDON_RATE}D)",
        "decline": f"if({fraud}, 0D, {friction_cost})",
    }


def realized_cost(action: str, fraud: str, amount: str, friction_cost: str) -> Column:
    """NULL while the label is unknown; an action outside the three is an error."""
    branches = " ".join(
        f"WHEN {action} = '{name}' THEN {cost}" for name, cost in cost_if(fraud, amount, friction_cost).items()
    )
    return F.expr(
        f"CASE WHEN {fraud} IS NULL OR {action} IS NULL THEN NULL {branches} "
        f"ELSE CAST(raise_error(concat('unknown action: ', {action})) AS DOUBLE) END"
    )


def outcome_dollars(action: str, fraud: str, amount: str, friction_cost: str) -> dict[str, Column]:
    """Dollar outcome of a decision. An unknown label falls to the last branch, but verifying still costs."""
    caught, missed = f"{amount} * {VERIFY_CATCH_RATE}D", f"{amount} * {MISSED_SHARE!r}D"
    return {
        "fraud_caught_value": F.expr(
            f"CASE WHEN {fraud} AND {action} = 'decline' THEN {amount} "
            f"WHEN {fraud} AND {action} = 'verify' THEN {caught} ELSE 0D END"
        ),
        "fraud_missed_cost": F.expr(
            f"CASE WHEN {fraud} AND {action} = 'approve' THEN {amount} "
            f"WHEN {fraud} AND {action} = 'verify' THEN {missed} ELSE 0D END"
        ),
        "friction_cost": F.expr(
            f"CASE WHEN {action} = 'verify' "
            f"THEN {VERIFY_COST}D + if(NOT {fraud}, {friction_cost} * {VERIFY_ABANDON_RATE}D, 0D) "
            f"WHEN NOT {fraud} AND {action} = 'decline' THEN {friction_cost} ELSE 0D END"
        ),
        "normal_approval_value": F.expr(f"if(NOT {fraud} AND {action} = 'approve', {amount}, 0D)"),
    }


def whatif_verify(decline: float) -> float:
    """Verify threshold that belongs to a what-if decline threshold."""
    return max(0.01, min(decline * 0.55, decline - 0.01))


def to_numeric(value: Column, precision: int, scale: int) -> Column:
    """Cast a double to a table's decimal, half up on its decimal digits and not on binary noise."""
    return value.cast("decimal(28,8)").cast(f"decimal({precision},{scale})")


def count_at_or_below(value: str, cuts: list[float]) -> Column:
    """How many of the sorted cuts are <= value, as a balanced tree of comparisons."""

    def branch(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"if({value} >= {cuts[middle]!r}D, {branch(middle + 1, high)}, {branch(low, middle)})"

    return F.expr(branch(0, len(cuts)))


def double_array(values: list[float]) -> str:
    return "array(" + ", ".join(f"{value!r}D" for value in values) + ")"
