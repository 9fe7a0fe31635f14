"""What-if totals, threshold sweeps and the cost-optimal threshold pair.

A decision depends only on how the probability compares with the candidate thresholds. So rows are
reduced once to sums per interval between neighbouring candidates, and every candidate is then
evaluated on those few sums instead of on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardtide.fixed_values import DECLINE_GRID, MIN_SEGMENT_FRAUD, SWEEP_DECLINES, VERIFY_GRID
from cardtide.functions import costs

MONEY = "decimal(38,6)"


def _interval_sums(rows: DataFrame, cuts: list[float], by: list[str]) -> DataFrame:
    """Counts and dollar sums per interval: the only pass over the rows."""
    each = costs.cost_if("fraud_label", "amount", "_friction")

    def money(value: str, name: str) -> Column:
        # Exact decimal sums do not depend on the order in which partitions arrive.
        return F.expr(f"CAST(sum(CAST({value} AS {MONEY})) AS {MONEY})").alias(name)

    return (
        rows.filter("fraud_label IS NOT NULL AND fraud_probability IS NOT NULL")
        .withColumns({"_friction": costs.friction(), "interval": costs.count_at_or_below("fraud_probability", cuts)})
        .groupBy(*by, "interval")
        .agg(
            F.count("*").alias("row_count"),
            F.count_if("fraud_label").alias("fraud_rows"),
            money(each["approve"], "approve_cost"),
            money(each["verify"], "verify_cost"),
            money(each["decline"], "decline_cost"),
            money("if(fraud_label, amount, 0D)", "fraud_amount"),
            money("if(fraud_label, 0D, amount)", "legit_amount"),
            money("if(fraud_label, 0D, _friction)", "legit_friction"),
        )
    )


WHATIF_COLUMNS = [
    "decline_threshold",
    "verify_threshold",
    "total_cost",
    "approve_count",
    "verify_count",
    "decline_count",
    "false_declines",
    "fraud_intervened",
    "fraud_caught_value",
    "fraud_missed_cost",
    "friction_cost",
    "normal_approval_value",
]


def threshold_sweep(rows: DataFrame, declines: list[float] = SWEEP_DECLINES) -> DataFrame:
    """What-if totals for each decline threshold, with its verify threshold derived from it.

    An empty input gives zeros.
    """
    pairs = [(float(decline), costs.whatif_verify(float(decline))) for decline in declines]
    cuts = sorted({value for pair in pairs for value in pair})
    sums = _interval_sums(rows, cuts, [])
    # A literal of one entry per requested threshold: interval bounds of verify and decline.
    entries = ", ".join(
        f"named_struct('decline_threshold', {decline!r}D, 'verify_threshold', {verify!r}D, "
        f"'verify_from', {cuts.index(verify)}, 'decline_from', {cuts.index(decline)})"
        for decline, verify in pairs
    )
    sweep = F.expr(f"array({entries})")
    # One row that holds at most two intervals per threshold, unfolded against the literal grid.
    intervals = sums.agg(F.collect_list(F.struct(*sums.columns)).alias("_intervals"))
    joined = intervals.select("_intervals", F.inline(sweep)).select(
        "decline_threshold", "verify_threshold", "verify_from", "decline_from", F.inline_outer("_intervals")
    )
    joined = joined.withColumn(
        "action",
        F.expr(
            "CASE WHEN interval > decline_from THEN 'decline' WHEN interval > verify_from THEN 'verify' "
            "WHEN interval IS NOT NULL THEN 'approve' END"
        ),
    )

    def total(parts: dict[str, str], name: str, kind: str) -> Column:
        branches = " ".join(f"WHEN '{when}' THEN CAST({value} AS {kind})" for when, value in parts.items())
        shown = "double" if kind == MONEY else kind
        return F.expr(f"CAST(coalesce(sum(CASE action {branches} END), 0) AS {shown})").alias(name)

    caught = f"CAST(fraud_amount AS DOUBLE) * {costs.VERIFY_CATCH_RATE}D"
    missed = f"CAST(fraud_amount AS DOUBLE) * {costs.MISSED_SHARE!r}D"
    verified = (
        f"row_count * {costs.VERIFY_COST}D + CAST(legit_friction AS DOUBLE) * {costs.VERIFY_ABANDON_RATE}D"
    )
    return (
        joined.groupBy("decline_threshold", "verify_threshold")
        .agg(
            total({name: f"{name}_cost" for name in ("approve", "verify", "decline")}, "total_cost", MONEY),
            total({"approve": "row_count"}, "approve_count", "bigint"),
            total({"verify": "row_count"}, "verify_count", "bigint"),
            total({"decline": "row_count"}, "decline_count", "bigint"),
            total({"decline": "row_count - fraud_rows"}, "false_declines", "bigint"),
            total({"verify": "fraud_rows", "decline": "fraud_rows"}, "fraud_intervened", "bigint"),
            total({"verify": caught, "decline": "fraud_amount"}, "fraud_caught_value", MONEY),
            total({"approve": "fraud_amount", "verify": missed}, "fraud_missed_cost", MONEY),
            total({"verify": verified, "decline": "legit_friction"}, "friction_cost", MONEY),
            total({"approve": "legit_amount"}, "normal_approval_value", MONEY),
        )
        .select(*WHATIF_COLUMNS)
    )


def whatif_totals(rows: DataFrame, decline: float) -> DataFrame:
    return threshold_sweep(rows, [decline])


GRID_CUTS = sorted(set(VERIFY_GRID) | set(DECLINE_GRID))


def _best_pair(sums: DataFrame, by: list[str]) -> DataFrame:
    """Cheapest (verify, decline) per group from interval sums; ties go to the smallest pair."""
    per_interval = F.map_from_entries(
        F.collect_list(  # at most 43 intervals
            F.struct("interval", F.struct("approve_cost", "verify_cost", "decline_cost"))
        )
    )
    totals = sums.groupBy(*by).agg(
        F.sum("row_count").alias("validation_rows"),
        F.sum("fraud_rows").alias("validation_fraud_rows"),
        per_interval.alias("_costs"),
    )
    cuts = costs.double_array(GRID_CUTS)
    # groups x 488 literal pairs; rows were reduced before.
    tried = (
        totals.withColumn("verify", F.expr(f"explode({costs.double_array(VERIFY_GRID)})"))
        .withColumn("decline", F.expr(f"explode({costs.double_array(DECLINE_GRID)})"))
        .filter("verify < decline")
        .withColumn("_verify_from", F.expr(f"array_position({cuts}, verify) - 1"))
        .withColumn("_decline_from", F.expr(f"array_position({cuts}, decline) - 1"))
    )
    total = F.expr(
        f"""aggregate(map_entries(_costs), CAST(0 AS {MONEY}), (total, entry) -> CAST(total + CASE
            WHEN entry.key > _decline_from THEN entry.value.decline_cost
            WHEN entry.key > _verify_from THEN entry.value.verify_cost
            ELSE entry.value.approve_cost END AS {MONEY}))"""
    )
    best = F.min(F.struct(total.alias("cost"), F.col("verify"), F.col("decline")))
    return (
        tried.groupBy(*by)
        .agg(
            best.alias("_best"),
            F.first("validation_rows").alias("validation_rows"),
            F.first("validation_fraud_rows").alias("validation_fraud_rows"),
        )
        .select(
            *by,
            F.col("_best.verify").alias("verify"),
            F.col("_best.decline").alias("decline"),
            F.col("_best.cost").cast("double").alias("validation_cost"),
            "validation_rows",
            "validation_fraud_rows",
        )
    )


def optimal_global(rows: DataFrame) -> DataFrame:
    """One row; an empty input gives none, and the caller keeps the default pair."""
    return _best_pair(_interval_sums(rows, GRID_CUTS, []).withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


def optimal_by_category(rows: DataFrame) -> DataFrame:
    """Cheapest pair per category; a category with too little fraud falls back to the global pair.

    The per-category interval sums (at most 14 x 43 rows) also give the global ones, so the rows
    are read once.
    """
    sums = _interval_sums(rows, GRID_CUTS, ["merchant_category"])
    measures = ["row_count", "fraud_rows", "approve_cost", "verify_cost", "decline_cost"]
    overall = sums.groupBy("interval").agg(*[F.sum(name).alias(name) for name in measures])
    overall = _best_pair(overall.withColumn("_all", F.lit(1)), ["_all"])
    shared = overall.select(F.struct("verify", "decline")).scalar()
    own = _best_pair(sums, ["merchant_category"]).withColumn("_global", shared)
    enough = F.col("validation_fraud_rows") >= MIN_SEGMENT_FRAUD
    return own.select(
        "merchant_category",
        F.when(enough, F.col("verify")).otherwise(F.col("_global.verify")).alias("verify"),
        F.when(enough, F.col("decline")).otherwise(F.col("_global.decline")).alias("decline"),
        F.when(enough, F.round("validation_cost", 2)).alias("validation_cost"),
        "validation_rows",
        "validation_fraud_rows",
        F.when(~enough, "global").alias("fallback"),
    )


def threshold_breaks(thresholds: DataFrame) -> DataFrame:
    """Rows that are not 0 <= verify < decline <= 1."""
    verify, decline = F.col("verify"), F.col("decline")
    good = (verify >= 0) & (verify < decline) & (decline <= 1)
    return thresholds.filter(~F.coalesce(good, F.lit(False)))


def thresholds_from_map(rows: DataFrame, column: str = "category_thresholds") -> DataFrame:
    """A map of category to {verify, decline} as one row per category, lowest decline first."""
    return (
        rows.select(F.explode(column).alias("merchant_category", "pair"))
        .select("merchant_category", "pair.verify", "pair.decline")
        .orderBy("decline", "merchant_category")
    )
