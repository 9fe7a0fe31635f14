import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from cardtide.functions import costs, features, scoring, text
from cardtide.operators import explanations, operations
from cardtide.plans import decisions
from cardtide.sources.schemas import CONTRIBUTIONS_TYPE, SNAPSHOT_TYPE


def one(spark, expression, **values):
    kinds = {"amount": "double", "p": "double"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(k, _kind(v))}" for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


def _kind(value):
    return {
        bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "boolean",
        datetime.date: "date", datetime.datetime: "timestamp",
    }[type(value)]


def test_friction_is_margin_plus_reacquisition(spark):
    money = dict(amount=100.0, order_margin_pct=0.2, customer_ltv_band="medium")
    assert one(spark, costs.friction(), **money) == 65.0


@pytest.mark.parametrize(
    "p, action", [(0.1499, "approve"), (0.15, "verify"), (0.4999, "verify"), (0.5, "decline"), (1.0, "decline")]
)
def test_thresholds_are_inclusive(spark, p, action):
    assert one(spark, costs.decide("p", "0.15D", "0.5D"), p=p) == action


def test_realized_costs(spark):
    def cost(action, fraud):
        return one(spark, costs.realized_cost("action", "fraud", "amount", "65D"), action=action, fraud=fraud, amount=100.0)

    assert cost("approve", True) == 100.0 and cost("approve", False) == 0.0
    assert cost("verify", True) == pytest.approx(18.0) and cost("verify", False) == pytest.approx(8.2)
    assert cost("decline", True) == 0.0 and cost("decline", False) == 65.0
    assert cost("decline", None) is None
    with pytest.raises(Exception, match="unknown action"):
        cost("refer", True)


def test_pseudonym_and_band(spark):
    digest = hashlib.sha256(b"salt:2291163933867244").hexdigest()
    assert one(spark, features.pseudonym(F.col("card"), "salt"), card="2291163933867244") == digest
    share = int(digest[:8], 16) % 100
    expected = "low" if share < 50 else "medium" if share < 85 else "high"
    assert one(spark, features.ltv_band(F.col("h")), h=digest) == expected


def test_age_changes_on_the_birthday(spark):
    def age(day):
        return one(spark, features.age_in_years("dob", "at"), dob=datetime.date(1968, 3, 19), at=datetime.datetime(2020, *day))

    assert age((6, 21)) == 52 and age((3, 18)) == 51 and age((3, 19)) == 52


def test_distance_of_one_degree(spark):
    value = one(spark, features.distance_km("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=1.0)
    assert value == pytest.approx(111.195, rel=1e-3)
    assert one(spark, features.distance_km("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=180.0) == pytest.approx(20015.1, rel=1e-4)


def test_channel_and_merchant(spark):
    assert one(spark, features.channel(F.col("c")), c="shopping_net") == "card_not_present"
    assert one(spark, features.channel(F.col("c")), c="travel") == "card_not_present"
    assert one(spark, features.channel(F.col("c")), c="net_home") == "card_present"
    assert one(spark, features.merchant_name(F.col("m")), m="fraud_Kirlin fraud_ and Sons") == "Kirlin fraud_ and Sons"
    assert one(spark, features.margin("c"), c="nowhere") is None


def test_identifiers_do_not_survive(spark):
    row = (
        "t-00000001", datetime.datetime(2020, 6, 21, 12, 14, 25), "2291163933867244", "fraud_Kirlin", "home",
        2.86, 33.9, -80.9, 33.98, -81.2, 333497, datetime.date(1968, 3, 19), 0, "Jeff",
    )
    kinds = (
        "trans_num string, trans_date_trans_time timestamp, cc_num string, merchant string, category string, amt double, "
        "lat double, long double, merch_lat double, merch_long double, city_pop bigint, dob date, is_fraud int, first string"
    )
    event = decisions.card_rows_to_events(spark.createDataFrame([row], kinds), "salt").first().asDict()
    assert not {"cc_num", "dob", "first"} & set(event)
    assert "2291163933867244" not in str(event) and event["customer_age"] == 52


def test_decimal_cast_rounds_decimal_digits(spark):
    # 6.675249999999999 is binary noise around 6.67525.
    assert float(one(spark, costs.to_numeric(F.col("amount"), 14, 4), amount=6.675249999999999)) == 6.6753


def test_cut_tree_counts_cuts(spark):
    cuts = [0.1, 0.15, 0.15000000000000002, 0.9]
    for p, expected in ((0.05, 0), (0.1, 1), (0.15, 2), (0.15000000000000002, 3), (0.95, 4)):
        assert one(spark, costs.count_at_or_below("p", cuts), p=p) == expected


@pytest.mark.parametrize(
    "gap, mode, pause",
    [(720.0, "demo", 1.0), (0.0, "demo", 0.001), (3600.0, "realtime", 2.0), (-5.0, "realtime", 0.001), (9.0, "max", 0.0)],
)
def test_replay_pause(spark, gap, mode, pause):
    assert one(spark, operations.replay_delay(F.col("gap"), mode), gap=gap) == pause


def test_unknown_replay_mode():
    with pytest.raises(ValueError):
        operations.replay_mode("warp")


SNAPSHOT = (149.25, 5.0, 12.4, 5, 0, 40, 333497, 1, 0.35, "grocery_pos", "card_present", "low")


def decision_row(spark, contributions, decision="decline", snapshot=SNAPSHOT):
    return spark.createDataFrame(
        [("txn-12345678", decision, 149.25, 0.82, contributions, snapshot)],
        f"transaction_id string, decision string, amount double, fraud_probability double, "
        f"explanation {CONTRIBUTIONS_TYPE}, feature_snapshot {SNAPSHOT_TYPE}",
    )


def test_drivers_are_allow_listed_and_ranked(spark):
    rows = decision_row(
        spark,
        [("amount", "x", 1.4), ("is_night", "0.2", 0.8), ("unknown_prompt", "y", 99.0), ("numeric__amount", "z", 0.1),
         ("distance_km", "1", float("nan")), ("channel_card_present", "1", -3.0)],
    )
    drivers = explanations.with_risk_drivers(rows).first()["drivers"]
    assert [(d["feature"], d["value"], d["effect"]) for d in drivers] == [
        ("amount", "$149.25", "raised risk"), ("is_night", "yes", "raised risk"),
    ]
    assert drivers[0]["strength"] == 1.4


def test_lowering_drivers_only_when_nothing_raises(spark):
    rows = decision_row(spark, [("amount", "", -0.5), ("city_population", "", -0.9)])
    drivers = explanations.with_risk_drivers(rows).first()["drivers"]
    assert [d["feature"] for d in drivers] == ["city_population", "amount"]
    assert drivers[0]["value"] == "333,497 residents" and drivers[0]["effect"] == "lowered risk"


def test_sentences(spark):
    rows = explanations.template_explanations(decision_row(spark, [("amount", "", 1.4), ("is_night", "", 0.8)]))
    row = rows.first()
    assert row["explanation_text"] == (
        "Declined because the $149.25 purchase amount and the late-night timing raised estimated risk."
    )
    assert row["sentence_problem"] is None
    nothing = explanations.template_explanations(decision_row(spark, [], "verify")).first()
    assert "the combined transaction signals" in nothing["explanation_text"]


def test_sentence_rules(spark):
    def problem(sentence):
        return one(spark, text.sentence_problem(F.col("s")), s=sentence)

    assert problem("Fine and short.") is None
    assert problem(" ") == "empty explanation"
    assert problem("word " * 31) == "explanation exceeds word limit"
    assert problem("One. Two.") == "explanation contains multiple sentences"
    assert problem("The SHAP value is high.") == "explanation contains technical jargon"
    assert one(spark, text.tidy_sentence(F.col("s")), s="  no   mark ") == "no mark."


def test_top_contributions(spark):
    items = [("a", "", 0.1), ("b", "", -3.0), ("c", "", 2.0)]
    rows = decision_row(spark, items).select(
        explanations.top_contributions(F.col("explanation"), 2).alias("top"),
        explanations.contributions_by_value(F.col("explanation")).alias("sorted"),
    ).first()
    assert [item["feature"] for item in rows["top"]] == ["b", "c"]
    assert [item["feature"] for item in rows["sorted"]] == ["b", "a", "c"]


def test_stored_text_is_reused(spark):
    rows = decision_row(spark, [("amount", "", 1.4)]).withColumn("model_version", F.lit("v1"))
    stored = spark.createDataFrame(
        [("txn-12345678", "v1", "A text.", "template", None)],
        "transaction_id string, model_version string, explanation_text string, explanation_source string, explanation_model string",
    )
    now = F.lit("2024-01-01 00:00:00")
    assert explanations.missing_explanations(rows, stored, now).count() == 0
    assert explanations.missing_explanations(rows, stored, now, force=True).count() == 1
    assert explanations.missing_explanations(rows, stored, now, source="writer", model="m").count() == 1
    other = rows.withColumn("model_version", F.lit("v2"))
    assert explanations.missing_explanations(other, stored, now).count() == 1


def test_heuristic_score(spark):
    row = spark.createDataFrame(
        [(100.0, 4.6, 300.0, 1, "shopping_net")],
        "amount double, log_amount double, distance_km double, is_night int, merchant_category string",
    ).select(scoring.heuristic_probability().alias("p"), scoring.heuristic_contributions().alias("c")).first()
    assert row["p"] == pytest.approx(1 / (1 + 2.718281828459045 ** -(-5.2 + 0.55 * 4.6 + 2.4 + 0.8 + 0.9)))
    assert [item["contribution"] for item in row["c"]] == [2.53, 2.4, 0.8]
