"""Dead letters that also have decisions, and drivers that cannot be shown."""

from pyspark.sql import functions as F

from cardtide.fixed_values import FEATURES
from cardtide.operators import decision_log, explanations
from cardtide.plans import catalogue


def test_rejected_routing(spark):
    letters = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "transaction_id string")
    scored = spark.createDataFrame([("c",), ("c",), ("d",), (None,)], "transaction_id string")
    found = {r["transaction_id"]: (r["dead_letters"], r["decisions"], r["routed"]) for r in decision_log.rejected_routing(letters, scored).collect()}
    assert found == {"a": (1, 0, True), "b": (2, 0, False), "c": (1, 2, False)}
    assert decision_log.rejected_routing(letters.limit(0), scored).count() == 0


def drivers(spark, folder, items, **snapshot):
    row = catalogue.decision_table(spark, folder).limit(1)
    fields = [F.lit(snapshot[n]).cast(row.schema["feature_snapshot"].dataType[n].dataType).alias(n) if n in snapshot else F.col(f"feature_snapshot.{n}") for n in FEATURES]
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("").alias("value"), F.lit(c).cast("double").alias("contribution")) for f, c in items])
    changed = row.withColumns({"feature_snapshot": F.struct(*fields), "explanation": listed})
    return [(d["feature"], d["value"], d["effect"]) for d in explanations.with_risk_drivers(changed).first()["drivers"]]


def test_only_what_can_be_shown_is_a_driver(spark, folder):
    items = [("amount", 0.5), ("numeric__customer_age", 0.7), ("unknown", 9.0), ("is_night", float("nan")), ("merchant_category_travel", 0.2), ("amount", 0.6)]
    found = drivers(spark, folder, items, amount=12.5, customer_age=41, merchant_category="travel")
    assert found == [("customer_age", "41 years", "raised risk"), ("amount", "$12.50", "raised risk"), ("merchant_category", "travel", "raised risk")]
    found = drivers(spark, folder, items, amount=None, customer_age=None, merchant_category="other")
    assert found == [("merchant_category", "unknown", "raised risk")]
    odd = [("transaction_day_of_week", -0.3), ("city_population", -0.4), (None, 1.0)]
    assert drivers(spark, folder, odd, transaction_day_of_week=-1, city_population=1234) == [("city_population", "1,234 residents", "lowered risk")]
    assert drivers(spark, folder, odd, transaction_day_of_week=8, city_population=None) == [("transaction_day_of_week", "Tuesday", "lowered risk")]
