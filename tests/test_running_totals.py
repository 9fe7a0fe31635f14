"""Running totals over sorted ranges against a loop, with one shuffle of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardtide.operators.ordered import running_totals

START = datetime(2024, 1, 1)


def rows(seed, groups):
    choice = random.Random(seed)
    made = []
    for group in groups:
        made += [(group, START + timedelta(seconds=s), choice.randrange(9), float(choice.randrange(100))) for s in choice.sample(range(5000), choice.choice([1, 40, 700]))]
    return made


def expected(made, descending):
    out = {}
    for group in {r[0] for r in made}:
        n = x = 0
        previous = None
        for _, at, count, value in sorted((r for r in made if r[0] == group), key=lambda r: r[1], reverse=descending):
            out[(group, at)] = (n, x, previous)
            n, x, previous = n + count, x + value, at
    return out


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("groups", [["a"], ["a", "b", None, "d"], [f"g{k}" for k in range(30)]])
def test_totals_and_previous_values(spark, groups, descending):
    made = rows(len(groups), groups)
    frame = spark.createDataFrame(made, "g string, at timestamp, n bigint, x double").repartition(5)
    found = running_totals(frame, "at", ["n", "x"], ["g"], descending, "before")
    assert {(r["g"], r["at"]): (r["n_before"], r["x_before"], r["before"]) for r in found.collect()} == expected(made, descending)


def test_small_batches_carry_over(spark):
    made = rows(3, ["a", "b"]) + [("c", START + timedelta(seconds=k), 1, 1.0) for k in range(997)]
    frame = spark.createDataFrame(made, "g string, at timestamp, n bigint, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = running_totals(frame, "at", ["n", "x"], ["g"], False, "before").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["g"], r["at"]): (r["n_before"], r["x_before"], r["before"]) for r in found} == expected(made, False)


def test_rows_are_not_shuffled_again(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"), F.lit(1).cast("bigint").alias("n"))
    found = running_totals(frame, "k", ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What is exchanged after the checkpoint is totals of ranges.
    assert "hashpartitioning(_range" not in plan.split("BroadcastExchange")[0] and "rangepartitioning" not in plan
    assert found.filter("n_before = 0").count() == 1 and found.agg(F.max("n_before")).first()[0] == 999
    assert running_totals(frame.limit(0), "k", ["n"], previous="p").count() == 0
