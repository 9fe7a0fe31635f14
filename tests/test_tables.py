import pytest

from cardtide.operators import marts
from cardtide.plans import catalogue, training
from cardtide.sources import tables


def test_marts_are_published_as_tables(spark, folder, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS mart_test LOCATION '{tmp_path}/warehouse'")
    table = catalogue.decision_table(spark, folder)
    try:
        marts.publish_marts(table, "mart_test.daily_kpis", "mart_test.segment_kpis")
        marts.publish_marts(table, "mart_test.daily_kpis", "mart_test.segment_kpis")
        daily = spark.table("mart_test.daily_kpis")
        assert daily.count() == catalogue.daily(spark, folder).count()
        assert spark.table("mart_test.segment_kpis").count() == 14
        assert spark.table("staged_transactions").count() == table.count()
        some = tables.daily_kpis_between(daily, "2024-01-05", "2024-01-06", ["home", "travel"]).collect()
        assert {str(row["metric_date"]) for row in some} <= {"2024-01-05", "2024-01-06"}
        assert {row["merchant_category"] for row in some} <= {"home", "travel"}
        assert [row["metric_date"] for row in some] == sorted(row["metric_date"] for row in some)
    finally:
        spark.sql("DROP DATABASE mart_test CASCADE")


def test_empty_marts_have_no_window(spark, folder):
    empty = catalogue.daily(spark, folder).limit(0)
    with pytest.raises(Exception, match="No scored transactions"):
        marts.available_window(empty).collect()


def test_segments_rank_both_ways(spark, folder):
    daily = catalogue.daily(spark, folder)
    best = [row["estimated_savings"] for row in marts.segment_performance(daily).collect()]
    worst = [row["estimated_savings"] for row in marts.segment_performance(daily, best_first=False).collect()]
    assert best == sorted(best, reverse=True) and worst == sorted(worst)


def test_capped_training_scan(spark, folder):
    rows = tables.training_rows(catalogue.card_rows(spark, folder), 100)
    assert "merchant" not in rows.columns and rows.count() == 100
    frame = training.labelled_training_rows(rows, "salt")
    assert 0 < frame.count() <= 100 and "customer_id" not in frame.columns


def test_rows_of_one_split_are_dealt_to_all_cores(spark):
    rows = spark.range(1000).coalesce(1)
    dealt = tables.dealt(rows)
    sizes = [len(part) for part in dealt.rdd.glom().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 1000 / spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(rows).count() == 0 and dealt.count() == 1000
