"""Scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardtide.fixed_values import CATEGORIES
from cardtide.operators.ordered import time_order_cuts
from cardtide.sources.schemas import RAW_COLUMNS, TRAINING_COLUMNS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tasks for each core over which ``dealt`` spreads rows.
TASKS_PER_CORE = 2


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to tasks however few splits the scan has: for steps that cost far more than moving a row.

    The number is that of the cores, since few bytes may be much work.
    """
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, F.monotonically_increasing_id())


def events_as_card_rows(events: DataFrame) -> DataFrame:
    """View the provided event table as raw card rows, one for one."""
    user, event = F.col("user_id"), F.col("event_id")
    categories = F.array(
        *[F.lit(name) for name in sorted(CATEGORIES)]
    )
    home_lat = 25 + (user % 200) / F.lit(10.0)
    home_long = -120 + (user % 400) / F.lit(10.0)
    return events.select(
        F.concat(F.lit("txn-"), F.lpad(event.cast("string"), 10, "0")).alias("trans_num"),
        F.col("ts").cast("timestamp").alias("trans_date_trans_time"),
        (F.lit(4000000000000000) + user).cast("string").alias("cc_num"),
        F.concat(F.lit("fraud_Merchant "), (event % 97).cast("string")).alias("merchant"),
        F.get(categories, ((event * 7 + user) % 14).cast("int")).alias("category"),
        F.col("value").alias("amt"),
        home_lat.alias("lat"),
        home_long.alias("long"),
        (home_lat + (event % 21 - 10) / F.lit(10.0)).alias("merch_lat"),
        (home_long + (event % 31 - 15) / F.lit(10.0)).alias("merch_long"),
        (500 + (user * 7919) % 1000000).alias("city_pop"),
        F.date_add(F.lit("1935-01-01").cast("date"), ((user * 9176) % 27000).cast("int")).alias("dob"),
        F.when(event % 97 == 0, F.lit(None).cast("int"))
        .otherwise(((F.col("event_type") == "error") & (F.col("value") > 60)).cast("int"))
        .alias("is_fraud"),
    )


def read_card_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows as text. Columns are found by header name, so their order does not matter."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def missing_columns(frame: DataFrame, required: list[str] = RAW_COLUMNS) -> list[str]:
    return sorted(set(required) - set(frame.columns))


def typed_card_rows(rows: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Cast text columns; a value that cannot be cast becomes NULL and is rejected by the contract."""
    absent = missing_columns(rows, columns)
    if absent:
        raise ValueError(f"missing required columns {absent}")

    def typed(name: str) -> Column:
        value = F.col(name)
        if name == "trans_date_trans_time":
            return F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss"))
        if name == "dob":
            return F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
        if name in ("amt", "lat", "long", "merch_lat", "merch_long"):
            return value.try_cast("double")
        if name == "city_pop":
            return value.try_cast("bigint")
        if name == "is_fraud":
            return value.try_cast("int")
        return value

    return rows.select(*[typed(name).alias(name) for name in columns])


def training_rows(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Columns that training needs.

    ``max_rows`` bounds the labelled rows given to a fit: the earliest ones, by an exact comparison that moves no row.
    """
    pruned = rows.select(*TRAINING_COLUMNS)
    if max_rows is None:
        return pruned
    labelled = pruned.filter(F.col("is_fraud").isNotNull())
    (earliest,) = time_order_cuts(labelled, "trans_date_trans_time", "trans_num", lambda _: [max_rows])
    return labelled.filter(earliest)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest file ``{file: {rows, min_timestamp, max_timestamp, sha256}}`` as one row per file."""
    entry = "struct<rows:bigint,min_timestamp:string,max_timestamp:string,sha256:string>"
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("file", "entry"))
        .select("file", "entry.*")
    )


def read_model_version(spark: SparkSession, path: str) -> DataFrame:
    """One row; ``unknown`` when the metadata has no version."""
    return spark.read.text(path, wholetext=True).select(
        F.coalesce(F.get_json_object("value", "$.model_version"), F.lit("unknown")).alias("model_version")
    )


def daily_kpis_between(daily: DataFrame, start: str, end: str, categories: list[str] | None = None) -> DataFrame:
    chosen = daily.filter(F.col("metric_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if categories is not None:
        chosen = chosen.filter(F.col("merchant_category").isin(categories))
    return chosen.orderBy("metric_date", "merchant_category")
