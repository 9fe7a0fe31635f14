"""Outbound messages: publishing committed ones, and dropping repeats in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cardtide.operators import decision_log
from cardtide.streaming.sinks import COMMIT_SCHEMA, DecisionSinks, read_if_present


def publish_batch(commits: DataFrame, publish_id: int, sinks: DecisionSinks, target: str, now: Column | str | None = None) -> None:
    """Publish the outbox rows of newly committed batches and enter them in the publication ledger.

    A publish id that is in the ledger is done, and a retry of it changes nothing. A retry before that overwrites the same
    folder. A failure is recorded for its batches, by the error's type alone, and raised again.
    """
    spark = commits.sparkSession
    entry = f"{sinks.root}/publications/publish_id={publish_id}"
    done = read_if_present(spark, entry)
    if done is not None and not done.isEmpty():
        return
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    batches = commits.select(F.col("committed_batch").alias("batch_id")).distinct()
    try:
        ready = sinks.read(spark, "outbox").join(batches, "batch_id", "left_semi")
        ready.select("topic", F.col("message_key").alias("key"), F.col("payload").alias("value"), "dedupe_key").write.mode(
            "overwrite"
        ).partitionBy("topic").parquet(f"{target}/publish_id={publish_id}")
    except Exception as error:
        failed = batches.select(
            F.col("batch_id").alias("failed_batch"), F.lit(type(error).__name__).alias("error_type"), moment.alias("failed_at")
        )
        failed.coalesce(1).write.mode("append").parquet(f"{sinks.root}/publication_failures")
        raise
    entered = batches.select(F.col("batch_id").alias("published_batch"), moment.alias("published_at"))
    entered.coalesce(1).write.mode("overwrite").parquet(entry)


def start_publisher(
    spark: SparkSession, sinks: DecisionSinks, target: str, checkpoint: str, every: str | None = None, now: Column | str | None = None
) -> StreamingQuery:
    """Follow the commit log. The checkpoint replaces claims and leases on single rows."""
    commits = spark.readStream.schema(COMMIT_SCHEMA).parquet(f"{sinks.root}/commits")
    writer = commits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda frame, publish_id: publish_batch(frame, publish_id, sinks, target, now)
    )
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def pending(spark: SparkSession, sinks: DecisionSinks, now: Column, batch: int) -> DataFrame | None:
    """The oldest messages that are due and not in the publication ledger."""
    outbox = sinks.outbox(spark)
    return None if outbox is None else decision_log.pending_messages(outbox, now, batch)


def start_kafka_publisher(messages: DataFrame, servers: str, checkpoint: str) -> StreamingQuery:
    """Publish keyed messages (topic, key, value) to Kafka; the connector confirms each write."""
    return (
        messages.select("topic", F.col("key").cast("binary"), F.col("value").cast("binary"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def without_repeats(messages: DataFrame, time: str = "created_at", horizon: str = "7 days") -> DataFrame:
    """Drop messages whose key was seen within the horizon; the state is bounded by it."""
    return messages.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["dedupe_key"])
