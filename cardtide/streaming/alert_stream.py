"""Alerts of committed batches, by a query that follows the commit log with its own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cardtide.fixed_values import HIGH_RISK_THRESHOLD
from cardtide.operators import decision_log
from cardtide.streaming.sinks import COMMIT_SCHEMA, DecisionSinks


def alert_batch(commits: DataFrame, sinks: DecisionSinks, threshold: float) -> None:
    """Write the alerts of newly committed batches; each batch's folder is overwritten, by a retry too."""
    scored = sinks.read(commits.sparkSession, "scored_transactions")
    if scored is None:
        return
    ready = scored.join(commits.select(F.col("committed_batch").alias("batch_id")), "batch_id", "left_semi")
    alerts = decision_log.high_risk_alerts(ready, threshold, ["batch_id"])
    alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{sinks.root}/alerts")


def start_alerts(
    spark: SparkSession, sinks: DecisionSinks, checkpoint: str, threshold: float = HIGH_RISK_THRESHOLD, every: str | None = None
) -> StreamingQuery:
    """A failing write ends this query, not the pipeline; started again, it goes on with the same commits."""
    commits = spark.readStream.schema(COMMIT_SCHEMA).parquet(f"{sinks.root}/commits")
    writer = commits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda frame, _: alert_batch(frame, sinks, threshold)
    )
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
