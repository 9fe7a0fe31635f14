"""Explanation texts, kept up along the commit log.

A run looks at the transactions that new commits touched. A transaction keeps its last text while every delivery since
carries the text's model; otherwise a new text is appended, with the place of the delivery that it explains. What the
stored texts are read for is their keys, once a run, and only those of touched transactions leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cardtide.operators import decision_log, explanations
from cardtide.streaming.sinks import COMMIT_SCHEMA, DecisionSinks, read_if_present

FOLDER = "explanations"
_TEXT = ["explanation_text", "explanation_source", "explanation_model", "explanation_generated_at"]


def _last_texts(texts: DataFrame) -> DataFrame:
    """The text of each transaction's latest explained delivery; of two for one delivery, the later one."""
    order = F.struct(*decision_log.ARRIVAL, "explanation_generated_at")
    kept = ["model_version", *_TEXT, *decision_log.ARRIVAL]
    return texts.groupBy("transaction_id").agg(F.max_by(F.struct(*kept), order).alias("text"))


def texts_to_write(
    touched: DataFrame, texts: DataFrame | None, now: Column, source: str = "template", model: str | None = None, force: bool = False
) -> DataFrame:
    """New text rows for the transactions of ``touched`` deliveries whose last text may not be reused."""
    models = touched.groupBy("transaction_id").agg(F.min("model_version").alias("least"), F.max("model_version").alias("most"))
    latest = decision_log.latest_versions(touched)
    todo = latest
    if texts is not None and not force:
        known = _last_texts(texts.join(models.select("transaction_id"), "transaction_id", "left_semi"))
        text = F.col("text.model_version")
        same = (F.col("least") == text) & (F.col("most") == text)
        reusable = explanations.reusable_text(source, model, "text.")
        kept = models.join(known, "transaction_id").filter(same & reusable).select("transaction_id")
        todo = latest.join(kept, "transaction_id", "left_anti")
    return explanations.template_explanations(todo).select(
        "transaction_id",
        "model_version",
        "explanation_text",
        F.lit("template").alias("explanation_source"),
        F.lit(model if source != "template" else None).cast("string").alias("explanation_model"),
        now.cast("timestamp").alias("explanation_generated_at"),
        *decision_log.ARRIVAL,
    )


def explain_batch(
    commits: DataFrame, run_id: int, sinks: DecisionSinks, now: Column | None = None, source: str = "template", model: str | None = None, force: bool = False
) -> None:
    """Append the texts that newly committed batches need; a retry of a run overwrites its own folder."""
    spark = commits.sparkSession
    log = sinks.read(spark, "scored_transactions")
    if log is None:
        return
    touched = log.join(commits.select(F.col("committed_batch").alias("batch_id")), "batch_id", "left_semi")
    stored = read_if_present(spark, f"{sinks.root}/{FOLDER}")
    if stored is not None:
        stored = stored.filter(F.col("run_id") != run_id)
    moment = F.current_timestamp() if now is None else now
    texts_to_write(touched, stored, moment, source, model, force).write.mode("overwrite").parquet(f"{sinks.root}/{FOLDER}/run_id={run_id}")


def start_explanations(
    spark: SparkSession, sinks: DecisionSinks, checkpoint: str, every: str | None = None, now: Column | None = None
) -> StreamingQuery:
    """Follow the commit log, with an own checkpoint."""
    commits = spark.readStream.schema(COMMIT_SCHEMA).parquet(f"{sinks.root}/commits")
    writer = commits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda frame, run_id: explain_batch(frame, run_id, sinks, now)
    )
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def explained_decisions(spark: SparkSession, sinks: DecisionSinks, latest: DataFrame) -> DataFrame:
    """``latest`` decisions with their text, if there is one for the model that scored them."""
    stored = read_if_present(spark, f"{sinks.root}/{FOLDER}")
    if stored is None:
        return latest.withColumns({name: F.lit(None).cast("timestamp" if name.endswith("_at") else "string") for name in _TEXT})
    now, texts = latest.alias("now"), _last_texts(stored).alias("texts")
    same = (F.col("now.transaction_id") == F.col("texts.transaction_id")) & (F.col("now.model_version") == F.col("text.model_version"))
    return now.join(texts, same, "left").select("now.*", *[F.col(f"text.{name}").alias(name) for name in _TEXT])
