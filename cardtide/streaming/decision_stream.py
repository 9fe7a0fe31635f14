"""Messages in, decisions, dead letters, metrics, outbound messages and alerts out.

Every output of a micro-batch is a folder named after its batch id and is overwritten when the
batch is retried. A batch counts only once its commit row exists, so readers see all of a batch's
outputs or none. Alerts come after the commit and never hold it up: ``alert_stream`` writes those
that failed. Which message keys are new comes from the query's own keyed state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cardtide.fixed_values import HEURISTIC_VERSION, HIGH_RISK_THRESHOLD, RAW_TOPIC, RETENTION_DAYS
from cardtide.operators import contract, decision_log, operations
from cardtide.plans import decisions
from cardtide.sources.schemas import EVENT_FIELDS
from cardtide.streaming.sinks import DecisionSinks, read_if_present

MESSAGE_SCHEMA = "value binary, topic string, partition int, offset bigint"
LOGGER = logging.getLogger(__name__)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: All stores of an executor share this much memory outside the heap for their buffers, caches and indexes. By default each
#: store has buffers of its own, and its indexes grow with its keys.
STATE_MEMORY = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
OUTPUTS = ["scored_transactions", "rejected_transactions", "pipeline_metrics", "outbox", "alerts"]
#: A function from events to decisions, with the ``model_version`` that its rows carry as an attribute. One that
#: ``explains`` has its rows without contributions counted as failures.
Scorer = Callable[[DataFrame], DataFrame]
#: Tasks for each core over which a new query spreads its keys. Each holds a store of its own, opened in every batch.
STATE_TASKS_PER_CORE = 2
#: A message key is free again this long after its message, as published messages are kept.
DEDUPE_HOURS = RETENTION_DAYS["outbox"][1] * 24


def message_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages that arrive as Parquet files."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def kafka_messages(spark: SparkSession, servers: str, topic: str = RAW_TOPIC, per_batch: int | None = None) -> DataFrame:
    """Messages of a Kafka topic from its start. Needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select("value", "topic", "partition", "offset")


def heuristic_scorer(events: DataFrame) -> DataFrame:
    return decisions.heuristic_decisions(events)


heuristic_scorer.model_version = HEURISTIC_VERSION
heuristic_scorer.explains = True


def model_scorer(bundle, explain: bool = True) -> Scorer:
    def score(events: DataFrame) -> DataFrame:
        return bundle.decide(decisions.with_model_features(events), explain)

    score.model_version = bundle.model_version
    score.explains = explain
    return score


def _versioned(scorer: Scorer) -> str:
    version = getattr(scorer, "model_version", None)
    if not version:
        raise ValueError("a scorer must name its model_version, which is part of every message key")
    return version


def with_new_keys(
    messages: DataFrame, model_version: str, arrived_at: Column | None = None, horizon_hours: int = DEDUPE_HOURS
) -> DataFrame:
    """All deliveries, and beside them a row with ``first_key`` for each message key that is not known yet.

    Known keys are the query's state, not the outbox: a key is kept for the horizon from its first arrival and then
    forgotten. Spark forgets it when the time of a later batch is twice the watermark's delay past it, so the delay is
    half the horizon. Time is that of arrival, which never runs backwards, so no row is too late for its key.
    """
    moment = F.current_timestamp() if arrived_at is None else arrived_at
    parsed = contract.parse_messages(messages.withColumn("_arrived", moment.cast("timestamp")))
    scored = F.concat_ws(":", F.lit("scored"), "transaction_id", F.lit(model_version))
    rejected = F.concat_ws(":", F.lit("rejected"), "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    keys = (
        parsed.select("_arrived", F.when(F.col("accepted"), scored).otherwise(rejected).alias("first_key"))
        .withWatermark("_arrived", f"{horizon_hours * 30} minutes")
        .dropDuplicatesWithinWatermark(["first_key"])
    )
    fields = T.StructType.fromDDL(MESSAGE_SCHEMA).fields
    return messages.select(*[field.name for field in fields], F.lit(None).cast("string").alias("first_key")).unionByName(
        keys.select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in fields], "first_key")
    )


def write_batch(
    messages: DataFrame,
    batch_id: int,
    sinks: DecisionSinks,
    scorer: Scorer = heuristic_scorer,
    alert_threshold: float = HIGH_RISK_THRESHOLD,
    now: Column | str | None = None,
) -> None:
    """All outputs of one micro-batch, its commit, then its alerts.

    With a column ``first_key`` (``with_new_keys``), messages go to the outbox if their key is among the new ones; without
    it, once for each key of the batch.
    """
    spark = messages.sparkSession
    # One timestamp for the whole batch, fixed before anything is written.
    if now is None:
        now = spark.range(1).select(F.current_timestamp()).first()[0]
    now = F.lit(now).cast("timestamp")
    arrival = ["partition", "offset"]
    held = []

    def kept(frame: DataFrame) -> DataFrame:
        held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        new_keys = None
        if "first_key" in messages.columns:
            # Kept, so that the keyed state is passed through once.
            rows = kept(messages)
            new_keys = rows.filter("first_key IS NOT NULL").select(F.col("first_key").alias("dedupe_key"))
            messages = rows.filter("first_key IS NULL").drop("first_key")
        parsed = kept(contract.parse_messages(messages))
        accepted = contract.accepted_events(parsed, arrival)
        scored = kept(decisions.enforce_score_contract(scorer(accepted), _versioned(scorer)))
        letters = kept(contract.dead_letters(parsed, now))
        # The position gives the arrival order of two deliveries of one transaction in a batch.
        table = decisions.to_decision_table(scored, now, arrival)
        seen = Observation()
        counted = table.observe(seen, F.count_if(F.coalesce(F.size("explanation"), F.lit(0)) < 1).alias("unexplained"))
        sinks.write(counted, "scored_transactions", batch_id)
        sinks.write(letters, "rejected_transactions", batch_id)
        metrics = operations.scored_metrics(scored, now).unionByName(operations.rejected_metrics(letters, now))
        unexplained = seen.get["unexplained"] if getattr(scorer, "explains", False) else 0
        if unexplained:
            failed = operations.explanation_failures(spark, unexplained, _versioned(scorer), now)
            metrics = metrics.unionByName(failed)
        sinks.write(metrics, "pipeline_metrics", batch_id)
        outgoing = (
            decision_log.scored_messages(scored, arrival)
            .unionByName(decision_log.rejected_messages(letters, arrival))
            .withColumns({"created_at": now, "available_at": now, "published_at": F.lit(None).cast("timestamp")})
        )
        if new_keys is not None:
            outgoing = outgoing.join(new_keys, "dedupe_key", "left_semi")
        fresh = decision_log.first_messages(outgoing, arrival)
        sinks.write(fresh.drop(*arrival), "outbox", batch_id)
        sinks.commit(spark, batch_id, now)
        try:
            sinks.write(decision_log.high_risk_alerts(scored, alert_threshold), "alerts", batch_id)
        except Exception:  # the batch is complete without its alerts, which alert_stream writes
            LOGGER.exception("alerts of batch %s are left to the alert stream", batch_id)
    finally:
        for frame in reversed(held):
            frame.unpersist()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _handle_batch(frame: DataFrame, batch_id: int, *given) -> None:
    """``write_batch`` with shuffles sized by what is in them. Spark turns that off in a stream with state, which the batch has behind it."""
    with _setting(frame.sparkSession, "spark.sql.adaptive.enabled", "true"):
        write_batch(frame, batch_id, *given)


def start(
    messages: DataFrame,
    sinks: DecisionSinks,
    checkpoint: str,
    scorer: Scorer = heuristic_scorer,
    every: str | None = None,
    alert_threshold: float = HIGH_RISK_THRESHOLD,
    now: Column | str | None = None,
    arrived_at: Column | None = None,
    horizon_hours: int = DEDUPE_HOURS,
) -> StreamingQuery:
    """Start the pipeline: every ``every`` (such as ``1 second``), or once over what is available.

    ``arrived_at`` is the time by which message keys are forgotten, the current time by default.
    """
    # State of a week's keys belongs on disk. A query that was started with another store keeps it.
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for name, value in STATE_MEMORY.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    marked = with_new_keys(messages, _versioned(scorer), arrived_at, horizon_hours)
    writer = marked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda frame, batch_id: _handle_batch(frame, batch_id, sinks, scorer, alert_threshold, now)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    # The query takes its settings when it starts, and keeps the number of its stores when it is started again.
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    with _setting(spark, "spark.sql.shuffle.partitions", str(stores)):
        return writer.trigger(**trigger).start()


def current_decisions(spark: SparkSession, sinks: DecisionSinks) -> DataFrame | None:
    """One row per transaction: its last delivery, unless that is expired."""
    log = sinks.read(spark, "scored_transactions")
    snapshot = _snapshot(spark, sinks)
    if snapshot is None:
        return None if log is None else decision_log.latest_versions(log)
    frame, upto = snapshot
    cutoff = sinks.expired_before(spark, "scored_transactions")
    if cutoff is not None:
        frame = frame.filter(F.col("processed_at") >= F.lit(cutoff))
    if log is None:
        return frame
    newer = log.filter(F.col("batch_id") > upto)
    return decision_log.latest_versions(frame.unionByName(newer))


def compact(spark: SparkSession, sinks: DecisionSinks) -> int | None:
    """Fold committed batches into a snapshot, so that reading the latest state stays cheap.

    The batches stay until retention takes them, as model changes are read from them; so do earlier snapshots.
    """
    log = sinks.read(spark, "scored_transactions")
    latest = current_decisions(spark, sinks)
    if log is None or latest is None:
        return None
    upto = log.agg(F.max("batch_id")).first()[0]
    snapshot = _snapshot(spark, sinks)
    if upto is None or (snapshot is not None and snapshot[1] == upto):
        return upto
    latest.filter(F.col("batch_id") <= upto).write.mode("overwrite").parquet(
        f"{sinks.root}/decision_snapshots/upto={upto}"
    )
    done = spark.range(1, numPartitions=1).select(
        F.lit(upto).cast("bigint").alias("upto"), F.current_timestamp().alias("folded_at")
    )
    done.write.mode("append").parquet(f"{sinks.root}/snapshot_commits")
    return upto


def _snapshot(spark: SparkSession, sinks: DecisionSinks):
    commits = read_if_present(spark, f"{sinks.root}/snapshot_commits")
    if commits is None:
        return None
    upto = commits.agg(F.max("upto")).first()[0]
    return spark.read.parquet(f"{sinks.root}/decision_snapshots/upto={upto}"), upto


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent progress of a query as a table: batch, rows in, rates."""
    rows = [
        (p.batchId, str(p.timestamp), int(p.numInputRows), float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0))
        for p in query.recentProgress
    ]
    return spark.createDataFrame(
        rows,
        "batch_id bigint, progress_time string, input_rows bigint, input_rows_per_second double, "
        "processed_rows_per_second double",
    )


def event_messages(events: DataFrame) -> DataFrame:
    """Events as compact JSON messages keyed by transaction."""
    body = F.struct(
        *[
            F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name) if name == "event_time" else F.col(name)
            for name in EVENT_FIELDS
        ]
    )
    return events.select(
        F.col("transaction_id").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
        "event_time",
    )


def write_replay(events: DataFrame, folder: str, files: int, limit: int | None = None) -> None:
    """Lay out contract-valid events as message files in time order, for a bounded replay.

    ``limit`` is the number of published events, counted after the contract.
    """
    valid = contract.valid_events(events)
    if limit is not None:
        from cardtide.operators.ordered import first_rows

        valid = first_rows(valid, limit, "event_time", "transaction_id")
    ordered = event_messages(valid).repartitionByRange(files, "event_time", "key").sortWithinPartitions("event_time", "key")
    placed = ordered.select(
        "value",
        F.lit(RAW_TOPIC).alias("topic"),
        F.spark_partition_id().alias("partition"),
        (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("offset"),
    )
    placed.write.mode("append").parquet(folder)
