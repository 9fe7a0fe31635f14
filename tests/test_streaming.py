import json

import pytest
from pyspark.sql import functions as F

from cardtide.operators import decision_log
from cardtide.plans import catalogue, decisions
from cardtide.streaming import decision_stream as stream, metrics_stream, outbox_stream

NOW = "2024-02-01 00:00:00"
BAD = [
    json.dumps({"transaction_id": "txn-badbadbad", "cc_num": "1", "instructions": "x"}).encode(),
    b"{broken",
    b"[1]",
]


def write_bad(spark, folder, offset):
    rows = [(bytearray(value), "txns.raw", 9, offset + i) for i, value in enumerate(BAD)] + [(None, "txns.raw", 9, offset + 9)]
    spark.createDataFrame(rows, stream.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def run(spark, folder, tmp_path_factory):
    """Two runs over one checkpoint; the second delivers everything again."""
    root = tmp_path_factory.mktemp("stream")
    events = catalogue.all_events(spark, folder)
    incoming, sinks = str(root / "in"), stream.DecisionSinks(str(root / "out"))
    checkpoint = str(root / "checkpoint")
    stream.write_replay(events, incoming, 2)
    write_bad(spark, incoming, 100)
    first = stream.start(stream.message_files(spark, incoming, 2), sinks, checkpoint, alert_threshold=0.6, now=NOW)
    first.awaitTermination(300)
    stream.write_replay(events, incoming, 1)
    second = stream.start(stream.message_files(spark, incoming, 2), sinks, checkpoint, alert_threshold=0.6, now=NOW)
    second.awaitTermination(300)
    assert first.exception() is None and second.exception() is None
    return root, sinks, checkpoint, second


def test_latest_table_equals_batch(spark, folder, run):
    _, sinks, _, _ = run
    columns = ["transaction_id", "decision", "fraud_probability", "realized_policy_cost", "amount"]
    streamed = stream.current_decisions(spark, sinks).select(*columns)
    batch = catalogue.decision_table(spark, folder).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_dead_letters_are_separate(spark, run):
    _, sinks, _, _ = run
    letters = sinks.read(spark, "rejected_transactions")
    assert letters.count() == len(BAD) + 1
    scored = sinks.read(spark, "scored_transactions")
    assert scored.join(letters.select("transaction_id"), "transaction_id", "left_semi").count() == 0


def test_metrics_count_every_delivery(spark, run):
    _, sinks, _, _ = run
    totals = {
        row["metric_name"]: row["total"]
        for row in sinks.read(spark, "pipeline_metrics").groupBy("metric_name").agg(F.sum("metric_value").alias("total")).collect()
    }
    assert totals["transactions_scored"] == sinks.read(spark, "scored_transactions").count()
    assert totals["transactions_rejected"] == len(BAD) + 1


def test_outbox_has_each_message_once(spark, folder, run):
    _, sinks, _, _ = run
    outbox = sinks.read(spark, "outbox")
    expected = catalogue.events(spark, folder).count()
    assert outbox.filter("topic = 'txns.scored'").count() == expected
    assert outbox.count() == outbox.select("dedupe_key").distinct().count() == expected + len(BAD) + 1
    body = json.loads(outbox.filter("topic = 'txns.scored'").first()["payload"])
    assert {"transaction_id", "customer_lat", "fraud_probability", "feature_snapshot"} <= set(body)
    assert outbox.filter("message_key = 'rejected-9-109'").count() == 1


def test_alerts_follow_the_threshold(spark, folder, run):
    _, sinks, _, _ = run
    scored = catalogue.scored(spark, folder)
    expected = decision_log.high_risk_alerts(scored, 0.6).count()
    assert sinks.read(spark, "alerts").select("transaction_id").distinct().count() == expected


def test_retry_overwrites_and_uncommitted_is_invisible(spark, run):
    root, sinks, _, _ = run
    before = sinks.read(spark, "scored_transactions").count()
    messages = spark.read.schema(stream.MESSAGE_SCHEMA).parquet(str(root / "in"))
    failing = stream.DecisionSinks(sinks.root)
    failing.commit = lambda *_: (_ for _ in ()).throw(RuntimeError("crash before commit"))
    with pytest.raises(RuntimeError):
        stream.write_batch(messages, 99, failing, now=NOW)
    assert sinks.read(spark, "scored_transactions").count() == before
    stream.write_batch(messages, 99, sinks, now=NOW)
    once = sinks.read(spark, "scored_transactions").count()
    stream.write_batch(messages, 99, sinks, now=NOW)
    assert sinks.read(spark, "scored_transactions").count() == once > before


def test_compaction_keeps_the_latest_state(spark, run):
    _, sinks, _, _ = run
    before = stream.current_decisions(spark, sinks).select("transaction_id", "batch_id").collect()
    upto = stream.compact(spark, sinks)
    after = stream.current_decisions(spark, sinks).select("transaction_id", "batch_id").collect()
    assert sorted(before) == sorted(after) and stream.compact(spark, sinks) == upto


def test_publisher_sends_committed_messages(spark, run):
    root, sinks, _, _ = run
    target = str(root / "published")
    for _ in range(2):
        query = outbox_stream.start_publisher(spark, sinks, target, str(root / "publisher"))
        query.awaitTermination(120)
        assert query.exception() is None
    sent = spark.read.parquet(target)
    assert set(r[0] for r in sent.select("topic").distinct().collect()) == {"txns.scored", "txns.rejected"}
    missing = sinks.read(spark, "outbox").select("dedupe_key").exceptAll(sent.select("dedupe_key"))
    assert missing.count() == 0


def test_progress_table(spark, run):
    rows = stream.progress_rows(spark, run[3])
    assert rows.agg(F.sum("input_rows")).first()[0] > 0


def collect_stream(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streamed_metrics_equal_batch(spark, folder, tmp_path):
    metrics = catalogue.pipeline_metrics(spark, folder)
    path = str(tmp_path / "metrics")
    metrics.write.parquet(path)
    source = spark.readStream.schema(metrics.schema).parquet(path)
    streamed = collect_stream(metrics_stream.volume(source), "volume", "complete")
    assert streamed.agg(F.sum("total")).first()[0] == catalogue.events(spark, folder).count()
    rates = collect_stream(metrics_stream.failure_rate(source), "rates", "complete")
    assert rates.exceptAll(catalogue.operations.failure_rate(metrics)).count() == 0


def test_repeats_are_dropped_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = spark.range(20).select(
        F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("dedupe_key"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id")).alias("created_at"),
    )
    rows.repartition(3).write.parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert collect_stream(outbox_stream.without_repeats(source), "unique_messages").count() == 5


def test_score_contract_stops_a_batch(spark, folder):
    scored = catalogue.scored(spark, folder)
    assert decisions.score_contract_breaks(scored).count() == 0
    wrong = scored.withColumn("fraud_probability", F.lit(1.5))
    assert decisions.score_contract_breaks(wrong).count() > 0
    with pytest.raises(Exception, match="invalid score"):
        decisions.enforce_score_contract(wrong).select("fraud_probability").collect()


def test_state_follows_the_cores_and_the_settings_come_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        stream.write_replay(catalogue.all_events(spark, "/root/testdata/sf0.001"), str(tmp_path / "in"), 1, limit=20)
        query = stream.start(stream.message_files(spark, str(tmp_path / "in")), stream.DecisionSinks(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
        query.awaitTermination(300)
        assert query.exception() is None and spark.conf.get("spark.sql.shuffle.partitions") == "200"
        stores = [entry for entry in (tmp_path / "checkpoint" / "state" / "0").iterdir() if entry.name.isdigit()]
        assert 0 < len(stores) <= stream.STATE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_key_stores_share_a_bounded_memory(spark, run):
    """Each store had buffers of its own, however many an executor held (F4)."""
    _, _, _, query = run
    for name, value in stream.STATE_MEMORY.items():
        assert spark.conf.get(name) == value
    metrics = dict(query.lastProgress.stateOperators[0].customMetrics)
    assert 0 < metrics["rocksdbPinnedBlocksMemoryUsage"] < 256 * 1024 * 1024
