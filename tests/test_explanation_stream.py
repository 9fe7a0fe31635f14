"""Texts that follow the commit log, and the metric of rows without contributions."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from cardtide.plans import catalogue, decisions
from cardtide.streaming import decision_stream as stream, explanation_stream
from cardtide.streaming.sinks import COMMIT_SCHEMA, read_if_present


@pytest.fixture(scope="module")
def messages(spark, folder):
    rows = stream.event_messages(catalogue.events(spark, folder)).orderBy("key").limit(20).collect()
    return [(r["value"], "txns.raw", 0, k) for k, r in enumerate(rows)]


def scorer(version, blank=0):
    def score(events):
        scored = decisions.heuristic_decisions(events).withColumn("model_version", F.lit(version))
        empty = F.array().cast(scored.schema["explanation"].dataType)
        return scored.withColumn("explanation", F.when(F.xxhash64("transaction_id") % 2 == 0, F.col("explanation")).otherwise(empty)) if blank else scored

    score.model_version, score.explains = version, True
    return score


@dataclass
class Log:
    spark: object
    sinks: stream.DecisionSinks
    checkpoint: str

    def write(self, messages, batch, version, **more):
        frame = self.spark.createDataFrame(messages, stream.MESSAGE_SCHEMA)
        stream.write_batch(frame, batch, self.sinks, scorer(version, **more), now=f"2024-03-0{batch + 1} 00:00:00")

    def explain(self):
        query = explanation_stream.start_explanations(self.spark, self.sinks, self.checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None

    def texts(self):
        rows = read_if_present(self.spark, f"{self.sinks.root}/explanations")
        found = {}
        for r in rows.collect():
            found.setdefault(r["transaction_id"], []).append((r["run_id"], r["model_version"]))
        return {k: sorted(v) for k, v in found.items()}


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, stream.DecisionSinks(str(tmp_path / "out")), str(tmp_path / "checkpoint"))


def test_texts_are_written_once_rewritten_after_a_model_change_and_reused_otherwise(spark, log, messages):
    log.write(messages[:10], 0, "a")
    log.explain()
    log.write(messages[:12], 1, "a")
    log.explain()
    log.write(messages[:3], 2, "b")
    log.explain()
    # Away from a model and back to it between two runs: the text of before is not valid any more.
    log.write(messages[4:6], 3, "b")
    log.write(messages[4:6], 4, "a")
    log.explain()
    log.explain()
    ids = [r["transaction_id"] for r in log.sinks.read(spark, "scored_transactions").filter("batch_id = 1").orderBy("offset").collect()]
    expected = {i: [(0, "a")] for i in ids[:10]} | {i: [(1, "a")] for i in ids[10:12]}
    expected |= {i: [(0, "a"), (2, "b")] for i in ids[:3]} | {i: [(0, "a"), (3, "a")] for i in ids[4:6]}
    assert log.texts() == expected
    shown = explanation_stream.explained_decisions(spark, log.sinks, stream.current_decisions(spark, log.sinks))
    assert shown.filter("explanation_text IS NULL").count() == 0 and shown.count() == 12
    # A delivery that no run has seen yet shows no text of another model.
    log.write(messages[:1], 5, "c")
    shown = explanation_stream.explained_decisions(spark, log.sinks, stream.current_decisions(spark, log.sinks))
    assert [r["transaction_id"] for r in shown.filter("explanation_text IS NULL").collect()] == [ids[0]]


def test_a_retried_run_appends_nothing_twice(spark, log, messages):
    log.write(messages[:4], 0, "a")
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{log.sinks.root}/commits")
    for _ in range(2):
        explanation_stream.explain_batch(commits, 0, log.sinks)
    assert [len(v) for v in log.texts().values()] == [1] * 4
    explanation_stream.explain_batch(commits, 1, log.sinks, source="writer", model="m")
    explanation_stream.explain_batch(commits, 2, log.sinks, source="writer", model="m")
    explanation_stream.explain_batch(commits, 3, log.sinks, force=True)
    assert [[run for run, _ in v] for v in log.texts().values()] == [[0, 1, 3]] * 4
    assert explanation_stream.explained_decisions(spark, stream.DecisionSinks(f"{log.sinks.root}/none"), log.sinks.read(spark, "scored_transactions")).filter("explanation_text IS NULL").count() == 4


def test_rows_without_contributions_are_counted_while_they_are_written(spark, log, messages):
    log.write(messages, 0, "a")
    assert log.sinks.read(spark, "pipeline_metrics").filter("metric_name = 'shap_explanation_failures'").count() == 0
    log.write(messages, 1, "a", blank=1)
    row = log.sinks.read(spark, "pipeline_metrics").filter("metric_name = 'shap_explanation_failures'").first()
    failed = log.sinks.read(spark, "scored_transactions").filter("batch_id = 1 AND size(explanation) = 0").count()
    assert 0 < failed == row["metric_value"] and row["labels"] == '{"model_version":"a","error_type":"ContributionError"}'
