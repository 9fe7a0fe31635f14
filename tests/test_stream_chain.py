"""The chain behind the decision stream: key state, publication ledger, alerts after the commit, retention."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardtide.fixed_values import HEURISTIC_VERSION
from cardtide.operators import decision_log
from cardtide.plans import catalogue, decisions
from cardtide.streaming import alert_stream, decision_stream as stream, outbox_stream, retention

ARRIVED = stream.MESSAGE_SCHEMA + ", arrived timestamp"
START = datetime(2024, 3, 1)


def at(day):
    return F.lit((START + timedelta(days=day)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


@pytest.fixture(scope="module")
def messages(spark, folder):
    """Forty valid messages and one that is not JSON."""
    rows = stream.event_messages(catalogue.events(spark, folder)).orderBy("key").limit(40).collect()
    made = [(r["value"], "txns.raw", 0, k) for k, r in enumerate(rows)]
    return made + [(bytearray(b"{broken"), "txns.raw", 1, 0)]


class Chain:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.sinks = stream.DecisionSinks(f"{root}/out")

    def deliver(self, rows, day, hours=168):
        moment = START + timedelta(days=day)
        frame = self.spark.createDataFrame([(*r, moment) for r in rows], ARRIVED)
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        source = self.spark.readStream.schema(ARRIVED).parquet(f"{self.root}/in")
        query = stream.start(
            source, self.sinks, f"{self.root}/checkpoint", now=at(day), arrived_at=F.col("arrived"), horizon_hours=hours, alert_threshold=0.3
        )
        query.awaitTermination(240)
        assert query.exception() is None

    def outbox(self):
        return self.sinks.read(self.spark, "outbox")


def test_a_repeat_inside_the_horizon_and_one_beyond_it(spark, messages, tmp_path, monkeypatch):
    chain = Chain(spark, tmp_path)
    read = []
    monkeypatch.setattr(stream.DecisionSinks, "read", lambda self, spark, name, f=stream.DecisionSinks.read: read.append(name) or f(self, spark, name))
    chain.deliver(messages[:20] + messages[:5] + messages[40:], 0)
    chain.deliver(messages[:20] + messages[20:25], 3)
    chain.deliver(messages[25:30], 7.2)
    chain.deliver(messages[:2] + messages[20:22], 8)
    assert "outbox" not in read
    counts = {}
    for row in chain.outbox().groupBy("dedupe_key", "created_at").count().collect():
        assert row["count"] == 1
        counts.setdefault(row["dedupe_key"], []).append((row["created_at"] - START).days)
    ids = [json.loads(bytes(m[0]))["transaction_id"] for m in messages[:40]]
    sent = {key.split(":")[1]: sorted(days) for key, days in counts.items() if key.startswith("scored")}
    # First seen on day 0: free again on day 8. First seen on day 3: still known.
    assert sent == {**{i: [0, 8] for i in ids[:2]}, **{i: [0] for i in ids[2:20]}, **{i: [3] for i in ids[20:25]}, **{i: [7] for i in ids[25:30]}}
    assert counts["rejected:txns.raw:1:0"] == [0]
    # Every delivery is in the log of decisions.
    assert chain.sinks.read(spark, "scored_transactions").count() == 25 + 25 + 5 + 4


def test_a_retried_batch_sends_the_same_messages(spark, messages, tmp_path, monkeypatch):
    chain = Chain(spark, tmp_path)
    chain.deliver(messages[:5], 0)
    commit, crash = stream.DecisionSinks.commit, [True]

    def failing(self, *args):
        if crash.pop() if crash else False:
            raise RuntimeError("crash before the commit")
        return commit(self, *args)

    monkeypatch.setattr(stream.DecisionSinks, "commit", failing)
    with pytest.raises(Exception, match="crash before the commit"):
        chain.deliver(messages[3:9], 1)
    assert chain.outbox().count() == 5
    chain.deliver([], 1)
    assert chain.outbox().count() == 9 == chain.outbox().select("dedupe_key").distinct().count()


def test_a_scorer_names_its_version(spark, messages, tmp_path):
    rows = spark.createDataFrame(messages, stream.MESSAGE_SCHEMA)
    sinks = stream.DecisionSinks(str(tmp_path))
    with pytest.raises(ValueError, match="model_version"):
        stream.write_batch(rows, 0, sinks, lambda events: decisions.heuristic_decisions(events))

    def scorer(events):
        return decisions.heuristic_decisions(events)

    scorer.model_version = "other"
    with pytest.raises(Exception, match="invalid score"):
        stream.write_batch(rows, 0, sinks, scorer)


@pytest.mark.parametrize("column", ["verify_threshold", "expected_cost_verify", "model_version", "decision", "transaction_id"])
def test_score_contract_covers_every_field(spark, folder, column):
    scored = catalogue.scored(spark, folder).limit(20)
    assert decisions.score_contract_breaks(scored, HEURISTIC_VERSION).count() == 0
    missing = scored.withColumn(column, F.lit(None).cast(scored.schema[column].dataType))
    assert decisions.score_contract_breaks(missing).count() == 20
    odd = scored.withColumn("expected_cost_approve", F.lit(float("nan"))).withColumn("verify_threshold", F.lit(2.0))
    assert decisions.score_contract_breaks(odd).count() == 20


def written(spark, sinks, messages, batch, day):
    stream.write_batch(spark.createDataFrame(messages, stream.MESSAGE_SCHEMA), batch, sinks, alert_threshold=0.3, now=at(day))


def test_publication_ledger(spark, messages, tmp_path, monkeypatch):
    sinks, target = stream.DecisionSinks(str(tmp_path / "out")), str(tmp_path / "sent")
    checkpoint = str(tmp_path / "publisher")

    def publish(day):
        query = outbox_stream.start_publisher(spark, sinks, target, checkpoint, now=at(day))
        query.awaitTermination(120)
        return query

    def pending(day):
        return {r["dedupe_key"] for r in outbox_stream.pending(spark, sinks, at(day), 1000).collect()}

    assert outbox_stream.pending(spark, sinks, at(0), 10) is None
    written(spark, sinks, messages[:10], 0, 0)
    assert len(pending(0)) == 10
    publish(1)
    assert not pending(1)
    written(spark, sinks, messages[10:16], 1, 2)
    assert len(pending(2)) == 6
    # A failure is recorded and puts the batch off, and published messages keep their time.
    blocked = str(tmp_path / "blocked")
    (tmp_path / "blocked").write_text("a file, where a folder is needed")
    commits = spark.read.schema(outbox_stream.COMMIT_SCHEMA).parquet(f"{sinks.root}/commits").filter("batch_id = 1")
    for _ in range(2):
        with pytest.raises(Exception):
            outbox_stream.publish_batch(commits, 7, sinks, blocked, at(2))
    rows = {r["batch_id"]: r for r in sinks.outbox(spark).select("batch_id", "attempts", "last_error", "published_at", "available_at").distinct().collect()}
    assert rows[1]["attempts"] == 2 and rows[1]["last_error"] and rows[1]["available_at"] == START + timedelta(days=2, seconds=10)
    assert rows[0]["attempts"] == 0 and rows[0]["published_at"] == START + timedelta(days=1)
    assert not pending(2) and len(pending(2.1)) == 6
    publish(3)
    assert not pending(4)
    # A retried publish id changes nothing, not even with another time.
    before = sorted(map(str, sinks.outbox(spark).collect()))
    outbox_stream.publish_batch(commits, 1, sinks, target, at(5))
    assert sorted(map(str, sinks.outbox(spark).collect())) == before
    assert spark.read.parquet(target).count() == 16


def test_alerts_come_after_the_commit_and_are_retried(spark, messages, tmp_path, monkeypatch):
    sinks, checkpoint = stream.DecisionSinks(str(tmp_path / "out")), str(tmp_path / "alerts")
    write = stream.DecisionSinks.write

    def failing(self, frame, name, batch):
        if name == "alerts":
            raise RuntimeError("alert store is away")
        write(self, frame, name, batch)

    monkeypatch.setattr(stream.DecisionSinks, "write", failing)
    written(spark, sinks, messages[:30], 0, 0)
    assert sinks.read(spark, "scored_transactions").count() == 30 and sinks.read(spark, "alerts") is None
    monkeypatch.setattr(stream.DecisionSinks, "write", write)
    good = decision_log.high_risk_alerts
    monkeypatch.setattr(decision_log, "high_risk_alerts", lambda *_: (_ for _ in ()).throw(RuntimeError("still away")))
    first = alert_stream.start_alerts(spark, sinks, checkpoint, 0.3)
    with pytest.raises(Exception, match="still away"):
        first.awaitTermination(120)
    monkeypatch.setattr(decision_log, "high_risk_alerts", good)
    for _ in range(2):
        query = alert_stream.start_alerts(spark, sinks, checkpoint, 0.3)
        query.awaitTermination(120)
        assert query.exception() is None
    alerts = sorted(map(str, sinks.read(spark, "alerts").collect()))
    scored = sinks.read(spark, "scored_transactions")
    assert 0 < len(alerts) == scored.filter("fraud_probability >= 0.3").count()
    # The pipeline itself writes the same alerts when nothing fails.
    written(spark, sinks, messages[:30], 0, 0)
    assert sorted(map(str, sinks.read(spark, "alerts").collect())) == alerts


def test_retention_removes_rows_and_spares_readers(spark, messages, tmp_path):
    sinks = stream.DecisionSinks(str(tmp_path / "out"))
    target, reports = str(tmp_path / "sent"), str(tmp_path / "reports")
    broken = messages[40:]
    for batch, day in enumerate((0, 20, 28)):
        written(spark, sinks, messages[10 * batch : 10 * batch + 10] + broken, batch, day)
    commits = spark.read.schema(outbox_stream.COMMIT_SCHEMA).parquet(f"{sinks.root}/commits")
    outbox_stream.publish_batch(commits.filter("batch_id = 0"), 0, sinks, target, at(1))
    outbox_stream.publish_batch(commits.filter("batch_id = 1"), 1, sinks, target, at(27))
    stream.compact(spark, sinks)
    for day in (0, 31):
        spark.range(1).select(at(day).alias("generated_at"), F.lit(0.1).alias("drift_share")).coalesce(1).write.mode("append").parquet(reports)
    days = {"scored_transactions": 25, "pipeline_metrics": 5, "model_drift_reports": 10}

    def run(day, **more):
        rows = retention.run_retention(spark, sinks, at(day), reports, days=days, **more).collect()
        return {r["table_name"]: tuple(r)[1:] for r in rows}

    reader = sinks.read(spark, "scored_transactions")
    first = run(31)
    assert first["scored_transactions"] == (30, 10, 20, 0)
    assert first["rejected_transactions"] == (3, 1, 2, 0)
    assert first["outbox"] == (33, 11, 22, 0)
    assert first["pipeline_metrics"][1] > 0 and first["model_drift_reports"] == (2, 1, 1, 1)
    # A reader that began before still finds its files; new ones see the rest, and so does the snapshot.
    assert reader.count() == 30 and sinks.read(spark, "scored_transactions").count() == 20
    assert stream.current_decisions(spark, sinks).count() == 20
    assert sinks.outbox(spark).filter("published_at IS NULL").count() == 11
    again = run(31.1)
    assert again["scored_transactions"] == (20, 0, 20, 0)
    later = run(31.5)
    assert later["scored_transactions"][3] == 2 and later["outbox"][3] == 1 and later["pipeline_metrics"][3] == 2
    assert not (tmp_path / "out/scored_transactions/batch_id=0").exists() and (tmp_path / "out/scored_transactions/batch_id=1").exists()
    # Pending messages outlive everything else.
    last = run(4000, grace=timedelta(0))
    assert last["scored_transactions"][2] == 0 and last["outbox"][2] == 11
    assert stream.current_decisions(spark, sinks).count() == 0


def test_superseded_snapshots_go_after_a_grace(spark, messages, tmp_path):
    sinks = stream.DecisionSinks(str(tmp_path))
    for batch in range(2):
        written(spark, sinks, messages[: 10 + batch], batch, batch)
        stream.compact(spark, sinks)
    soon, late = F.current_timestamp(), F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    assert retention.drop_snapshots(spark, sinks, soon) == 0
    assert retention.drop_snapshots(spark, sinks, late) == 1 and retention.drop_snapshots(spark, sinks, late) == 0
    assert stream.current_decisions(spark, sinks).count() == 11


def test_old_report_files_go(spark, tmp_path):
    for name in ("drift-1.json", "drift-2.html", "other.json"):
        (tmp_path / name).write_text("{}")
    now = F.current_timestamp()
    assert retention.expire_artifacts(spark, str(tmp_path), "drift-", now, 7) == 0
    assert retention.expire_artifacts(spark, str(tmp_path), "drift-", now + F.expr("INTERVAL 8 DAYS"), 7) == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["other.json"]
    assert retention.expire_artifacts(spark, str(tmp_path / "none"), "drift-", now, 7) == 0
