"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cardtide.plans import catalogue  # noqa: E402
from cardtide.session import build_session  # noqa: E402
from cardtide.streaming import decision_stream as stream  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "txn_features",
    "scored_heuristic",
    "mart_daily_segment",
    "mart_segment",
    "threshold_sweep",
    "optimal_thresholds",
    "policy_metrics",
    "roc_auc",
    "window_metadata",
    "drift_features",
    "upsert_latest",
    "outbox_new",
    "dead_letters",
    "risk_drivers",
    "template_explanations",
    "replay_schedule",
    "metrics_10s",
    "simulation_rows",
    "gbt_metrics",
]


def main() -> None:
    spark = build_session(
        "cardtide-bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.mart_daily_segment(spark, FOLDER).collect()  # warm-up

    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    rows = catalogue.card_rows(spark, FOLDER).count()
    start = time.perf_counter()
    catalogue.decision_table(spark, FOLDER).write.format("noop").mode("overwrite").save()
    batch = rows / (time.perf_counter() - start)

    root = tempfile.mkdtemp(prefix="cardtide-bench-")
    stream.write_replay(catalogue.all_events(spark, FOLDER), f"{root}/in", int(CPUS))
    start = time.perf_counter()
    query = stream.start(
        stream.message_files(spark, f"{root}/in"), stream.DecisionSinks(f"{root}/out"), f"{root}/checkpoint"
    )
    query.awaitTermination(900)
    elapsed = time.perf_counter() - start
    times["stream_available_now"] = round(elapsed, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "batch_rows_per_second": round(batch),
                "stream_rows_per_second": round(rows / elapsed),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
