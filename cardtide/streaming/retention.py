"""The retention job: expire old batches of the log tables, then delete their folders.

Expiring is one row for each table: from then on, ``DecisionSinks.read`` leaves out all batches before its time at once.
All rows of a batch carry the batch's time, so this is exact to the row, and nothing is rewritten. Folders of expired
batches are deleted by a later run, once the row that expired them is older than ``grace``; a reader that listed them
before may still be at work until then. Snapshots of the latest decisions go when a newer one is older than ``grace``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardtide.fixed_values import RETENTION_DAYS
from cardtide.streaming.sinks import DecisionSinks, read_if_present

#: Tables whose rows lie in batch folders, and what goes when they do.
BATCH_TABLES = {"scored_transactions": ["alerts"], "rejected_transactions": [], "pipeline_metrics": [], "outbox": []}
GRACE = timedelta(hours=6)
RESULT = "table_name string, rows_before bigint, expired_rows bigint, rows_after bigint, deleted_folders bigint"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder, or a file, in whatever store it is. False if it is not there."""
    files, path = _store(spark, folder)
    return bool(files.exists(path) and files.delete(path, True))


def _cutoff(now, name: str, days: dict[str, int]):
    return now - timedelta(days=days.get(name, RETENTION_DAYS[name][1]))


def _rows(frame: DataFrame | None) -> int:
    return 0 if frame is None else frame.count()


def _folders_to_delete(spark: SparkSession, sinks: DecisionSinks, name: str, before) -> list[int]:
    """Expired batches whose expiry was entered before the given time, and whose folder is still there."""
    rows = read_if_present(spark, f"{sinks.root}/retention")
    if rows is None:
        return []
    settled = rows.filter((F.col("table_name") == name) & (F.col("entered_at") <= F.lit(before))).agg(F.max("cutoff")).first()[0]
    batches = sinks.batch_times(spark, name)
    stored = read_if_present(spark, f"{sinks.root}/{name}")
    if settled is None or batches is None or stored is None:
        return []
    here = stored.select(F.col("batch_id").cast("bigint").alias("batch_id")).distinct()
    found = batches.filter(F.col("batch_time") < F.lit(settled)).join(here, "batch_id", "left_semi")
    # One short number for each batch that a run deletes.
    return [row["batch_id"] for row in found.select("batch_id").collect()]


def expire_tables(
    spark: SparkSession, sinks: DecisionSinks, now: Column, days: dict[str, int] | None = None, grace: timedelta = GRACE
) -> list[tuple]:
    """Expire the log tables' old batches and delete what earlier runs expired. One tuple (see RESULT) a table."""
    moment = spark.range(1).select(now.cast("timestamp")).first()[0]
    result = []
    for name, followers in BATCH_TABLES.items():
        cutoff = _cutoff(moment, name, days or {})
        before = _rows(sinks.read(spark, name))
        entry = spark.range(1, numPartitions=1).select(
            F.lit(name).alias("table_name"), F.lit(cutoff).alias("cutoff"), F.lit(moment).alias("entered_at")
        )
        known = sinks.expired_before(spark, name)
        if known is None or known < cutoff:
            entry.write.mode("append").parquet(f"{sinks.root}/retention")
        after = _rows(sinks.read(spark, name))
        gone = [batch for batch in _folders_to_delete(spark, sinks, name, moment - grace)]
        deleted = sum(delete_folder(spark, f"{sinks.root}/{name}/batch_id={batch}") for batch in gone)
        for follower in followers:
            deleted += sum(delete_folder(spark, f"{sinks.root}/{follower}/batch_id={batch}") for batch in gone)
        result.append((name, before, before - after, after, deleted))
    return result


def expire_reports(spark: SparkSession, reports: str, now: Column, days: dict[str, int] | None = None) -> tuple:
    """Delete drift reports that are too old. ``run_report`` writes a file for each report, so whole files go.

    A file that also holds a younger report stays until that is too old as well.
    """
    rows = read_if_present(spark, reports)
    if rows is None:
        return ("model_drift_reports", 0, 0, 0, 0)
    moment = spark.range(1).select(now.cast("timestamp")).first()[0]
    cutoff = _cutoff(moment, "model_drift_reports", days or {})
    files = rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.max("generated_at").alias("newest"))
    total = rows.count()
    old = files.filter(F.col("newest") < F.lit(cutoff)).collect()
    deleted = [row["n"] for row in old if delete_folder(spark, row["file"])]
    spark.catalog.refreshByPath(reports)
    return ("model_drift_reports", total, sum(deleted), total - sum(deleted), len(deleted))


def expire_artifacts(spark: SparkSession, folder: str, prefix: str, now: Column, days: int) -> int:
    """Delete entries of a folder whose names begin with ``prefix`` and that have not changed for so many days."""
    files, path = _store(spark, folder)
    if not files.exists(path):
        return 0
    moment = spark.range(1).select(F.unix_millis(now.cast("timestamp"))).first()[0]
    limit = moment - days * 86_400_000
    entries = [entry for entry in files.listStatus(path) if entry.getPath().getName().startswith(prefix)]
    return sum(bool(files.delete(entry.getPath(), True)) for entry in entries if entry.getModificationTime() < limit)


def drop_snapshots(spark: SparkSession, sinks: DecisionSinks, now: Column, grace: timedelta = GRACE) -> int:
    """Delete snapshots that a newer one replaced more than ``grace`` ago."""
    commits = read_if_present(spark, f"{sinks.root}/snapshot_commits")
    if commits is None:
        return 0
    settled = commits.filter(F.col("folded_at") <= now.cast("timestamp") - F.expr(f"INTERVAL {int(grace.total_seconds())} SECONDS"))
    newest = settled.agg(F.max("upto")).first()[0]
    if newest is None:
        return 0
    older = [row["upto"] for row in commits.filter(F.col("upto") < newest).select("upto").distinct().collect()]
    return sum(delete_folder(spark, f"{sinks.root}/decision_snapshots/upto={upto}") for upto in older)


def run_retention(
    spark: SparkSession,
    sinks: DecisionSinks,
    now: Column,
    reports: str | None = None,
    details: str | None = None,
    days: dict[str, int] | None = None,
    grace: timedelta = GRACE,
) -> DataFrame:
    """One run over all five tables: rows before, expired and after, and folders deleted.

    An unpublished message never expires, whatever its age. Running the job again with the same time changes nothing but
    deletes the folders whose grace is over. A failed run is repeated as a whole.
    """
    result = expire_tables(spark, sinks, now, days, grace)
    if reports:
        result.append(expire_reports(spark, reports, now, days))
    if details:
        kept = (days or {}).get("model_drift_reports", RETENTION_DAYS["model_drift_reports"][1])
        result.append(("report_files", 0, 0, 0, expire_artifacts(spark, details, "drift-", now, kept)))
    drop_snapshots(spark, sinks, now, grace)
    return spark.createDataFrame(result, RESULT)
