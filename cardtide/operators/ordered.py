"""Exact global order without a single-task sort.

A window without PARTITION BY moves every row to one task. The operators here range-partition
pre-aggregated values, total each range, and add the totals of the earlier ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cardtide.session import checkpointed


def _scan(names: list[str], by: list[str], order: str, sums: list[str], previous: str | None):
    """A pass over one sorted range: totals before each row of its group, and the group's previous order value."""

    def changes(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
        """Where a group begins. The first row is compared with the last one of the batch before."""
        begins = np.zeros(batch.num_rows, bool)
        for name in by:
            codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins[1:] |= codes[1:] != codes[:-1]
        begins[0] = last is None or last != tuple(batch.column(name)[0].as_py() for name in by)
        return begins

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, before_value = None, {name: 0 for name in sums}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, columns = changes(batch, last), list(batch.columns)
            group = np.maximum.accumulate(np.where(begins, np.arange(batch.num_rows), -1))
            for name in sums:
                values = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values)
                earlier = upto - values
                # Rows before the batch's first border go on with the group of the batch before.
                before = np.where(group < 0, earlier + carried[name], earlier - earlier[np.maximum(group, 0)])
                columns.append(pa.array(before, batch.column(name).type))
                carried[name] = before[-1] + values[-1]
            if previous:
                value = batch.column(order)
                shifted = pa.concat_arrays([pa.array([before_value], value.type), value.slice(0, len(value) - 1)])
                columns.append(pc.if_else(pa.array(begins), pa.scalar(None, value.type), shifted))
                before_value = value[len(value) - 1].as_py()
            last = tuple(batch.column(name)[batch.num_rows - 1].as_py() for name in by)
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def running_totals(
    values: DataFrame,
    order: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    previous: str | None = None,
) -> DataFrame:
    """Add ``<name>_before`` for each of ``sums``: its total over all earlier rows of the group.

    With ``previous``, also add a column of that name with the order value of the row before.
    ``values`` must hold one row per (by, order) value, so that a hot value is one row; ``sums`` are
    long or double. The rows are shuffled once, into sorted ranges; each range is scanned as it
    arrives and written once (checkpoint), because a second sampling could cut them differently.
    What earlier ranges add is one row per range and group.
    """
    by = by or []
    key = F.col(order).desc() if descending else F.col(order).asc()
    local = [f"{name}_before" for name in sums] + ([previous] if previous else [])
    kinds = [values.schema[name].dataType for name in sums] + ([values.schema[order].dataType] if previous else [])
    schema = T.StructType([*values.schema.fields, *(T.StructField(name, kind) for name, kind in zip(local, kinds))])
    sorted_ranges = values.repartitionByRange(*by, key).sortWithinPartitions(*by, key)
    scanned = sorted_ranges.mapInArrow(_scan(schema.fieldNames(), by, order, sums, previous), schema)
    ranges = checkpointed(scanned.withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = F.min(order) if descending else F.max(order)
    range_totals = ranges.groupBy(*by, "_range").agg(
        *[F.sum(name).alias(f"_{name}") for name in sums], last.alias("_last")
    )
    # One row per range and group: bounded by the partition count times the number of groups.
    offsets = range_totals.select(
        *[F.col(name).alias(f"_by_{name}") for name in by],
        F.col("_range").alias("_in"),
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_offset") for name in sums],
        F.last("_last").over(earlier).alias("_carried"),
    )
    here = F.col("_range") == F.col("_in")
    for name in by:
        here = here & F.col(name).eqNullSafe(F.col(f"_by_{name}"))
    return ranges.join(F.broadcast(offsets), here).select(
        *values.columns,
        *[(F.col(f"{name}_before") + F.col(f"_{name}_offset")).alias(f"{name}_before") for name in sums],
        *([F.coalesce(previous, "_carried").alias(previous)] if previous else []),
    )


def row_at(values: DataFrame, order: str, count: str, position: int):
    """The (value, rows before it) that holds the row with the given 0-based position."""
    before = F.col(f"{count}_before")
    totals = running_totals(values, order, [count])
    return totals.filter((before <= position) & (before + F.col(count) > position)).first()


def tie_hash(identifier: Column) -> Column:
    """Evenly spread, engine-neutral 48-bit order for rows that share a timestamp."""
    return F.conv(F.substring(F.sha2(identifier.cast("string"), 256), 1, 12), 16, 10).cast("long")


def _day_holding(days, position: int):
    before = 0
    for row in days:
        if before + row["n"] > position:
            return row["day"], before
        before += row["n"]
    return None, before


def time_order_cuts(
    frame: DataFrame, time: str, identifier: str, positions: Callable[[int], list[int]]
) -> list[Column]:
    """For each 0-based position, a filter that holds exactly for the rows before it.

    ``positions`` turns the row count into positions. Order is (time, tie_hash(identifier)). Rows
    are counted per day, then per timestamp inside the one day that holds the position, then per tie
    hash inside one timestamp; no row is sorted or moved, and the result is a plain comparison that
    the scan can use. Rows without a time have no position: they are not counted and no filter holds for them.
    """
    frame = frame.filter(F.col(time).isNotNull())
    # Days in the data, not rows: thousands at most.
    days = frame.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n")).orderBy("day").collect()
    micros = F.unix_micros(time)
    cuts = []
    for position in positions(sum(row["n"] for row in days)):
        day, before = _day_holding(days, position)
        if day is None:
            cuts.append(F.col(time).isNotNull())
            continue
        start = F.lit(day).cast("timestamp")
        in_day = frame.filter((F.col(time) >= start) & (F.col(time) < start + F.expr("INTERVAL 1 DAY")))
        stamps = in_day.groupBy(micros.alias("stamp")).agg(F.count("*").alias("n"))
        stamp = row_at(stamps, "stamp", "n", position - before)
        edge, before = F.timestamp_micros(F.lit(stamp["stamp"])), before + stamp["n_before"]
        cut = F.col(time) < edge
        if before < position:
            ties = in_day.filter(F.col(time) == edge).groupBy(tie_hash(F.col(identifier)).alias("tie"))
            counts = ties.agg(F.count("*").alias("n"))
            tie = row_at(counts, "tie", "n", position - before)["tie"]
            cut = cut | ((F.col(time) == edge) & (tie_hash(F.col(identifier)) < F.lit(tie)))
        cuts.append(cut)
    return cuts


def _edge(counts: DataFrame, unit: str, rows: int, newest: bool):
    """First unit, in order, at which the running count reaches ``rows``; counts are few rows."""
    order = F.col(unit).desc() if newest else F.col(unit).asc()
    reached = counts.withColumn("total", F.sum("n").over(Window.orderBy(order)))
    return reached.filter(F.col("total") >= rows).orderBy(order).first()


def first_rows(frame: DataFrame, rows: int, time: str, identifier: str, newest: bool = False) -> DataFrame:
    """The earliest (or newest) rows by (time, identifier).

    Days, then seconds of the edge day, are counted first, so that only rows which can still be
    chosen reach the final top-k instead of the best ``rows`` rows of every input split.
    """
    known = frame.filter(F.col(time).isNotNull())
    day, second = F.to_date(time), F.unix_seconds(time)
    day_edge = _edge(known.groupBy(day.alias("day")).agg(F.count("*").alias("n")), "day", rows, newest)
    if day_edge is not None:
        in_day = known.filter(day == F.lit(day_edge["day"]))
        still = rows - (day_edge["total"] - day_edge["n"])
        seconds = in_day.groupBy(second.alias("second")).agg(F.count("*").alias("n"))
        start = F.timestamp_seconds(F.lit(_edge(seconds, "second", still, newest)["second"]))
        if newest:
            known = known.filter(F.col(time) >= start)
        else:
            known = known.filter(F.col(time) < start + F.expr("INTERVAL 1 SECOND"))
    order = F.col(time).desc() if newest else F.col(time).asc()
    return known.orderBy(order, F.col(identifier).asc()).limit(rows)
