"""Isotonic regression by distributed pooling of adjacent violators.

Points are range-partitioned by score, and each range pools its own violators. Two neighbouring ranges then pool again,
which only touches blocks at their border, and so on pairwise until one range is left: pooling is associative, so the
result is that of one pass over all points. What a merge holds is blocks, not points. For 0/1 labels, n rows leave at
most about 1.5 n^(2/3) blocks, because their means are different fractions whose denominators add up to n.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardtide.session import checkpointed

BLOCKS = "range long, first double, last double, total double, weight double"
_NAMES = ["range", "first", "last", "total", "weight"]


def pooled(points: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (first, last, total, weight) of rising mean, from blocks in order of score."""
    blocks: list[list[float]] = []
    for first, last, total, weight in points:
        block = [first, last, total, weight]
        while blocks and blocks[-1][2] * block[3] >= block[2] * blocks[-1][3]:
            before = blocks.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        blocks.append(block)
    return blocks


def _batch(number: int, blocks: list[list[float]]) -> pa.RecordBatch:
    columns = [pa.array([number] * len(blocks), pa.int64()), *[pa.array([b[k] for b in blocks], pa.float64()) for k in range(4)]]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def pooled_blocks(points: DataFrame, ranges: int | None = None) -> DataFrame:
    """Blocks of all points, as ``first`` and ``last`` score, ``total`` of the labels and ``weight``.

    ``points`` has one row per score: ``score``, ``total``, ``weight``. Scores that are null or NaN and weights that are
    not positive are left out.
    """
    usable = points.filter("score IS NOT NULL AND NOT isnan(score) AND weight > 0")
    spread = usable.repartitionByRange(ranges, "score") if ranges else usable.repartitionByRange("score")
    # Written once, as a second sampling could cut the ranges differently.
    placed = checkpointed(
        spread.sortWithinPartitions("score").select(
            F.spark_partition_id().cast("long").alias("range"), *[F.col(name).cast("double") for name in ("score", "total", "weight")]
        )
    )

    def within(batches) -> Iterator[pa.RecordBatch]:
        blocks, number = [], 0
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            number = columns[0][0] if columns[0] else number
            blocks = pooled([*blocks, *zip(columns[1], columns[1], columns[2], columns[3])])
        yield _batch(number, blocks)

    def across(table: pa.Table) -> pa.Table:
        rows = table.sort_by("first").to_pydict()
        number = rows["range"][0] if rows["range"] else 0
        merged = pooled(zip(*[rows[name] for name in _NAMES[1:]]))
        return pa.Table.from_batches([_batch(number, merged)])

    blocks = placed.mapInArrow(within, BLOCKS)
    left = placed.agg(F.max("range")).first()[0] or 0
    while left > 0:
        left >>= 1
        pairs = blocks.withColumn("range", F.shiftright("range", 1))
        blocks = pairs.groupBy("range").applyInArrow(across, BLOCKS)
    return blocks.drop("range")


def block_ends(blocks: DataFrame) -> DataFrame:
    """Each block as the points of its first and last score, with its mean and half of its weight each."""
    mean = F.col("total") / F.col("weight")
    ends = F.array_distinct(F.array("first", "last"))
    return blocks.select(F.explode(ends).alias("score"), mean.alias("mean"), (F.col("weight") / F.size(ends)).alias("weight"))
