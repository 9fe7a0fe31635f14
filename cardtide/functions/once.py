"""Columns that later steps read instead of repeating their expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(frame: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Add columns behind an ``inline`` of the finished values.

    The optimizer moves filters below projections by copying expressions. With several layers of
    columns that use each other more than once, the copies grow exponentially; ``inline`` stops it.
    """
    staged = [(F.expr(value) if isinstance(value, str) else value).alias(f"__{name}") for name, value in columns.items()]
    finished = F.struct(*[F.col(f"__{name}").alias(name) for name in columns])
    return frame.select("*", *staged).select(*frame.columns, F.inline(F.array(finished)))
