"""Column and join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later expressions read many times.

    The values leave a generator of one row, so the optimizer computes them once and does not copy their expressions
    into every place that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def by_shuffle(side: DataFrame) -> DataFrame:
    """One side of a join that is never broadcast.

    Spark estimates a side from its compressed files: a row per prediction or channel can look small enough for the driver and be many times larger there.
    """
    return side.hint("merge")
