"""Column builders for bounded frames and small frame-based programs.

Frames here run over rows that are already aggregated to one row per key and hour or day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


TASK_ROWS = 500_000
"""Rows that one task of a sorted pass is meant to hold: some 300 MB of wide counter rows."""


def dealt(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int | None = None) -> DataFrame:
    """``df`` of about ``rows`` rows by ``keys`` in as many partitions as keep a task near ``task_rows`` rows, whatever the session's number of partitions.

    A pass that needs no more tasks than there are cores is left to Spark.
    """
    n = -(-rows // (TASK_ROWS if task_rows is None else task_rows))
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


def preceding(keys: Sequence[str], order: str, rows: int) -> WindowSpec:
    """The ``rows`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)


def running(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lag_by(value: Column | str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def last_where(value: Column, condition: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Previous value among rows that satisfy the condition."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(condition, value), ignorenulls=True).over(w)


def running_sum(value: Column | str, keys: Sequence[str], order: str) -> Column:
    return F.sum(value).over(running(keys, order))


def history_len(keys: Sequence[str], order: str, limit: int) -> Column:
    return F.least(F.count(F.lit(1)).over(running(keys, order)) - 1, F.lit(limit))


def variation(value: Column | str, spec: WindowSpec) -> Column:
    """Coefficient of variation over a frame, NULL when the mean is zero."""
    return F.try_divide(F.stddev_pop(value).over(spec), F.avg(value).over(spec))


def sliding_list(lists: Column | str, spec: WindowSpec) -> Column:
    """All elements of the frame's lists, largest first."""
    return F.sort_array(F.flatten(F.collect_list(lists).over(spec)), asc=False)


def trailing_median(df: DataFrame, order: str, value: str, rows: int, out: str) -> DataFrame:
    """Median of the ``rows`` values before each row of one calendar series (one row per hour, no key)."""
    w = Window.orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(w))


def hour_islands(df: DataFrame, keys: Sequence[str], hour: str) -> DataFrame:
    """Adds ``island``: rows of consecutive hours share it."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(hour) if keys else Window.orderBy(hour))
    return df.withColumn("island", F.unix_timestamp(hour) / 3600 - rn)


def day_islands(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Adds ``island``: rows of consecutive days share it."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    return df.withColumn("island", F.date_sub(F.col(day), rn))


def clusters(df: DataFrame, keys: Sequence[str], x: str, gap: float, min_size: int, aggs: Sequence[Column]) -> DataFrame:
    """Groups of positions where neighbours are at most ``gap`` apart; groups below ``min_size`` are dropped.

    Rows of one position are combined first, so the window walks distinct positions of a key.
    """
    places = df.select(*keys, x).distinct()
    w = Window.partitionBy(*keys).orderBy(x)
    places = places.withColumn("_new", (F.col(x) - F.lag(x).over(w) > gap).cast("int"))
    places = places.withColumn("cluster", F.sum(F.coalesce("_new", F.lit(0))).over(running(keys, x))).drop("_new")
    return (
        df.join(places, [*keys, x]).groupBy(*keys, "cluster")
        .agg(F.min(x).alias("x_from"), F.max(x).alias("x_to"), F.count(F.lit(1)).alias("size"), *aggs)
        .filter(F.col("size") >= min_size)
    )


def row_ids(df: DataFrame, order: Sequence[str], out: str, start: Column | int = 0, band: Column | None = None, block: Column | None = None) -> DataFrame:
    """Consecutive ids in a total order without a task that sees all rows or all groups.

    Rows are counted per group, a value of ``order[0]`` and ``band``; the counts become offsets in two levels: groups within a block, blocks among each other. Numbering
    runs inside a group. ``band`` must grow with ``order[1]``; it splits a moment that holds many rows. ``block`` must grow with ``order[0]`` and take few values:
    by default the month of a moment, or the upper part of a number.
    """
    first, rest = order[0], list(order[1:])
    kind = df.schema[first].dataType
    if block is None:
        block = F.date_trunc("month", first) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.floor(F.col(first) / (1 << 32)) if isinstance(
            kind, T.NumericType) else F.left(F.col(first).cast("string"), F.lit(2))
    df = df.withColumns({"_band": F.lit(0) if band is None else band, "_block": block})
    group = ["_block", first, "_band"]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).select("_block", before(Window.orderBy("_block")).alias("_base"))  # a row a month
    inside = counts.select(*group, before(Window.partitionBy("_block").orderBy(first, "_band")).alias("_off"))
    offsets = inside.join(blocks, "_block")
    inner = F.row_number().over(Window.partitionBy(*group).orderBy(*(rest or [first])))
    start = F.lit(start) if isinstance(start, int) else start
    return df.join(offsets, group).withColumn(out, start + F.col("_base") + F.col("_off") + inner).drop("_off", "_base", "_band", "_block")


def id_band(column: str, width: int = 65536) -> Column:
    """Band of a numeric id for ``row_ids``."""
    return F.floor(F.col(column) / width)
