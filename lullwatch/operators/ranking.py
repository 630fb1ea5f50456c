"""Top-k, pages, latest-per-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a report in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_counts(df: DataFrame, keys: Sequence[str], n: int, aggs: Sequence[Column] = ()) -> DataFrame:
    """The ``n`` most frequent key values with their counts; ties by key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return counted.orderBy(F.desc("n"), *keys).limit(n)


def top_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Rows ranked at most ``k`` inside their group (Spark limits each group before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Latest row per key by ``order``: an aggregate with map-side combine, not a window."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max(packed).alias("_last")).select(*keys, *[F.col(f"_last.{c}") for c in columns])


def heads_and_rest(df: DataFrame, key: str, order: Sequence[Column], k: int, id_col: str) -> DataFrame:
    """Per group the first ``k`` rows, and one summary row for the rest: its best row and how many there are.

    Group sizes come from a combined count; only ranks up to ``k + 1`` leave the window.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    ranked = top_rank(df, [key], order, k + 1, "pos")
    joined = ranked.join(sizes, key)
    head = F.col("pos") <= k
    return joined.select(
        key, F.col(id_col), F.when(head, "single").otherwise("summary").alias("item"),
        F.when(head, F.lit(1)).otherwise(F.col("_size") - k).cast("long").alias("count"), "pos",
    )
