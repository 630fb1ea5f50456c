"""Set programs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_padded(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*keys) for f in frames]).distinct()


def set_difference_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and added between two versions of a table (duplicates count), in one aggregation.

    ``same`` is true when a replacement left the rows as they were.
    """
    cols = before.columns
    both = before.select(*cols, F.lit(1).alias("_d")).unionByName(after.select(*cols, F.lit(-1).alias("_d")))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("added"),
    ).withColumn("same", (F.col("lost") == 0) & (F.col("added") == 0))
