"""Parquet tables of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_events(events: DataFrame, path: str) -> None:
    """Journal by year and month, sorted by moment and channel inside files; a rewrite replaces only the months it holds.

    Rows are gathered by month and rebalanced: Spark cuts a large month into as many writers as its bytes ask for, and joins small ones.
    """
    e = events.withColumns({"year": F.year("ts"), "month": F.month("ts")}).hint("rebalance", "year", "month")
    e.sortWithinPartitions("year", "month", "ts", "ch").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_events(spark: SparkSession, path: str, year_from: int) -> DataFrame:
    """Journal from a year on; older years are not listed."""
    return spark.read.parquet(path).filter(F.col("year") >= year_from)


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction files of several versions: columns are matched by name, missing ones are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_slices(spark: SparkSession, path: str, t_from: str, t_to: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Eligible slices of a period with a known label; the filters and the columns reach the scan."""
    df = spark.read.parquet(path).filter(
        F.col("T").between(F.lit(t_from).cast("timestamp"), F.lit(t_to).cast("timestamp")) & F.col("eligible") & F.col("y").isNotNull())
    return df.select(*columns) if columns else df
