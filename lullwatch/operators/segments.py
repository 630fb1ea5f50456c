"""Piecewise linear functions given as a table of points."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_POINTS = 1_000_000


def segments_of(points: DataFrame) -> DataFrame:
    """``seg, x0, x1, y0, y1`` of points ``(x, y)``, sorted by x, then y. Points of one x are a step: the lower segment ends at the first, the upper starts at the last.

    Segment 0 lies below the first point, segment k between the k-th distinct x and the next, the last one above all.
    """
    steps = points.dropna().groupBy("x").agg(F.min(F.struct("pos", "y")).alias("a"), F.max(F.struct("pos", "y")).alias("b"))
    w = Window.orderBy("x")  # a row per breakpoint, at most MOST_POINTS
    table = steps.select(F.row_number().over(w).alias("seg"), F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.col("b.y").alias("y0"),
                         F.lead("a.y").over(w).alias("y1"), F.col("a.y").alias("first"))
    below = table.filter("seg = 1").select(F.lit(0).alias("seg"), F.lit(None).cast("double").alias("x0"), "x0", F.col("first").alias("y0"), F.col("first").alias("y1"))
    return below.toDF("seg", "x0", "x1", "y0", "y1").unionByName(table.select("seg", "x0", "x1", "y0", F.coalesce("y1", "y0").alias("y1")))


def points_table(spark: SparkSession, xs, ys) -> DataFrame:
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "pos long, x double, y double")


def interpolate_by(df: DataFrame, x: str, points: DataFrame, out: str) -> DataFrame:
    """``out``: the value at ``x`` of the line through ``points`` (``pos, x, y``; ``pos`` orders points of one x), constant outside them; NULL stays NULL.

    The breakpoints (at most ``MOST_POINTS``, 8 MB) become the splits of a ``Bucketizer``, which finds a row's segment by binary search; the segment's two ends come from
    the table by an equi-join, which is a broadcast of as many rows.
    """
    table = segments_of(points)
    xs = [r[0] for r in table.filter("seg > 0").select("x0").orderBy("seg").limit(MOST_POINTS + 1).collect()]
    if not xs or len(xs) > MOST_POINTS:
        raise ValueError(f"a line needs 1 to {MOST_POINTS} breakpoints")
    # Bucketizer's intervals are closed below, ours above: it looks for -x among the negated breakpoints
    splits = [float("-inf"), *[-v for v in reversed(xs)], float("inf")]
    known = df.withColumn("_neg", -F.col(x).cast("double"))
    filled = known.withColumn("_neg", F.coalesce("_neg", F.lit(0.0)))
    found = Bucketizer(splits=splits, inputCol="_neg", outputCol="_at", handleInvalid="keep").transform(filled)
    found = found.withColumn("seg", F.when(F.col(x).isNotNull(), F.lit(len(xs)) - F.col("_at").cast("int")))
    joined = found.join(F.broadcast(table.select("seg", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")])), "seg", "left")
    slope = (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    value = F.when(F.col("_x0").isNull() | F.col("_x1").isNull(), F.col("_y0")).otherwise(F.col("_y0") + (F.col(x) - F.col("_x0")) * slope)
    return joined.withColumn(out, value).select(*df.columns, out)
