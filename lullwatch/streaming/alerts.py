"""Streaming alerts: channels that have just become critical, with a cooldown, capped per snapshot.

What a batch must know is one moment per channel, its last critical snapshot. These moments are a small table that a batch reads from one slot and
writes to the other, so a repeated batch starts from the same moments. Moments older than the cooldown and the allowed lateness are dropped: channels that have fallen
silent take no room. All of it is windows and joins; a batch is one job per table it writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lullwatch.plans.serving import has_level, hours, slice_notifications
from lullwatch.spec import RiskBounds

OUT = "id long, channel_id long, at timestamp, prob double"
STATE = "channel_id long, last timestamp, newest timestamp, batch long"


def alert_batch(preds: DataFrame, batch_id: int, path: str, cooldown_h: int, lateness_h: int, bounds: RiskBounds | None, per_slice: int) -> None:
    """New critical predictions of a batch to ``alerts``, up to ``per_slice`` notices per snapshot and a summary to ``notices``, the moments to ``state``."""
    spark = preds.sparkSession
    known = spark.createDataFrame([], STATE) if batch_id == 0 else spark.read.schema(STATE).parquet(f"{path}/state/slot={(batch_id - 1) % 2}")
    critical = preds.filter(has_level(["critical"], bounds)).select("id", "channel_id", "at", "prob").persist()
    try:
        # the last critical moment seen before a row: stored, or earlier in the batch
        before = F.max("at").over(Window.partitionBy("channel_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
        rows = critical.withColumn("_before", before).join(known.select("channel_id", "last"), "channel_id", "left")
        seen = F.greatest("_before", "last")
        fresh = rows.filter(seen.isNull() | (seen < F.col("at") - hours(cooldown_h))).select("id", "channel_id", "at", "prob")
        fresh.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        slice_notifications(spark.read.schema(OUT).parquet(f"{path}/alerts/batch={batch_id}"), per_slice).write.mode("overwrite").parquet(f"{path}/notices/batch={batch_id}")
        moments = known.select("channel_id", "last", "newest").unionByName(critical.select("channel_id", F.col("at").alias("last"), F.col("at").alias("newest")))
        newest = F.greatest(known.agg(F.max("newest")).scalar(), preds.agg(F.max("at")).scalar())
        state = moments.groupBy("channel_id").agg(F.max("last").alias("last")).withColumn("newest", newest).withColumn("batch", F.lit(batch_id).cast("long"))
        state.filter(F.col("last") >= F.col("newest") - hours(cooldown_h + lateness_h)).write.mode("overwrite").parquet(f"{path}/state/slot={batch_id % 2}")
    finally:
        critical.unpersist()


def alert_stream(preds: DataFrame, path: str, checkpoint: str, cooldown_h: int = 24, lateness_h: int = 24, bounds: RiskBounds | None = None,
                 per_slice: int = 5, **trigger) -> StreamingQuery:
    """Alerts of a stream of predictions. Snapshots may come in any order; ones more than ``lateness_h`` behind the newest are judged by the moments still kept."""
    return preds.writeStream.foreachBatch(lambda df, i: alert_batch(df, i, path, cooldown_h, lateness_h, bounds, per_slice)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(spark, path: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(f"{path}/alerts")
