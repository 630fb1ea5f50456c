"""Serving tables: daily roll-up, recent events, fault marks, predictions and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullwatch.operators.windows import id_band, row_ids
from lullwatch.plans.journal import channel_daily
from lullwatch.plans.serving import last_events, snapshot_moments


def thin_predictions(preds: DataFrame, hourly_from: str, step_hours: int) -> DataFrame:
    """Every hour from a date on, every n-th hour before it."""
    return preds.filter((F.col("at") >= F.lit(hourly_from).cast("timestamp")) | (F.hour("at") % step_hours == 0))


def recent_events(events: DataFrame, channels: DataFrame, data_end: str, days: int) -> DataFrame:
    """The last days of the journal for known channels, texts whole."""
    end = F.lit(data_end).cast("timestamp")
    e = events.filter((F.col("ts") >= end - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") < end))
    known = channels.select(F.col("id").alias("ch"))
    return e.join(known, "ch", "left_semi").select(
        "event_id", F.col("ch").alias("channel_id"), "ts", "is_alarm", F.col("raw").alias("value_raw"),
        F.col("num").alias("value_num"), F.col("txt").alias("value_text"))


def channel_faults(faults: DataFrame, channels: DataFrame, d_from: str, data_end: str, keep: Column | None = None) -> DataFrame:
    f = faults.filter((F.col("ts") >= F.lit(d_from).cast("timestamp")) & (F.col("ts") < F.lit(data_end).cast("timestamp")))
    f = f if keep is None else f.filter(keep)
    return f.join(channels.select(F.col("id").alias("ch")), "ch", "left_semi").select(
        F.col("ch").alias("channel_id"), "ts", "kind").distinct()


def publish_serving(path: str, hourly: DataFrame, events: DataFrame, faults: DataFrame, scored: DataFrame, channels: DataFrame,
                    data_end: str, daily_from: str, hourly_from: str, step_hours: int = 6, recent_days: int = 30) -> None:
    """Write the serving tables as Parquet, partitioned by the day they are asked for, and two small indexes: snapshots, and the last events of channel-days."""
    known = channels.select(F.col("id").alias("ch"))
    daily = channel_daily(hourly.filter(F.col("hour") >= F.lit(daily_from).cast("timestamp")).join(known, "ch", "left_semi"))
    daily.write.mode("overwrite").partitionBy("day").parquet(f"{path}/channel_daily")
    recent_events(events, channels, data_end, recent_days).withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy(
        "day").parquet(f"{path}/events_recent")
    channel_faults(faults, channels, daily_from, data_end).withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy(
        "day").parquet(f"{path}/channel_faults")
    preds = row_ids(thin_predictions(scored, hourly_from, step_hours).drop("id"), ["at", "channel_id"], "id", band=id_band("channel_id")).withColumn("day", F.to_date("at"))
    outcome = ("happened", "fault_at", "fault_kind")
    preds.drop(*outcome).write.mode("overwrite").partitionBy("day").parquet(f"{path}/predictions")
    preds.filter(F.col("happened").isNotNull()).select(
        F.col("id").alias("prediction_id"), F.col("happened").cast("boolean").alias("happened"), "fault_at", "fault_kind",
        (F.col("at") + F.expr("INTERVAL 24 HOURS")).alias("labeled_at"), "day",
    ).write.mode("overwrite").partitionBy("day").parquet(f"{path}/prediction_outcomes")
    # the indexes: a row per snapshot, a row per channel and day
    spark = scored.sparkSession
    snapshot_moments(spark.read.parquet(f"{path}/predictions")).coalesce(1).write.mode("overwrite").parquet(f"{path}/prediction_moments")
    last_events(events.join(known, "ch", "left_semi")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/events_day_last")
