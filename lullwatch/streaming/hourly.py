"""Hourly counters of the history chart, kept up to date by a stream of landed events of any lateness.

A batch is aggregated per channel and hour, and the sums are added to the cells of the table, which is partitioned by day: only the
days that the batch falls on are read and written, however old they are. Landed rows are free of duplicates, so adding is exact. A cell remembers
the last batch it has taken; a repeated batch skips the cells that have it. Rows later than ``lateness`` behind the newest event of the batches before
are counted, not dropped. ``rebuild_days`` makes the cells of some days anew from the landing table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lullwatch.sources.merge import days_of, ensure_table, read_days, replace_days
from lullwatch.spec import JournalSpec
from lullwatch.streaming.ingest import as_journal, read_landing

SUMS = ("events_count", "alarm_count", "fault_count", "uncertain_count", "value_count", "value_sum", "late_count")
CELLS = ("ch long, hour timestamp, events_count long, alarm_count long, fault_count long, uncertain_count long, value_count long, value_sum double, "
         "late_count long, value_min double, value_max double, batch long, day date")
COUNTERS = "rows long, late_rows long, cells long, repaired_cells long, last_ts timestamp, batch long"


def cells_of(events: DataFrame, spec: JournalSpec, late: Column) -> DataFrame:
    return events.groupBy("ch", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("events_count"), F.count_if("is_alarm").alias("alarm_count"),
        F.count_if(F.col("txt").isin(*spec.fault_statuses)).alias("fault_count"),
        F.count_if(F.col("txt") == spec.uncertain[0]).alias("uncertain_count"),
        F.count("num").alias("value_count"), F.coalesce(F.sum("num"), F.lit(0.0)).alias("value_sum"), F.count_if(late).alias("late_count"),
        F.min("num").alias("value_min"), F.max("num").alias("value_max")).withColumn("day", F.to_date("hour"))


def add_batch(batch: DataFrame, batch_id: int, hours: str, counters: str, spec: JournalSpec, lateness: timedelta) -> None:
    """``batch``: landed events (journal columns) that no earlier batch held."""
    spark = batch.sparkSession
    before = spark.read.schema(COUNTERS).parquet(counters).filter(F.col("batch") < batch_id).agg(F.max("last_ts")).first()[0]
    late = F.lit(False) if before is None else F.col("ts") < F.lit(before - lateness)
    new = cells_of(batch, spec, late).persist()
    try:
        days = days_of(new)
        old = read_days(spark, hours, CELLS, days)
        has = F.col("o.ch").isNotNull() & F.col("n.ch").isNotNull()
        totals = new.agg(F.coalesce(F.sum("events_count"), F.lit(0)).alias("rows"), F.coalesce(F.sum("late_count"), F.lit(0)).alias("late_rows"),
                         F.count(F.lit(1)).alias("cells"), F.count_if(F.col("late_count") > 0).alias("repaired_cells"))
        totals.withColumn("last_ts", batch.agg(F.max("ts")).scalar()).write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")
        if days:
            both = old.alias("o").join(new.alias("n"), [F.col("o.day") == F.col("n.day"), F.col("o.ch") == F.col("n.ch"), F.col("o.hour") == F.col("n.hour")], "full")
            adds = F.col("n.ch").isNotNull() & F.coalesce(F.col("o.batch") < batch_id, F.lit(True))
            value = lambda c, put: F.when(~adds, F.col(f"o.{c}")).when(has, put(F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(F.col(f"n.{c}")).alias(c)
            same = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
            merged = both.select(same("ch"), same("hour"), *[value(c, lambda a, b: a + b) for c in SUMS], value("value_min", F.least), value("value_max", F.greatest),
                                 F.when(adds, F.lit(batch_id)).otherwise(F.col("o.batch")).cast("long").alias("batch"), same("day"))
            replace_days(merged, hours)
    finally:
        new.unpersist()


def hourly_stream(landed: DataFrame, hours: str, counters: str, checkpoint: str, spec: JournalSpec, lateness: timedelta = timedelta(hours=2),
                  **trigger) -> StreamingQuery:
    """Keep the table ``hours`` of a stream of the landing table (``LANDING`` columns); counters of each batch go to ``counters``."""
    ensure_table(landed.sparkSession, hours, CELLS, "day")
    ensure_table(landed.sparkSession, counters, COUNTERS, "batch")
    return (
        as_journal(landed).writeStream.foreachBatch(lambda df, i: add_batch(df, i, hours, counters, spec, lateness))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_hours(spark: SparkSession, hours: str) -> DataFrame:
    cells = spark.read.schema(CELLS).parquet(hours)
    return cells.withColumn("value_avg", F.try_divide(F.col("value_sum"), F.col("value_count"))).drop("value_sum", "value_count", "batch")


def rebuild_days(spark: SparkSession, landing: str, hours: str, days: Sequence[date], spec: JournalSpec, batch_id: int = -1) -> None:
    """Cells of some days from all their landed events. ``batch_id``: the last batch of the stream that they contain."""
    events = as_journal(read_landing(spark, landing).filter(F.col("day").isin(list(days))))
    replace_days(cells_of(events, spec, F.lit(False)).withColumn("batch", F.lit(batch_id).cast("long")).select(*[c.split()[0] for c in CELLS.split(", ")]), hours)
