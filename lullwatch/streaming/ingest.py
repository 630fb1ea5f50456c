"""Streaming ingest into the landing table: cleaning, unknown channels, duplicates, counters per batch; outcome labels after each batch.

The landing table is partitioned by the day of the event. A duplicate ``(channel, ts, value)`` is refused at any lateness: each batch is
compared with the landing rows of its own days, and only those partitions are read. Of repeated rows the first stays, by event number. A repeated
batch appends what is not there yet and keeps the counters its first run has written.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lullwatch.plans.serving import label_outcomes
from lullwatch.sources.imports import clean_events, known_channels, new_events
from lullwatch.sources.merge import days_of, ensure_table, read_days
from lullwatch.spec import JournalSpec

LANDING = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("channel_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("is_alarm", T.BooleanType()), T.StructField("value_raw", T.StringType()), T.StructField("value_num", T.DoubleType()),
    T.StructField("value_text", T.StringType()), T.StructField("day", T.DateType()),
])
COUNTERS = "received long, unknown long, invalid long, accepted long, duplicates long, batch long"
OUTCOMES = "prediction_id long, happened boolean, fault_at timestamp, fault_kind string, day date"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).parquet(path)


def ingest_batch(batch: DataFrame, batch_id: int, channels: DataFrame, landing: str, counters: str) -> None:
    """One micro-batch: clean, refuse, append what is new, and write the counters of the batch."""
    spark = batch.sparkSession
    checked = known_channels(clean_events(batch), channels).withColumn("day", F.to_date("ts"))
    checked = checked.persist()  # the batch is read for its days, for the counters and for the append
    try:
        good = checked.filter(F.col("error").isNull())
        fresh = new_events(good, read_days(spark, landing, LANDING, days_of(good))).select(*LANDING.fieldNames()).persist()
        error = F.col("error")
        ensure_table(spark, counters, COUNTERS, "batch")
        if spark.read.schema(COUNTERS).parquet(counters).filter(F.col("batch") == batch_id).isEmpty():
            # counters first: the append changes what counts as new
            checked.agg(
                F.count(F.lit(1)).alias("received"),
                F.count_if(F.coalesce(error == "channel is not in the dictionary", F.lit(False))).alias("unknown"),
                F.count_if(error.isNotNull() & (error != "channel is not in the dictionary")).alias("invalid"),
                F.count_if(error.isNull()).alias("valid"),
            ).withColumn("accepted", fresh.agg(F.count(F.lit(1))).scalar()).withColumn(
                "duplicates", F.col("valid") - F.col("accepted")).drop("valid").write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")
        fresh.write.mode("append").partitionBy("day").parquet(landing)
        fresh.unpersist()
    finally:
        checked.unpersist()


def ingest_stream(source: DataFrame, channels: DataFrame, landing: str, counters: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``source`` has raw ``event_id, channel_id, ts, is_alarm, value`` columns."""
    ensure_table(source.sparkSession, landing, LANDING, "day")
    return (
        source.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, channels, landing, counters))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def landed_events(spark: SparkSession, landing: str, spec: JournalSpec) -> DataFrame:
    """Landing rows in the column names of the journal."""
    return as_journal(read_landing(spark, landing))


def as_journal(landed: DataFrame) -> DataFrame:
    return landed.select("event_id", F.col("channel_id").alias("ch"), "ts", "is_alarm", F.col("value_raw").alias("raw"),
                         F.col("value_num").alias("num"), F.col("value_text").alias("txt"), "day")


def recent_days(landing: DataFrame, end: str, days: int) -> DataFrame:
    """Retention: the last days of the landing table, by partition."""
    last = F.lit(end).cast("date")
    return landing.filter((F.col("day") >= F.date_sub(last, days)) & (F.col("day") < last))


def open_days(spark: SparkSession, moments: str, outcomes: str, until) -> list[date]:
    """Days with predictions whose horizon has closed by ``until`` and that are not all labelled: counts of two small tables by day.

    ``moments``: one row per snapshot (``day, at, n, horizon_h``). Outcomes are counted by partition.
    """
    closed = spark.read.parquet(moments).filter(F.col("at") + F.make_dt_interval(hours=F.col("horizon_h")) <= F.lit(until)).groupBy("day").agg(F.sum("n").alias("n"))
    done = spark.read.schema(OUTCOMES).parquet(outcomes).groupBy("day").agg(F.count(F.lit(1)).alias("done"))
    left = closed.join(done, "day", "left").filter(F.coalesce("done", F.lit(0)) < F.col("n"))
    return sorted(r["day"] for r in left.select("day").collect())


def label_batch(spark: SparkSession, until, landing: str, predictions: str, moments: str, faults: str, outcomes: str, now: str, spec: JournalSpec) -> None:
    """Label what has closed: predictions and outcomes of the open days, events and faults of these days and the horizon after them."""
    days = open_days(spark, moments, outcomes, until)
    if not days:
        return
    reach = spark.read.parquet(moments).filter(F.col("day").isin(days)).agg(F.max("horizon_h")).first()[0]
    last = days[-1] + timedelta(days=1 + reach // 24)
    span = F.col("day").between(F.lit(days[0]), F.lit(last))
    events = as_journal(read_landing(spark, landing).filter(span))
    marks = spark.read.parquet(faults)
    marks = marks.filter(span) if "day" in marks.columns else marks.filter(F.to_date("ts").between(F.lit(days[0]), F.lit(last)))
    preds = spark.read.parquet(predictions).filter(F.col("day").isin(days))
    done = read_days(spark, outcomes, OUTCOMES, days)
    new = label_outcomes(preds, done, marks, events, now, spec, until=until)
    new.join(preds.select(F.col("id").alias("prediction_id"), "day"), "prediction_id").write.mode("append").partitionBy("day").parquet(outcomes)


def label_stream(source: DataFrame, landing: str, predictions: str, moments: str, faults: str, outcomes: str, checkpoint: str, now: str,
                 spec: JournalSpec, **trigger) -> StreamingQuery:
    """After each batch of new events: label the predictions whose horizon has closed, append the outcomes by day.

    ``predictions`` is partitioned by day with the index ``moments`` beside it. A repeated batch finds its predictions labelled and appends nothing.
    """
    spark = source.sparkSession
    ensure_table(spark, outcomes, OUTCOMES, "day")

    def label(batch: DataFrame, batch_id: int) -> None:
        last = read_landing(batch.sparkSession, landing).agg(F.max("day")).first()[0]  # from the partition list
        if last is not None:
            newest = read_landing(batch.sparkSession, landing).filter(F.col("day") == F.lit(last))
            until = newest.agg(F.least(F.max("ts"), F.lit(now).cast("timestamp"))).first()[0]
            label_batch(batch.sparkSession, until, landing, predictions, moments, faults, outcomes, now, spec)

    return source.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
