"""Checks of the streams: each runs to the end of the available data and equals its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lullwatch.plans.serving import snapshot_moments
from lullwatch.session import shared_dir
from lullwatch.sources import merge
from lullwatch.streaming import alerts, hourly, ingest
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs


def _folder(b, name):
    return f"{shared_dir(b.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _raw_stream(b):
    """The driver's events as a file stream in the raw import columns."""
    schema = b.table("events").schema
    return _import_columns(b.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(b.dir))


def _import_columns(s):
    kind, v = F.col("event_type"), F.col("value")
    text = (F.when((kind == "error") & (v < 40), "FAULT").when((kind == "error") & (v < 100), "DISCONNECTED")
            .when(kind == "error", "01.01.1970 03:00:00").when((kind == "signup") & (v < 30), "POWER_OFF")
            .when((kind == "signup") & (v < 60), "UNCERTAIN").when((kind == "signup") & (v < 120), "OK").when(kind == "signup", "GAS")
            .otherwise(v.cast("string")))
    return s.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("channel_id"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when((kind == "error") | ((kind == "purchase") & (v >= 150)), "t").otherwise("f").alias("is_alarm"),
                    text.alias("value"))


def _ingested(b):
    landing, counters = _folder(b, "landing"), _folder(b, "counters")
    ingest.ingest_stream(_raw_stream(b), b.channels(), landing, counters, _folder(b, "ck")).awaitTermination()
    return landing, counters


@query("t01_t02_ingest_stream", sql("rawj chn", """SELECT ch AS channel_id, epoch(ts)::BIGINT AS ts, raw AS value_raw FROM rawj WHERE raw <> '01.01.1970 03:00:00'
  AND ch IN (SELECT id FROM chn) GROUP BY 1, 2, 3"""))
def _(b):
    landing, _ = _ingested(b)
    return ingest.read_landing(b.spark, landing).select("channel_id", secs("ts"), "value_raw")


@query("t01_ingest_counters", sql("rawj chn", """SELECT count(*)::BIGINT AS received, 0::BIGINT AS unknown, count(*) FILTER (WHERE raw = '01.01.1970 03:00:00')::BIGINT AS invalid,
  (count(DISTINCT (ch, ts, raw)) FILTER (WHERE raw <> '01.01.1970 03:00:00'))::BIGINT AS accepted,
  (count(*) FILTER (WHERE raw <> '01.01.1970 03:00:00') - count(DISTINCT (ch, ts, raw)) FILTER (WHERE raw <> '01.01.1970 03:00:00'))::BIGINT AS duplicates FROM rawj"""))
def _(b):
    _, counters = _ingested(b)
    c = b.spark.read.parquet(counters)
    return c.agg(*[F.sum(x).alias(x) for x in ("received", "unknown", "invalid", "accepted", "duplicates")])


# events arrive in four parts, the newest week first: all later parts are late by days
cte("landed", "rawj chn", """SELECT ch, ts, raw, bool_or(alarm_raw = 't') AS alarm, greatest(0, 3 - (day(ts) - 1) // 8) AS part FROM rawj
  WHERE raw <> '01.01.1970 03:00:00' AND ch IN (SELECT id FROM chn) GROUP BY 1, 2, 3""")


def _hours_from_parts(b):
    arrived, landing, hours = _folder(b, "arrived"), _folder(b, "landing"), _folder(b, "hours")
    counters, ck = _folder(b, "counters"), _folder(b, "ck")
    part = F.greatest(F.lit(0), 3 - F.floor((F.dayofmonth("ts") - 1) / 8))
    raw = b.table("events")
    merge.ensure_table(b.spark, arrived, raw.schema)
    for k in range(4):
        raw.filter(part == k).write.mode("append").parquet(arrived)
        ingest.ingest_stream(_import_columns(b.spark.readStream.schema(raw.schema).parquet(arrived)), b.channels(), landing, f"{counters}-in", f"{ck}-in").awaitTermination()
        hourly.hourly_stream(b.spark.readStream.schema(ingest.LANDING).parquet(landing), hours, counters, ck, b.spec).awaitTermination()
    return hours, counters


@query("t06_hourly_stream", sql("landed", """SELECT ch, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS events_count, count(*) FILTER (WHERE alarm) AS alarm_count,
  count(*) FILTER (WHERE raw IN ('FAULT', 'DISCONNECTED')) AS fault_count, count(*) FILTER (WHERE raw = 'UNCERTAIN') AS uncertain_count,
  round(avg(try_cast(raw AS DOUBLE)), 6) AS value_avg, min(try_cast(raw AS DOUBLE)) AS value_min, max(try_cast(raw AS DOUBLE)) AS value_max FROM landed GROUP BY 1, 2"""))
def _(b):
    hours, _ = _hours_from_parts(b)
    return hourly.read_hours(b.spark, hours).select("ch", secs("hour"), "events_count", "alarm_count", "fault_count", "uncertain_count",
                                                    F.round("value_avg", 6).alias("value_avg"), "value_min", "value_max")


@query("t06_late_rows", sql("landed", """SELECT part AS batch, count(*) AS rows, count(*) FILTER (WHERE ts < seen - INTERVAL 2 HOUR) AS late_rows FROM landed
  LEFT JOIN (SELECT p.part, max(l.ts) AS seen FROM (SELECT DISTINCT part FROM landed) p JOIN landed l ON l.part < p.part GROUP BY 1) USING (part) GROUP BY 1"""))
def _(b):
    _, counters = _hours_from_parts(b)
    return b.spark.read.schema(hourly.COUNTERS).parquet(counters).select("batch", "rows", "late_rows")


# ---- upsert: orders of the first part of the period are stored, an import brings the later ones and newer prices for the overlap

def _orders(b, lo=None, hi=None):
    o = b.work_orders().select("id", "channel_id", "created_at", "status", "priority", F.to_date("created_at").alias("day"))
    o = o if lo is None else o.filter(F.col("created_at") >= F.lit(lo).cast("timestamp"))
    return o if hi is None else o.filter(F.col("created_at") < F.lit(hi).cast("timestamp"))


def _merged(b, update, repeats):
    path = _folder(b, "orders")
    old = _orders(b, hi="2024-01-20")
    merge.ensure_table(b.spark, path, old.schema, "day")
    merge.upsert(old, path, ["id"])
    new = _orders(b, lo="2024-01-15").withColumns({"priority": F.concat("priority", F.lit("+")), "status": F.lit("imported")})
    for _ in range(repeats):
        merge.upsert(new, path, ["id"], update)
    return b.spark.read.schema(old.schema).parquet(path).select("id", "channel_id", secs("created_at"), "status", "priority")


@query("t03_upsert_updates", sql("wo", """SELECT id, channel_id, epoch(created_at)::BIGINT AS created_at, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN 'imported' ELSE status END AS status,
  CASE WHEN created_at >= TIMESTAMP '2024-01-15' THEN priority || '+' ELSE priority END AS priority FROM wo"""))
def _(b):
    return _merged(b, ["priority"], 1)


@query("t03_upsert_repeated", sql("wo", """SELECT id, channel_id, epoch(created_at)::BIGINT AS created_at, CASE WHEN created_at >= TIMESTAMP '2024-01-15' THEN 'imported' ELSE status END AS status,
  CASE WHEN created_at >= TIMESTAMP '2024-01-15' THEN priority || '+' ELSE priority END AS priority FROM wo"""))
def _(b):
    return _merged(b, ["priority", "status"], 2)


@query("t03_insert_ignores", sql("wo", """SELECT id, channel_id, epoch(created_at)::BIGINT AS created_at, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN 'imported' ELSE status END AS status,
  CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN priority || '+' ELSE priority END AS priority FROM wo"""))
def _(b):
    return _merged(b, None, 2)


@query("t05_alert_stream", sql("preds", """SELECT id, channel_id, epoch("at")::BIGINT AS at, prob FROM (SELECT *, lag("at") OVER (PARTITION BY channel_id ORDER BY "at") AS pa FROM preds WHERE risk_level = 'critical')
  WHERE pa IS NULL OR pa < "at" - INTERVAL 24 HOUR"""))
def _(b):
    p = b.predictions()
    source, out, ck = _folder(b, "preds"), _folder(b, "alerts"), _folder(b, "ck")
    for lo, hi in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-02-01")):  # three batches with their moments between
        p.filter((F.col("at") >= F.lit(lo).cast("timestamp")) & (F.col("at") < F.lit(hi).cast("timestamp"))).write.mode("append").parquet(source)
        alerts.alert_stream(b.spark.readStream.schema(p.schema).parquet(source), out, ck).awaitTermination()
    return alerts.read_alerts(b.spark, out).withColumn("at", F.unix_timestamp("at")).select("id", "channel_id", "at", "prob")


@query("t04_label_stream", sql("preds ev faults", """SELECT p.id AS prediction_id, coalesce(m.ts <= p."at" + INTERVAL 24 HOUR, false) AS happened FROM (
   SELECT * FROM preds WHERE "at" + INTERVAL 24 HOUR <= (SELECT least(max(ts), TIMESTAMP '2024-01-28 13:00:00') FROM rawj WHERE raw <> '01.01.1970 03:00:00')) p
  ASOF LEFT JOIN (SELECT ch, ts FROM faults UNION SELECT ch, ts FROM ev WHERE txt IN ('FAULT', 'DISCONNECTED')) m ON m.ch = p.channel_id AND p."at" < m.ts"""))
def _(b):
    landing, _ = _ingested(b)
    preds, moments, faults, outcomes = (_folder(b, n) for n in ("preds", "moments", "faults", "outcomes"))
    p = b.predictions().drop("happened", "fault_at", "fault_kind").withColumn("day", F.to_date("at"))
    p.write.partitionBy("day").parquet(preds)
    snapshot_moments(p).write.parquet(moments)
    b.faults().select("ch", "ts", "kind").write.parquet(faults)
    landed = b.spark.readStream.schema(ingest.LANDING).parquet(landing)
    ingest.label_stream(landed, landing, preds, moments, faults, outcomes, _folder(b, "ck"), "2024-01-28 13:00:00", b.spec).awaitTermination()
    return b.spark.read.schema(ingest.OUTCOMES).parquet(outcomes).select("prediction_id", "happened")
