"""Checks of sources and sinks: the driver's tables are written in a format of the engine and read back through it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lullwatch.plans import journal as J
from lullwatch.session import shared_dir
from lullwatch.sources import exports, imports, journal_csv, merge, slices
from lullwatch.sources.parquet import read_slices
from lullwatch.sources.publish import publish_serving
from lullwatch.streaming import ingest
from lullwatch.testbed.checks_features import feature_stage
from lullwatch.testbed.oracle import sql
from lullwatch.testbed.registry import query, secs


def _folder(b, name):
    return f"{shared_dir(b.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _csv(df, path, sep=","):
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


def _journal_files(b):
    """The raw journal under the customer's column names, all text."""
    j = b.raw_journal()
    return j.select(F.col("event_id").cast("string").alias("ид_события"), F.col("ch").cast("string").alias("ид_канала_данных"), F.date_format("ts", "yyyy-MM-dd").alias("дата"),
                    F.date_format("ts", "HH:mm:ss").alias("время"), F.col("alarm_raw").alias("тревожное"), F.col("raw").alias("значение_датчика"))


@query("s01_journal_csv", sql("rawj", "SELECT event_id, ch, epoch(ts)::BIGINT AS ts, alarm_raw, raw FROM rawj"))
def _(b):
    parsed = J.parse_journal(journal_csv.read_journal_csv(b.spark, _csv(_journal_files(b), _folder(b, "journal"))))
    return parsed.select("event_id", "ch", secs("ts"), "alarm_raw", "raw")


@query("s02_object_csv", sql("obj", "SELECT id, level, parent_id, name FROM obj"))
def _(b):
    names = {v: k for k, v in journal_csv.OBJECT_COLUMNS.items()}
    o = b.objects().withColumn("kind", F.lit("object")).select(*[F.col(c).alias(names[c]) for c in ("id", "level", "parent_id", "kind", "name")])
    return journal_csv.read_objects(b.spark, _csv(o, _folder(b, "objects"))).select("id", "level", "parent_id", "name")


@query("s02_channel_csv", sql("chn", "SELECT id, object_id, system_type, sensor_type, tag, name FROM chn"))
def _(b):
    names = {v: k for k, v in journal_csv.CHANNEL_COLUMNS.items()}
    c = b.channels().select(*[F.col(c).alias(names[c]) for c in ("id", "object_id", "system_type", "sensor_type", "tag", "name")])
    return journal_csv.read_channels(b.spark, _csv(c, _folder(b, "channels"))).select("id", "object_id", "system_type", "sensor_type", "tag", "name")


_IMPORTED = """SELECT event_id, ch AS channel_id, epoch(ts)::BIGINT AS ts, alarm_raw = 't' AS is_alarm, raw AS value_raw, try_cast(raw AS DOUBLE) AS value_num FROM rawj WHERE raw <> '01.01.1970 03:00:00'"""


def _cleaned(df):
    return imports.clean_events(df).filter("error is null").select("event_id", "channel_id", secs("ts"), "is_alarm", "value_raw", "value_num")


@query("s07_import_csv", sql("rawj", _IMPORTED))
def _(b):
    return _cleaned(imports.import_csv(b.spark, _csv(_journal_files(b), _folder(b, "import"), ";"), "events"))


@query("s08_s09_xml_round_trip", sql("rawj", _IMPORTED))
def _(b):
    path = _folder(b, "xml")
    events = b.raw_journal().select("event_id", F.col("ch").alias("channel_id"), "ts", F.col("alarm_raw").alias("is_alarm"), F.col("raw").alias("value"))
    exports.export_xml(events, path, "events", "event", "event_id")
    return _cleaned(imports.import_xml(b.spark, path, "events", "event"))


@query("s06_read_slices", sql("preds", """SELECT id, prob FROM preds WHERE "at" >= TIMESTAMP '2024-01-12' AND "at" <= TIMESTAMP '2024-01-15'"""))
def _(b):
    path = _folder(b, "slices")
    b.predictions().withColumns({"T": F.col("at"), "eligible": F.lit(True), "y": F.col("happened").cast("int")}).write.parquet(path)
    return read_slices(b.spark, path, "2024-01-12", "2024-01-15", ["id", "prob"])


@query("s06_read_feature_slices", sql("norm", """SELECT ch, epoch(day)::BIGINT AS t FROM norm WHERE n_ev_30d > 0 AND day >= DATE '2024-01-12' AND day <= DATE '2024-01-15'"""))
def _(b):
    path = _folder(b, "slices")
    f = feature_stage(b)
    f.withColumns({"eligible": F.lit(True), "y": F.coalesce("y", F.lit(0))}).write.parquet(path)
    return read_slices(b.spark, path, "2024-01-12", "2024-01-15", ["ch", "T"]).select("ch", secs("T", "t"))


@query("s11_publish_predictions", sql("preds", """SELECT row_number() OVER (ORDER BY "at", channel_id) AS id, channel_id, epoch("at")::BIGINT AS at, prob FROM preds
  WHERE "at" >= TIMESTAMP '2024-01-20' OR hour("at") % 12 = 0"""))
def _(b):
    return _published(b, "predictions").select("id", "channel_id", secs("at"), "prob")


@query("s11_publish_last_events", sql("ev chn", """SELECT ts::DATE::VARCHAR AS day, ch, epoch(max(ts))::BIGINT AS ts, max({'t': ts, 'r': raw}).r AS raw FROM ev WHERE ch IN (SELECT id FROM chn) GROUP BY 1, 2"""))
def _(b):
    return _published(b, "events_day_last").select(F.col("day").cast("string").alias("day"), "ch", secs("ts"), "raw")


@query("s11_publish_moments", sql("preds", """SELECT epoch("at")::BIGINT AS at, count(*) AS n FROM preds WHERE "at" >= TIMESTAMP '2024-01-20' OR hour("at") % 12 = 0 GROUP BY 1"""))
def _(b):
    return _published(b, "prediction_moments").select(secs("at"), "n")


def _published(b, name):
    path = _folder(b, "serving")
    publish_serving(path, b.hourly(), b.events(), b.faults(), b.predictions(), b.channels(), "2024-01-31", "2024-01-10", "2024-01-20", 12)
    return b.spark.read.parquet(f"{path}/{name}")


@query("s13_validate_slice", sql("faults", """SELECT table_name, problem FROM (VALUES ('faults', 'row count differs'), ('objects', 'checksum differs'), ('predictions', 'table is missing')) v(table_name, problem)
  WHERE table_name <> 'faults' OR EXISTS (SELECT 1 FROM faults WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-16')"""))
def _(b):
    """A slice as exported, and the same with a row lost, a value changed and a table left out."""
    cut = slices.slice_tables({"predictions": (b.predictions().select("id", "at", "prob"), "at", 0), "faults": (b.faults().select("ch", "ts", "kind"), "ts", 0),
                               "objects": (b.objects(), None, 0), "channels": (b.channels(), None, 0)}, "2024-01-12", "2024-01-15")
    first = cut["faults"].agg(F.min(F.struct("ts", "ch", "kind"))).scalar()
    tampered = {"faults": cut["faults"].filter(F.struct("ts", "ch", "kind") != first), "objects": cut["objects"].withColumn("name", F.upper(F.concat("name", F.lit("x")))),
                "channels": cut["channels"]}
    return slices.validate_slice(slices.manifest(cut), tampered)


@query("t07_trim_recent", sql("ev", "SELECT event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 5 DAY AND ts < TIMESTAMP '2024-01-31'"))
def _(b):
    path = _folder(b, "landing")
    e = b.events().select("event_id", F.col("ch").alias("channel_id"), "ts", "is_alarm", F.col("raw").alias("value_raw"), F.col("num").alias("value_num"),
                          F.col("txt").alias("value_text"), F.to_date("ts").alias("day"))
    merge.replace_days(e, path)
    return ingest.recent_days(ingest.read_landing(b.spark, path), "2024-01-31", 5).select("event_id")
