"""Typing of raw journal values: dates in place of readings, statuses, vendor codes, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullwatch.spec import JournalSpec

# ---- fixed values: accepted spellings of the alarm flag -----------------------------------------------------------
TRUE_WORDS = ("t", "true", "1", "да", "yes", "y")
FALSE_WORDS = ("f", "false", "0", "нет", "no", "n", "")
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy")
TIME_FORMATS = ("HH:mm:ss", "HH:mm")
STAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd",
                 "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm")
JOURNAL_ZONE_HOURS = 3  # wall clock of the journal: UTC+3, no summer time
# -------------------------------------------------------------------------------------------------------------------


def as_number(raw: Column) -> Column:
    """Double from text with a decimal point or comma, NULL when it is not a number."""
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def is_date_value(raw: Column, spec: JournalSpec) -> Column:
    return raw.rlike(spec.date_pattern)


def is_sentinel(x: Column, sensor_type: Column, spec: JournalSpec) -> Column:
    """Vendor code, absurd magnitude, or outside the physical range of the sensor type."""
    out_of_range = F.lit(False)
    for name, (lo, hi) in spec.physical_ranges.items():
        out_of_range = out_of_range | (sensor_type.eqNullSafe(F.lit(name)) & ((x < lo) | (x > hi)))
    return x.isin(*spec.sentinel_codes) | (F.abs(x) >= spec.sentinel_abs) | out_of_range


def value_kind(raw: Column, sensor_type: Column, spec: JournalSpec) -> Column:
    x = as_number(raw)
    return (
        F.when(is_date_value(raw, spec), "date_value")
        .when(x.isNull(), "status")
        .when(is_sentinel(x, sensor_type, spec), "sentinel")
        .otherwise("number")
    )


def in_work_hours(ts: Column, spec: JournalSpec) -> Column:
    lo, hi = spec.work_hours
    return (F.weekday(ts) < 5) & F.hour(ts).between(lo, hi)


def parse_bool(raw: Column) -> Column:
    """Alarm flag of an import: NULL means the spelling is not known and the row must be rejected."""
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_ts(raw: Column) -> Column:
    """Timestamp from the accepted spellings; a zoned moment becomes the journal's wall clock, seconds precision."""
    text = F.trim(raw)
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]")
    cleaned = F.regexp_replace(text, r"(\d{2}:\d{2}:\d{2})\.\d+", "$1")
    moment = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(cleaned, r"T", " "), F.lit(f))
                          for f in ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXX", "yyyy-MM-dd HH:mmXXX")])
    wall = F.coalesce(*[F.try_to_timestamp(cleaned, F.lit(f)) for f in STAMP_FORMATS])
    return F.when(zoned, moment + F.expr(f"INTERVAL {JOURNAL_ZONE_HOURS} HOURS")).otherwise(wall)


def parse_date_time(day: Column, time: Column) -> Column:
    """Timestamp from separate date and time columns."""
    d = F.coalesce(*[F.try_to_timestamp(F.left(F.trim(day), F.lit(10)), F.lit(f)) for f in DATE_FORMATS])
    t = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.trim(time)), F.lit(f"yyyy-MM-dd {f}"))
                     for f in TIME_FORMATS])
    return F.timestamp_seconds(F.unix_timestamp(d) + F.unix_timestamp(t))


def classify_values(events: DataFrame, channels: DataFrame, spec: JournalSpec) -> DataFrame:
    """Adds ``kind``, ``num`` (readings only) and ``txt`` (statuses only) to ``(ch, ts, raw, ...)`` rows."""
    types = channels.select(F.col("id").alias("ch"), F.col("sensor_type").alias("_st"))
    out = events.join(types, "ch", "left").withColumn("kind", value_kind(F.col("raw"), F.col("_st"), spec))
    return out.withColumns({
        "num": F.when(F.col("kind") == "number", as_number(F.col("raw"))),
        "txt": F.when(F.col("kind") == "status", F.col("raw")),
    }).drop("_st")
