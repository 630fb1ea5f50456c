"""Data-quality profiles: each is one or two aggregations over the journal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullwatch.operators.ranking import top_counts
from lullwatch.spec import JournalSpec


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part / whole * 100, digits)


def load_stats(parsed: DataFrame, spec: JournalSpec) -> DataFrame:
    """Raw rows, bad moments and channels, dates and blanks in place of values, flag spellings, first and last moment."""
    ok = F.col("ts").isNotNull()
    a = F.col("alarm_raw")
    return parsed.agg(
        F.count(F.lit(1)).alias("rows_raw"), F.count_if(~ok).alias("bad_ts"), F.count_if(F.col("ch").isNull()).alias("bad_channel"),
        F.count_if(ok & F.col("raw").rlike(spec.date_pattern)).alias("date_values"),
        F.count_if(ok & (F.coalesce("raw", F.lit("")) == "")).alias("empty_values"),
        F.count_if(a.isin("t", "f")).alias("alarm_tf"), F.count_if(a.isin("true", "false")).alias("alarm_truefalse"),
        F.count_if(a.isNull() | ~a.isin("t", "f", "true", "false")).alias("alarm_other"),
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def kind_stats(events: DataFrame) -> DataFrame:
    """Kept rows and removed copies per value kind."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum(F.col("dup_n") - 1).alias("dup_removed"))


def _typed(events: DataFrame, channels: DataFrame) -> DataFrame:
    types = channels.select(F.col("id").alias("ch"), F.col("sensor_type"))
    return events.join(types, "ch", "left").withColumn("sensor_type", F.coalesce("sensor_type", F.lit("(not in the dictionary)")))


def sentinel_codes(events: DataFrame, channels: DataFrame, n: int = 25) -> DataFrame:
    """The most frequent service values per sensor type."""
    s = _typed(events.filter(F.col("kind") == "sentinel"), channels).withColumn("code", F.col("raw").try_cast("double"))
    return top_counts(s, ["sensor_type", "code"], n, [F.countDistinct("ch").alias("channels"), F.count_if("is_alarm").alias("alarm")])


def date_values(events: DataFrame, channels: DataFrame, spec: JournalSpec) -> DataFrame:
    d = _typed(events.filter(F.col("kind") == "date_value"), channels)
    return d.groupBy("sensor_type", F.col("raw").startswith(spec.epoch_prefix).alias("epoch_1970")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ch").alias("channels"), F.count_if("is_alarm").alias("alarm"))


def year_stats(events: DataFrame, channels: DataFrame) -> DataFrame:
    """Events, channels, orphans and readings per year. Rows are combined per channel before the dictionary join."""
    per = events.groupBy(F.year("ts").alias("year"), "ch").agg(F.count(F.lit(1)).alias("n"), F.count("num").alias("n_num"))
    known = channels.select(F.col("id").alias("ch"), F.lit(True).alias("known"))
    j = per.join(known, "ch", "left").withColumn("orphan", F.col("known").isNull())
    return j.groupBy("year").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("channels"),
        _percent(F.sum(F.when(F.col("orphan"), F.col("n")).otherwise(0)), F.sum("n"), 2).alias("orphan_pct"),
        F.count_if("orphan").alias("orphan_channels"), _percent(F.sum("n_num"), F.sum("n"), 1).alias("numeric_pct"))


def type_rate(events: DataFrame, channels: DataFrame, sensor_type: str, days_in_year: Column) -> DataFrame:
    """Messages per channel-day of one type by year, next to the year's total."""
    per = events.groupBy(F.year("ts").alias("year"), "ch").agg(F.count(F.lit(1)).alias("n"))
    typed = channels.filter(F.col("sensor_type") == sensor_type).select(F.col("id").alias("ch"))
    one = per.join(typed, "ch", "left_semi").groupBy("year").agg(
        F.count(F.lit(1)).alias("type_channels"), F.sum("n").alias("type_events"))
    total = per.groupBy("year").agg(F.sum("n").alias("events"))
    return one.join(total, "year").withColumn(
        "per_channel_day", F.round(F.col("type_events") / F.col("type_channels") / days_in_year, 1))


def status_stats(events: DataFrame) -> DataFrame:
    """Statuses with their channels and alarm share."""
    per = events.filter(F.col("txt").isNotNull()).groupBy("txt", "ch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_alarm").alias("a"))
    return per.groupBy(F.col("txt").alias("status")).agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("channels"), F.round(F.sum("a") / F.sum("n"), 3).alias("alarm_share"))


def type_stats(channels: DataFrame, events: DataFrame) -> DataFrame:
    """Channels per system and type, and how many of them sent anything."""
    active = events.select(F.col("ch").alias("id")).distinct().withColumn("active", F.lit(True))
    return channels.join(active, "id", "left").groupBy("system_type", "sensor_type").agg(
        F.count(F.lit(1)).alias("channels"), F.count("active").alias("active"))


def sample_check(sample: DataFrame, spec: JournalSpec) -> DataFrame:
    """One-row reconciliation of a sample file: rows, channels, faulty rows and channels, flag spellings."""
    faulty = F.col("raw") == spec.fault
    return sample.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ch").alias("channels"), F.count_if(faulty).alias("faulty"),
        F.countDistinct(F.when(faulty, F.col("ch"))).alias("faulty_channels"),
        F.array_join(F.sort_array(F.collect_set("alarm_raw")), "/").alias("flags"))


def silence_share_hist(faults: DataFrame, channels: DataFrame, spec: JournalSpec, gas_system: str, kinds: Sequence[str],
                       silent: str = "n_sil_obj", active: str = "n_act_obj", at_least: int = 5) -> DataFrame:
    """Faults by the share of same-type channels that fell silent with them."""
    share = F.try_divide(F.col(silent), F.col(active))
    c = channels.select(F.col("id").alias("ch"), F.when(F.col("system_type") == gas_system, "gas").otherwise("other").alias("grp_type"))
    bucket = (F.when(F.coalesce(F.col(active), F.lit(0)) == 0, "none").when(share < 0.1, "00-10").when(share < 0.25, "10-25")
              .when(share < 0.5, "25-50").when(share < 0.75, "50-75").otherwise("75-100"))
    f = faults.filter(~F.col("mass") & F.col("kind").isin(*kinds)).join(c, "ch")
    return f.groupBy("grp_type", "kind", bucket.alias("share")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(silent) >= at_least).alias(f"n_ge{at_least}"))
