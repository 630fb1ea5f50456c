"""Journal programs: clean events -> channel hours, pauses, outages, personal norms, faults.

Shuffles over raw events use ``(channel, day)``; everything after the channel-hour table is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.functions.values import in_work_hours
from lullwatch.operators import windows as W
from lullwatch.operators.carry import BUCKET, SPLIT_ROWS, band_distinct_count, neighbour_by
from lullwatch.operators.intervals import (
    days_touched, flag_in_window, overlap_seconds, overlap_up_to, seconds_between, window_clock,
)
from lullwatch.operators.sets import union_padded
from lullwatch.spec import JournalSpec

HOUR_COUNTS = ("n_ev", "n_fault", "n_disc", "n_unc", "n_off", "n_alarm", "n_txt", "n_chg", "n_num", "n_same", "n_sent",
               "n_date", "n_date1970", "n_gas1_wk", "n_gas1_off", "n_gas5", "n_gasdet")


def parse_journal(raw: DataFrame) -> DataFrame:
    """Typed columns from an all-string journal; what cannot be cast is NULL (a repeated header becomes such a row)."""
    return raw.select(
        F.col("event_id").try_cast("bigint").alias("event_id"),
        F.col("channel_id").try_cast("bigint").alias("ch"),
        F.try_to_timestamp(F.concat_ws(" ", F.trim("date"), F.trim("time")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.lower(F.trim("alarm")).alias("alarm_raw"),
        F.trim("value").alias("raw"),
    )


def dedup_events(parsed: DataFrame) -> DataFrame:
    """One row per ``(channel, ts, value)``: first id, any alarm, number of copies. Combines before the shuffle."""
    good = parsed.filter(F.col("ts").isNotNull() & F.col("ch").isNotNull() & (F.col("raw") != ""))
    return good.groupBy("ch", "ts", "raw").agg(
        F.min("event_id").alias("event_id"),
        F.coalesce(F.bool_or(F.col("alarm_raw").isin("t", "true")), F.lit(False)).alias("is_alarm"),
        F.count(F.lit(1)).alias("dup_n"),
    )


def hourly_aggregates(events: DataFrame, channels: DataFrame, spec: JournalSpec, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Channel-hour table: counters, moments, status changes, stuck readings, longest pause.

    ``events(ch, ts, is_alarm, raw, kind, num, txt)``. One shuffle by ``(ch, day)``, by the hour on days of over
    ``split_rows`` events: the aggregation keeps it.
    """
    gas = channels.filter(F.col("sensor_type") == spec.gas_type).select(F.col("id").alias("ch"), F.lit(True).alias("is_gas"))
    seen = neighbour_by(
        events.select("ch", "ts", "is_alarm", "raw", "kind", "num", "txt"), ["ch"], ["ts", "raw"],
        {"prev_ts": ("ts", None), "prev_num": ("num", F.col("num").isNotNull()), "prev_txt": ("txt", F.col("txt").isNotNull())},
        keep_bucket=True, split_rows=split_rows,
    )
    k, t, v = F.col("kind"), F.col("txt"), F.col("num")
    work = in_work_hours(F.col("ts"), spec)
    n = lambda cond: F.count_if(cond).cast("int")
    hours = seen.groupBy("ch", BUCKET, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).cast("int").alias("n_ev"),
        n(t == spec.fault).alias("n_fault"), n(t == spec.disconnected).alias("n_disc"),
        n(t.isin(*spec.uncertain)).alias("n_unc"), n(t == spec.power_off).alias("n_off"),
        n(F.col("is_alarm")).alias("n_alarm"), F.count(t).cast("int").alias("n_txt"),
        n(t != F.col("prev_txt")).alias("n_chg"), F.count(v).cast("int").alias("n_num"),
        F.sum(v).alias("s_v"), F.sum(v * v).alias("s_v2"), n(v == F.col("prev_num")).alias("n_same"),
        F.min(v).alias("v_min"), F.max(v).alias("v_max"),
        n(k == "sentinel").alias("n_sent"), n(k == "date_value").alias("n_date"),
        n((k == "date_value") & F.col("raw").startswith(spec.epoch_prefix)).alias("n_date1970"),
        n((v >= spec.gas_alarm) & work).alias("n_gas1_wk"), n((v >= spec.gas_alarm) & ~work).alias("n_gas1_off"),
        n(v >= spec.gas_explosive).alias("n_gas5"), n(t == spec.gas_detected).alias("n_gasdet"),
        F.max("ts").alias("last_ts"), F.max(seconds_between(F.col("prev_ts"), F.col("ts"))).cast("int").alias("max_gap_s"),
    ).drop(BUCKET)
    out = hours.join(gas, "ch", "left")
    only_gas = lambda c: F.when(F.col("is_gas"), F.col(c)).otherwise(0).alias(c)
    return out.select(*[only_gas(c) if c in ("n_gas1_wk", "n_gas1_off", "n_gas5") else F.col(c) for c in hours.columns])


def extract_gaps(events: DataFrame, spec: JournalSpec, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Pauses of at least ``gap_min_s`` between neighbouring events, and one open pause (``ts`` NULL) per channel."""
    # events of one moment are zero apart, so they need no de-duplication here
    seen = neighbour_by(events.select("ch", "ts"), ["ch"], ["ts"], {"prev_ts": ("ts", None)}, split_rows=split_rows)
    closed = seen.withColumn("gap_s", seconds_between(F.col("prev_ts"), F.col("ts")).cast("long")).filter(
        F.col("gap_s") >= spec.gap_min_s).select("ch", "prev_ts", "ts", "gap_s")
    last = events.groupBy("ch").agg(F.max("ts").alias("prev_ts"))
    return union_padded(closed, last)


def value_failures(events: DataFrame, channels: DataFrame, spec: JournalSpec) -> DataFrame:
    """Service values and dates in place of readings, with the first matching sub-kind."""
    gas = channels.filter(F.col("sensor_type") == spec.gas_type).select(F.col("id").alias("ch"), F.lit(True).alias("is_gas"))
    k = F.col("kind")
    hot = F.coalesce(F.col("is_gas") & (F.col("num") >= spec.gas_explosive) & ~F.col("is_alarm"), F.lit(False))
    sub = (
        F.when((k == "date_value") & F.col("raw").startswith(spec.epoch_prefix), "date_1970")
        .when(k == "date_value", "date_current")
        .when(F.col("is_gas") & (k == "sentinel"), "gas_anomaly")
        .when(hot, "gas_anomaly")
        .when((k == "sentinel") & F.col("is_alarm"), "sentinel_alarm")
        .otherwise("sentinel")
    )
    # numbers below the explosive threshold can never qualify: they leave before the join
    candidates = events.filter(k.isin("sentinel", "date_value") | (F.col("num") >= spec.gas_explosive))
    return candidates.join(gas, "ch", "left").filter(k.isin("sentinel", "date_value") | hot).select(
        "ch", "ts", "is_alarm", sub.alias("sub"), "raw")


def detect_outages(hourly: DataFrame, hour_from: str, hour_to: str, spec: JournalSpec) -> DataFrame:
    """Windows when the whole journal is nearly empty: an hour below a share of the median of the hours before it.

    One row per calendar hour reaches the ordered window, whatever the journal's size.
    """
    spark = hourly.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(
        F.lit(hour_from).cast("timestamp"), F.lit(hour_to).cast("timestamp") - F.expr("INTERVAL 1 HOUR"),
        F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    total = hourly.groupBy("hour").agg(F.sum("n_ev").alias("n"))
    h = calendar.join(total, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    low = W.trailing_median(h, "hour", "n", spec.outage_hours, "med").filter(F.col("n") < spec.outage_share * F.col("med"))
    return W.hour_islands(low, [], "hour").groupBy("island").agg(
        F.min("hour").alias("start"), (F.max("hour") + F.expr("INTERVAL 1 HOUR")).alias("end"),
        F.count(F.lit(1)).alias("hours"), F.sum("n").alias("events"),
    ).drop("island")


def journal_clock(outages: DataFrame, spec: JournalSpec) -> DataFrame:
    return window_clock(outages, spec.grid_from, spec.data_end)


def effective_gaps(gaps: DataFrame, clock: DataFrame, spec: JournalSpec) -> DataFrame:
    """Pause length without journal outages; the open pause ends with the data."""
    end = F.coalesce(F.col("ts"), F.lit(spec.data_end).cast("timestamp"))
    g = overlap_seconds(gaps.withColumn("ts_end", end), clock, F.col("prev_ts"), F.col("ts_end"), "outage_s")
    length = seconds_between(F.col("prev_ts"), F.col("ts_end")).cast("long")
    return g.select("ch", "prev_ts", "ts", "ts_end", (length - F.col("outage_s")).alias("gap_eff_s"), "outage_s")


def dense_grid(daily: DataFrame, spec: JournalSpec) -> DataFrame:
    """Every channel-day from the channel's first day to the end of data."""
    last = F.date_sub(F.to_date(F.lit(spec.data_end)), 1)
    span = daily.groupBy("ch").agg(F.min("day").alias("d0")).filter(F.col("d0") <= last)
    return span.select("ch", F.explode(F.sequence("d0", last)).alias("day"))


def personal_norm(hourly: DataFrame, gaps_eff: DataFrame, spec: JournalSpec) -> DataFrame:
    """Silence norm per channel-day: the k-th longest pause of the previous days, never below the floor.

    ``k = floor(tail * events) + 1`` is the percentile over all pauses although only long ones are listed. A day lists
    few pauses: those of one channel do not overlap, and each is at least the floor long, so a floor of ``f`` seconds
    bounds the list by ``86400 / f + 1``.
    """
    d_ev = hourly.groupBy("ch", F.to_date("hour").alias("day")).agg(
        F.sum("n_ev").cast("int").alias("n_ev"), F.max("max_gap_s").alias("max_gap_s"))
    d_gap = gaps_eff.filter(F.col("ts").isNotNull() & (F.col("gap_eff_s") >= spec.norm_floor_s)).groupBy(
        "ch", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list("gap_eff_s"), asc=False).alias("gl"))
    g = dense_grid(d_ev, spec).join(d_ev, ["ch", "day"], "left").join(d_gap, ["ch", "day"], "left")
    g = g.select("ch", "day", F.coalesce("n_ev", F.lit(0)).alias("n_ev"), "max_gap_s",
                 F.coalesce("gl", F.array().cast("array<bigint>")).alias("gl"))
    past = W.preceding(["ch"], "day", spec.norm_days)
    g = g.select("ch", "day", "n_ev", "max_gap_s", F.coalesce(F.sum("n_ev").over(past), F.lit(0)).cast("int").alias("n_ev_30d"),
                 W.sliding_list("gl", past).alias("past"))
    k = F.floor(spec.norm_tail * F.col("n_ev_30d")).cast("int")
    norm = F.greatest(F.lit(spec.norm_floor_s).cast("long"), F.coalesce(F.get("past", k), F.lit(0).cast("long")))
    return g.select("ch", "day", "n_ev", "max_gap_s", "n_ev_30d", norm.alias("norm_s"))


def link_losses(gaps_eff: DataFrame, norm: DataFrame, clock: DataFrame, spec: JournalSpec) -> DataFrame:
    """Pauses longer than the norm of the day of the last event; onset = last event + norm, moved by journal outages."""
    n = norm.filter(F.col("n_ev_30d") > 0).select("ch", F.col("day").alias("_day"), "norm_s")
    over = gaps_eff.withColumn("_day", F.to_date("prev_ts")).join(n, ["ch", "_day"]).filter(
        F.col("gap_eff_s") > F.col("norm_s"))
    over = over.withColumn("_onset", F.timestamp_seconds(F.unix_timestamp("prev_ts") + F.col("norm_s")))
    moved = overlap_up_to(over, clock, F.col("prev_ts"), F.col("_onset"), F.col("ts_end"), "_shift")
    moved = moved.withColumn("onset", F.timestamp_seconds(F.unix_timestamp("_onset") + F.col("_shift")))
    return moved.filter(F.col("onset") < F.lit(spec.data_end).cast("timestamp")).select(
        "ch", "prev_ts", "ts_end", "gap_eff_s", "norm_s", F.col("onset").alias("ts"))


def mass_hours(link: DataFrame, spec: JournalSpec) -> DataFrame:
    """Hours when many channels lose the link at once: a collection failure, not sensor faults."""
    per_hour = link.groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.countDistinct("ch").alias("n"))
    return per_hour.filter(F.col("n") >= spec.mass_channels).select("hr")


def fault_candidates(events: DataFrame, link: DataFrame, failures: DataFrame, spec: JournalSpec) -> DataFrame:
    """Status faults, link losses and value failures in one table."""
    status = events.filter(F.col("txt").isin(*spec.fault_statuses)).select(
        "ch", "ts", F.col("txt").alias("kind"), "is_alarm", F.lit(False).alias("mass"), F.col("ts").alias("silent_from"))
    mass = mass_hours(link, spec).withColumn("_mass", F.lit(True))
    lost = link.withColumn("hr", F.date_trunc("hour", "ts")).join(mass, "hr", "left").select(
        "ch", "ts", F.lit(spec.link_loss).alias("kind"), F.coalesce("_mass", F.lit(False)).alias("mass"),
        F.col("prev_ts").alias("silent_from"))
    value = failures.filter(F.col("sub").isin("date_1970", "gas_anomaly", "sentinel_alarm")).select(
        "ch", "ts", F.lit(spec.value_failure).alias("kind"), "sub", "is_alarm", F.lit(False).alias("mass"),
        F.col("ts").alias("silent_from"))
    out = union_padded(status, lost, value)
    return out.select("ch", "ts", "kind", "sub", "is_alarm", "mass", "silent_from")


def placed(df: DataFrame, channels: DataFrame, objects: DataFrame, ch: str = "ch") -> DataFrame:
    """Adds the channel's object, parent object and sensor type; channels outside the dictionary are dropped."""
    o = objects.select(F.col("id").alias("oid"), F.col("parent_id").alias("pid"))
    c = channels.select(F.col("id").alias(ch), F.col("object_id").alias("oid"), F.col("sensor_type").alias("st"))
    return df.join(c.join(o, "oid"), ch)


def group_onset(cand: DataFrame, link: DataFrame, norm: DataFrame, channels: DataFrame, objects: DataFrame, spec: JournalSpec,
                keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build()) -> DataFrame:
    """Counts around each candidate: same-type channels of the object and of the parent that fell silent together.

    ``keep(name, build)`` writes a part and reads it back, so that a small driver never holds the plans of all parts.
    """
    silent = keep("placed_silences", lambda: placed(link.filter(F.col("gap_eff_s") >= spec.group_min_h * 3600), channels, objects))
    talking = placed(norm.filter(F.col("n_ev_30d") > 0).select("ch", "day"), channels, objects)
    act = keep("group_sizes", lambda: talking.groupingSets([["day", "oid", "pid", "st"], ["day", "pid", "st"]], "day", "oid", "pid", "st").agg(
        F.grouping("oid").alias("parent_level"), F.count(F.lit(1)).alias("n_act")))
    act_obj = act.filter(F.col("parent_level") == 0).select("day", "oid", "st", F.col("n_act").alias("n_act_obj"))
    act_par = act.filter(F.col("parent_level") == 1).select("day", "pid", "st", F.col("n_act").alias("n_act_par"))

    at = keep("placed_candidates", lambda: placed(cand, channels, objects).withColumn("day", F.to_date("silent_from")))
    tol = spec.group_tolerance_h
    obj = keep("faults_objects", lambda: band_distinct_count(at, silent, ["oid", "st"], "ch", "silent_from", "prev_ts", tol, "n_sil_obj"))
    par = keep("faults_parents", lambda: band_distinct_count(at, silent, ["pid", "st"], "ch", "silent_from", "prev_ts", tol, "n_sil_par"))
    at = (
        at.join(obj, ["oid", "st", "silent_from"], "left").join(par, ["pid", "st", "silent_from"], "left")
        .join(act_obj, ["day", "oid", "st"], "left").join(act_par, ["day", "pid", "st"], "left")
        .withColumns({"n_sil_obj": F.coalesce("n_sil_obj", F.lit(0)), "n_sil_par": F.coalesce("n_sil_par", F.lit(0))})
    )
    enough = lambda s, a: (F.col(s) >= spec.group_min_channels) & (F.col(s) >= spec.group_min_share * F.col(a))
    return at.withColumn("grp_onset", F.coalesce(
        enough("n_sil_obj", "n_act_obj") | enough("n_sil_par", "n_act_par"), F.lit(False))).drop("day")


def silent_group_days(norm: DataFrame, clock: DataFrame, channels: DataFrame, objects: DataFrame,
                      spec: JournalSpec) -> DataFrame:
    """Days when most same-type channels of an object (``parent_level`` 0) or parent (1) sent nothing, two in a row."""
    wins = clock.select(F.explode("wins").alias("w")).select("w.*").distinct()
    long_outage = wins.filter(seconds_between(F.col("start"), F.col("end")) >= spec.outage_day_min_s).select(
        "start", F.date_add(F.to_date("end"), 1).cast("timestamp").alias("end"))
    dark = days_touched(long_outage).select("day").distinct()
    usual = F.col("n_ev_30d") >= spec.norm_days * spec.group_daily_min_events
    n = placed(norm.filter(usual).join(dark, "day", "left_anti"), channels, objects)
    d = n.groupingSets([["day", "oid", "pid", "st"], ["day", "pid", "st"]], "day", "oid", "pid", "st").agg(
        F.grouping("oid").cast("int").alias("parent_level"), F.count(F.lit(1)).alias("n_act"),
        F.count_if(F.col("n_ev") == 0).alias("n_zero"))
    d = d.filter(F.col("pid").isNotNull())
    z = d.filter((F.col("n_zero") >= spec.group_min_channels) & (F.col("n_zero") >= spec.group_min_share * F.col("n_act")))
    w = Window.partitionBy("parent_level", "oid", "pid", "st").orderBy("day")
    near = (F.date_diff("day", F.lag("day").over(w)) == 1) | (F.date_diff(F.lead("day").over(w), "day") == 1)
    return z.withColumn("_near", near).filter("_near").drop("_near")


def finalise_faults(cand: DataFrame, link: DataFrame, norm: DataFrame, clock: DataFrame, channels: DataFrame,
                    objects: DataFrame, spec: JournalSpec,
                    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build()) -> DataFrame:
    """Candidates with the group flags and the outage flag; ``keep`` as for ``group_onset``."""
    f = group_onset(cand, link, norm, channels, objects, spec, keep)
    z = keep("faults_silent_days", lambda: silent_group_days(norm, clock, channels, objects, spec))
    # a fault belongs to a silent day when it happens on that day or on the day before
    hit = z.select(F.explode(F.array("day", F.date_sub("day", 1))).alias("_day"), "parent_level", "oid", "pid", "st")
    by_obj = hit.filter(F.col("parent_level") == 0).select("_day", "oid", "st").distinct().withColumn("_zo", F.lit(True))
    by_par = hit.filter(F.col("parent_level") == 1).select("_day", "pid", "st").distinct().withColumn("_zp", F.lit(True))
    f = f.withColumn("_day", F.to_date("ts")).join(by_obj, ["_day", "oid", "st"], "left").join(
        by_par, ["_day", "pid", "st"], "left")
    f = f.withColumn("grp_day", F.coalesce(F.col("_zo"), F.lit(False)) | F.coalesce(F.col("_zp"), F.lit(False)))
    f = f.withColumn("grp", F.col("grp_onset") | F.col("grp_day"))
    return flag_in_window(f, clock, "ts", "in_outage").select(
        "ch", "ts", "kind", "sub", "is_alarm", "mass", "silent_from", "n_sil_obj", "n_act_obj", "n_sil_par", "n_act_par",
        "grp_onset", "grp_day", "grp", "in_outage")


def clean_fault(spec: JournalSpec, variant: str = "b") -> Column:
    """Faults that count for label variant a, b or c."""
    base = F.col("kind").isin(*spec.base_kinds)
    value = F.col("kind") == spec.value_failure
    kinds = {"a": base, "b": base | (value & F.col("sub").isin("date_1970", "gas_anomaly")), "c": base | value}[variant]
    return kinds & ~F.col("mass") & ~F.col("grp") & ~F.col("in_outage")


def fault_summary(faults: DataFrame) -> DataFrame:
    return faults.groupBy("kind", "sub", F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("mass").alias("mass"), F.count_if("grp").alias("grp"),
        F.countDistinct("ch").alias("channels"))


def channel_daily(hourly: DataFrame) -> DataFrame:
    """Serving roll-up of the channel-hour table."""
    mean = F.sum("s_v") / F.nullif(F.sum("n_num"), F.lit(0))
    return hourly.groupBy(F.col("ch").alias("channel_id"), F.to_date("hour").alias("day")).agg(
        F.sum("n_ev").alias("events_count"), F.sum("n_alarm").alias("alarm_count"),
        F.sum(F.col("n_fault") + F.col("n_disc")).alias("fault_count"), F.sum("n_unc").alias("uncertain_count"),
        F.sum("n_off").alias("power_off_count"), F.sum("n_chg").alias("status_changes"),
        F.round(mean, 4).alias("value_avg"), F.min("v_min").alias("value_min"), F.max("v_max").alias("value_max"),
        F.bround(F.max("max_gap_s") / 60).cast("int").alias("max_gap_min"))


def silence_report(gaps_eff: DataFrame, norm: DataFrame) -> DataFrame:
    """Open pause of every channel next to its personal norm, the most silent first."""
    open_gap = gaps_eff.filter(F.col("ts").isNull()).withColumn("day", F.to_date("prev_ts"))
    n = norm.select("ch", "day", "norm_s", "n_ev_30d")
    late = (F.col("n_ev_30d") > 0) & (F.col("gap_eff_s") > F.col("norm_s"))
    return open_gap.join(n, ["ch", "day"]).select(
        "ch", F.unix_timestamp("prev_ts").alias("silent_since"), "gap_eff_s", "norm_s",
        F.round(F.col("gap_eff_s") / F.col("norm_s"), 4).alias("ratio"), late.alias("overdue")).orderBy(F.desc("ratio"), "ch")


def overdue_channels(gaps_eff: DataFrame, norm: DataFrame) -> DataFrame:
    """Channels whose open pause is longer than their personal norm."""
    return silence_report(gaps_eff, norm).filter("overdue").drop("overdue")
