"""Point-in-time features and labels of slices ``(ch, T)``; ``T`` is a whole hour.

All counters of a channel, its object, parent and sensor type are hour-bucketed and read at ``T - w`` from one running
sum per key: one sort serves every window, and no key holds more rows than hours and slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.operators import windows as W
from lullwatch.operators.asof import Lookup, asof_join, asof_many
from lullwatch.operators.intervals import flag_near_window, overlap_seconds, seconds_between
from lullwatch.operators.sets import union_distinct
from lullwatch.plans.journal import clean_fault, placed
from lullwatch.spec import JournalSpec

# running counter -> source in the channel-hour table
HOUR_MEASURES = {
    "ev": "n_ev", "fault": "n_fault", "disc": "n_disc", "unc": "n_unc", "off": "n_off", "alarm": "n_alarm",
    "txt": "n_txt", "chg": "n_chg", "num": "n_num", "sv": "s_v", "sv2": "s_v2", "same": "n_same", "sent": "n_sent",
    "date": "n_date", "d1970": "n_date1970", "g1wk": "n_gas1_wk", "g1off": "n_gas1_off", "g5": "n_gas5", "gdet": "n_gasdet",
}
FAULT_MEASURES = ("fall", "flnk", "fflt", "fdsc", "fvf", "grp", "rec", "rec_h")


def hour_after(ts: Column) -> Column:
    """The first whole hour not before the moment: an event counts at ``T`` when this is at most ``T``."""
    start = F.date_trunc("hour", ts)
    return F.when(start == ts, start).otherwise(start + F.expr("INTERVAL 1 HOUR"))


def _hours_back(t: Column, h: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(t) - h * 3600)


# ---- cumulative tables (running counters as their own programs) ---------------------------------------------------


def cumulate(hourly: DataFrame) -> DataFrame:
    """Running counters per channel over its hours."""
    w = W.running(["ch"], "hour")
    return hourly.select("ch", "hour", "last_ts", *[
        F.sum(F.coalesce(F.col(src), F.lit(0))).over(w).alias(f"c_{m}") for m, src in HOUR_MEASURES.items()])


def fault_hours(faults: DataFrame, spec: JournalSpec, variant: str = "b") -> DataFrame:
    """Clean faults and group silences per channel and counting hour, with the last and the first fault of the hour."""
    kind = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    clean = faults.filter(clean_fault(spec, variant)).groupBy("ch", hour_after(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("fall"), kind(spec.link_loss).alias("flnk"), kind(spec.fault).alias("fflt"),
        kind(spec.disconnected).alias("fdsc"), kind(spec.value_failure).alias("fvf"), F.max("ts").alias("last_fault"),
        F.min(F.struct("ts", "kind")).alias("first_fault"))
    grouped = faults.filter("grp").groupBy("ch", hour_after(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("grp"))
    return clean.unionByName(grouped, allowMissingColumns=True)


def recoveries(faults: DataFrame, gaps_eff: DataFrame, spec: JournalSpec, variant: str = "b") -> DataFrame:
    """Ends of clean link losses: the pause that holds the onset is the last pause that began before it."""
    lost = faults.filter((F.col("kind") == spec.link_loss) & clean_fault(spec, variant)).select("ch", "ts")
    pauses = gaps_eff.filter(F.col("ts").isNotNull()).select(
        "ch", F.col("prev_ts").alias("g_from"), F.col("ts").alias("g_to"))
    met = asof_join(lost, pauses, ["ch"], "ts", "g_from", ["g_to"], strict=True).filter(F.col("g_to") > F.col("ts"))
    return met.select("ch", F.col("g_to").alias("ts"),
                      (seconds_between(F.col("ts"), F.col("g_to")) / 3600).alias("hours"))


def cumulative_recoveries(rec: DataFrame) -> DataFrame:
    """Count and hours of recoveries known at each recovery moment; recoveries of one moment are peers."""
    at = rec.groupBy("ch", "ts").agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("h"))
    w = W.running(["ch"], "ts")
    return at.select("ch", "ts", F.sum("n").over(w).alias("c_rec"), F.sum("h").over(w).alias("c_rec_h"))


def phase_hours(hourly: DataFrame, channels: DataFrame, spec: JournalSpec) -> DataFrame:
    """Power-off and all messages of the phase sensors of an object per hour."""
    phase = channels.filter(F.col("sensor_type") == spec.phase_type).select(
        F.col("id").alias("ch"), F.col("object_id").alias("oid"))
    return hourly.select("ch", "hour", "n_off", "n_ev").join(phase, "ch").groupBy("oid", "hour").agg(
        F.sum("n_off").alias("po"), F.sum("n_ev").alias("pe"))


def daily_pulse(norm: DataFrame) -> DataFrame:
    """Longest pauses, silent days, variation of the daily count over past days, and history length."""
    w7, w30 = W.preceding(["ch"], "day", 7), W.preceding(["ch"], "day", 30)
    return norm.select(
        "ch", "day", "norm_s", "n_ev_30d", F.max("max_gap_s").over(w7).alias("max_gap_7d"),
        F.max("max_gap_s").over(w30).alias("max_gap_30d"),
        F.sum((F.col("n_ev") == 0).cast("int")).over(w30).alias("zero_days_30d"),
        W.variation("n_ev", w30).alias("daily_cv_30d"), W.history_len(["ch"], "day", 365).alias("history_days"))


# ---- slices --------------------------------------------------------------------------------------------------------


def slices(norm: DataFrame, channels: DataFrame, mode: str, d_from: str | None = None, d_to: str | None = None,
           at: str | None = None) -> DataFrame:
    """``(ch, T)`` of dictionary channels that sent something in the past window: daily, hourly, or one moment."""
    known = channels.select(F.col("id").alias("ch"))
    active = norm.filter(F.col("n_ev_30d") > 0)
    if mode == "at":
        moment = F.date_trunc("hour", F.lit(at).cast("timestamp"))
        return active.filter(F.col("day") == F.to_date(moment)).join(known, "ch", "left_semi").select("ch", moment.alias("T"))
    active = active.filter((F.col("day") >= F.to_date(F.lit(d_from))) & (F.col("day") < F.to_date(F.lit(d_to))))
    active = active.join(known, "ch", "left_semi")
    midnight = F.col("day").cast("timestamp")
    if mode == "daily":
        return active.select("ch", midnight.alias("T"))
    return active.select("ch", F.explode(F.sequence(midnight, midnight + F.expr("INTERVAL 23 HOURS"),
                                                    F.expr("INTERVAL 1 HOUR"))).alias("T"))


def _difference(measure: str, window: str, h: int) -> Column:
    """Counter at ``T`` minus counter at ``T - h``."""
    return F.expr(f"max(if(_h = 0, {measure}, null)) - max(if(_h = {h}, {measure}, null)) AS {measure}_{window}")


def counters_at(probes: DataFrame, hours: DataFrame, key: str, measures: list[str], windows: dict[str, int]) -> DataFrame:
    """``{measure}_{w}``: sums over ``(T - w, T]`` of hour-bucketed rows ``(key, hour, measures)`` for each ``(key, T)``.

    Probes at ``T`` and every ``T - w`` join the hour rows; the running sum at a probe is the counter up to it.
    """
    spans = {"0": 0, **windows}
    ask = probes.select(key, "T").distinct().select(
        key, "T", F.explode(F.array(*[F.lit(h) for h in spans.values()])).alias("_h")).withColumn(
        "hour", _hours_back(F.col("T"), F.col("_h")))
    rows = hours.select(key, "hour", *measures).withColumn("_side", F.lit(0)).unionByName(
        ask.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("hour", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = rows.withColumns({m: F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures}).filter(F.col("_side") == 1)
    return read.groupBy(key, "T").agg(*[_difference(m, n, h) for n, h in windows.items() for m in measures])


def channel_counters(sl: DataFrame, hourly: DataFrame, f_hours: DataFrame, rec: DataFrame, spec: JournalSpec) -> DataFrame:
    """All counters of the channel itself plus its last event, last fault and next fault, from one sorted pass.

    Hour rows are known after their hour ends, so they enter at ``hour + 1 h``; faults enter at their counting hour.
    Slices and hours are counted first: the pass gets partitions by their number, so a task's sort does not grow with the journal.
    """
    spans = {"0": 0, **spec.windows}
    hour_rows = hourly.select(
        "ch", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), "last_ts",
        *[F.coalesce(F.col(src), F.lit(0)).alias(m) for m, src in HOUR_MEASURES.items()])
    rec_rows = rec.groupBy("ch", hour_after(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("rec"), F.sum("hours").alias("rec_h"))
    ask = sl.select("ch", "T", F.explode(F.array(*[F.lit(h) for h in spans.values()])).alias("_h"))
    ask = ask.withColumn("hour", _hours_back(F.col("T"), F.col("_h")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [hour_rows, f_hours, rec_rows, ask.withColumn("_side", F.lit(1))])
    rows = rows.withColumn("_side", F.coalesce("_side", F.lit(0)))
    rows = W.dealt(rows, ["ch"], sl.count() * len(spans) + hourly.count())
    past = Window.partitionBy("ch").orderBy("hour", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a frame that runs to the end is quadratic: the next fault is the last one along the reversed order
    future = Window.partitionBy("ch").orderBy(F.desc("hour"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measures = [*HOUR_MEASURES, *FAULT_MEASURES]
    read = rows.select(
        "ch", "T", "_h", "_side",
        *[F.coalesce(F.sum(m).over(past), F.lit(0)).alias(m) for m in measures],
        F.last("last_ts", ignorenulls=True).over(past).alias("last_ts"),
        F.last("last_fault", ignorenulls=True).over(past).alias("last_fault_ts"),
        F.last("first_fault", ignorenulls=True).over(future).alias("next_fault"),
    ).filter(F.col("_side") == 1)
    now = F.col("_h") == 0
    out = read.groupBy("ch", "T").agg(
        *[_difference(m, n, h) for n, h in spec.windows.items() for m in measures],
        F.max(F.when(now, F.col("last_ts"))).alias("last_ts"),
        F.max(F.when(now, F.col("last_fault_ts"))).alias("last_fault_ts"),
        F.max(F.when(now, F.col("next_fault"))).alias("next_fault"))
    return out.withColumns({"next_fault_ts": F.col("next_fault.ts"), "next_fault_kind": F.col("next_fault.kind")}).drop("next_fault")


# ---- feature table ---------------------------------------------------------------------------------------------------


def activity_features(spec: JournalSpec) -> dict[str, str]:
    """Features of the channel's own counters as SQL over the ``{measure}_{window}`` columns of ``channel_counters``."""
    month = spec.windows["30d"]
    out: dict[str, str] = {}
    for w, h in spec.windows.items():
        out[f"ev_{w}"] = f"ev_{w}"
        out[f"fault_msgs_{w}"] = f"fault_{w}"
        if w not in ("30d", "90d"):
            out[f"ev_ratio_{w}"] = f"ev_{w} / (greatest(ev_30d, 1) * {h} / {month}D)"
    for w in ("24h", "7d", "30d", "90d"):
        out[f"disc_msgs_{w}"] = f"disc_{w}"
        for m in ("unc", "off", "alarm"):
            out[f"{m}_share_{w}"] = f"{m}_{w} / greatest(ev_{w}, 1)"
        out[f"status_changes_{w}"], out[f"txt_{w}"] = f"chg_{w}", f"txt_{w}"
    for w in ("24h", "7d", "30d"):
        mean = f"try_divide(sv_{w}, num_{w})"
        out[f"num_{w}"] = f"num_{w}"
        out[f"v_mean_{w}"] = mean
        # greatest() skips NULL: a channel without readings has spread zero, as in the feature contract
        out[f"v_std_{w}"] = f"sqrt(greatest(try_divide(sv2_{w}, num_{w}) - pow({mean}, 2), 0D))"
        out[f"stuck_share_{w}"] = f"try_divide(same_{w}, num_{w})"
        out[f"sentinel_{w}"], out[f"date1970_{w}"] = f"sent_{w}", f"d1970_{w}"
    out["sentinel_share_7d"] = "sent_7d / greatest(ev_7d, 1)"
    out["date_current_7d"] = "date_7d - d1970_7d"
    for w in ("24h", "7d"):
        out[f"gas1_work_{w}"], out[f"gas1_offhours_{w}"], out[f"gas_detected_{w}"] = f"g1wk_{w}", f"g1off_{w}", f"gdet_{w}"
    for w in ("7d", "30d"):
        out[f"gas5_{w}"] = f"g5_{w}"
    for w in ("24h", "7d", "30d", "90d"):
        out[f"faults_{w}"], out[f"link_losses_{w}"] = f"fall_{w}", f"flnk_{w}"
    for w in ("30d", "90d"):
        out[f"fault_episodes_{w}"], out[f"disc_episodes_{w}"] = f"fflt_{w}", f"fdsc_{w}"
        out[f"value_failures_{w}"], out[f"group_silences_{w}"] = f"fvf_{w}", f"grp_{w}"
    out["recoveries_90d"] = "rec_90d"
    out["recovery_h_90d"] = "try_divide(rec_h_90d, rec_90d)"
    return out


def surrounding_features(sl: DataFrame, f_hours: DataFrame, hourly: DataFrame, pulse: DataFrame, channels: DataFrame,
                         objects: DataFrame, spec: JournalSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counters of the object, the parent and the sensor type at the slice moments.

    Channels of one object share their moments: counters are computed once per (object, T), (parent, T), (type, T).
    """
    near = {w: spec.windows[w] for w in ("24h", "7d")}
    where = placed(f_hours.select("ch", "hour", "fall", "fflt"), channels, objects)
    probe = placed(sl, channels, objects)
    oids = probe.select("oid", "T").distinct()
    of = where.groupBy("oid", "hour").agg(F.sum("fall").alias("ob"))
    ph = phase_hours(hourly, channels, spec).withColumn("hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    obj = counters_at(oids, of.unionByName(ph, allowMissingColumns=True), "oid", ["ob", "po", "pe"], near)
    par = counters_at(probe.select("pid", "T"), where.groupBy("pid", "hour").agg(F.sum("fall").alias("pa")), "pid", ["pa"], near)
    tf = where.groupBy("st", "hour").agg(F.sum("fall").alias("ty"), F.sum("fflt").alias("tyf"))
    typ = counters_at(probe.select("st", "T"), tf, "st", ["ty", "tyf"], {**near, "90d": spec.windows["90d"]})
    active = pulse.filter(F.col("n_ev_30d") > 0).join(
        channels.select(F.col("id").alias("ch"), F.col("sensor_type").alias("st")), "ch")
    active = active.groupBy("day", "st").agg(F.count(F.lit(1)).alias("n_act"))
    typ = typ.withColumn("day", F.to_date("T")).join(active, ["day", "st"], "left").drop("day")
    return obj, par, typ


def feature_table(sl: DataFrame, hourly: DataFrame, norm: DataFrame, faults: DataFrame, gaps_eff: DataFrame,
                  clock: DataFrame, channels: DataFrame, objects: DataFrame, spec: JournalSpec,
                  variant: str = "b") -> DataFrame:
    """The wide feature table with labels, one row per slice."""
    pulse = daily_pulse(norm)
    f_hours = fault_hours(faults, spec, variant).join(channels.select(F.col("id").alias("ch")), "ch", "left_semi")
    rec = recoveries(faults, gaps_eff, spec, variant)
    own = channel_counters(sl, hourly, f_hours, rec, spec)
    own = overlap_seconds(own, clock, F.col("last_ts"), F.col("T"), "_dark")
    since = (seconds_between(F.col("last_ts"), F.col("T")) - F.coalesce("_dark", F.lit(0))) / 3600.0
    f = own.select(
        "ch", "T", *[F.expr(f"{e} AS {n}") for n, e in activity_features(spec).items()], since.alias("hours_since_event"),
        (seconds_between(F.col("last_fault_ts"), F.col("T")) / 86400.0).alias("days_since_fault"),
        "last_fault_ts", "next_fault_ts", "next_fault_kind")

    day_rows = pulse.select("ch", F.col("day").alias("_day"), (F.col("norm_s") / 3600.0).alias("norm_gap_h"),
                            (F.col("max_gap_7d") / 3600.0).alias("max_gap_7d_h"),
                            (F.col("max_gap_30d") / 3600.0).alias("max_gap_30d_h"),
                            "zero_days_30d", "daily_cv_30d", "history_days")
    f = f.withColumn("_day", F.to_date("T")).join(day_rows, ["ch", "_day"])
    last_day = F.to_date(F.timestamp_micros(F.unix_micros("T") - F.round(F.col("hours_since_event") * 3_600_000_000).cast("long")))
    last_norm = pulse.select("ch", F.col("day").alias("_day"), (F.col("norm_s") / 3600.0).alias("norm_last_h"))
    f = f.withColumn("_day", last_day).join(last_norm, ["ch", "_day"], "left").drop("_day")
    f = f.withColumns({
        "gap_to_norm": F.col("hours_since_event") / F.col("norm_gap_h"),
        "hours_to_norm": F.col("norm_last_h") - F.col("hours_since_event"),
    })

    obj, par, typ = surrounding_features(sl, f_hours, hourly, pulse, channels, objects, spec)
    dim = channels.select(
        F.col("id").alias("ch"), F.col("object_id").alias("oid"), F.col("sensor_type").alias("st"), "system_type",
        *[c for c in ("tag_depth", "tag_l2", "tag_l3", "has_pk", "has_ans", "has_shield", "has_vsh") if c in channels.columns])
    dim = dim.join(objects.select(F.col("id").alias("oid"), F.col("parent_id").alias("pid")), "oid")
    f = f.join(dim, "ch").join(obj, ["oid", "T"], "left").join(par, ["pid", "T"], "left").join(typ, ["st", "T"], "left")
    per_active = F.greatest("n_act", F.lit(1))
    f = f.withColumns({
        **{f"type_fault_rate_{w}": F.col(f"ty_{w}") / per_active for w in ("24h", "7d")},
        "type_fault_msg_rate_7d": F.col("tyf_7d") / per_active,
        "type_fault_trend_7d_90d": (F.col("ty_7d") / 7.0) / F.greatest(F.col("ty_90d") / 90.0, F.lit(1.0)),
        **{f"obj_faults_{w}": F.col(f"ob_{w}") - F.col(f"faults_{w}") for w in ("24h", "7d")},
        **{f"parent_faults_{w}": F.col(f"pa_{w}") for w in ("24h", "7d")},
        **{f"obj_phase_off_share_{w}": F.col(f"po_{w}") / F.greatest(f"pe_{w}", F.lit(1)) for w in ("24h", "7d")},
        "cal_hour": F.hour("T"), "cal_dow": F.weekday("T") + 1, "cal_month": F.month("T"),
        "cal_weekend": (F.weekday("T") >= 5).cast("int"),
    }).drop("ob_24h", "ob_7d", "pa_24h", "pa_7d", "po_24h", "po_7d", "pe_24h", "pe_7d", "ty_24h", "ty_7d", "ty_90d",
            "tyf_24h", "tyf_7d", "tyf_90d", "n_act")
    f = f.withColumnsRenamed({"oid": "object_id", "pid": "parent_id", "st": "sensor_type"})
    return attach_label(neighbour_features(f), sl, clock, spec)


def neighbour_features(f: DataFrame) -> DataFrame:
    """Deviation from the same-type channels of the object at the same moment, and the share of them that is silent.

    Group medians come from an aggregate with partial buffers and return by an equi-join, so no group is gathered whole.
    """
    compared = ("ev_ratio_24h", "v_mean_24h", "unc_share_24h")
    late = (F.col("hours_to_norm") < 0).cast("int")
    keys = ["object_id", "sensor_type", "T"]
    group = f.groupBy(*keys).agg(
        *[F.median(c).alias(f"_m_{c}") for c in compared], F.count(F.lit(1)).alias("_n"), F.sum(late).alias("_late"))
    out = f.join(group, keys)
    return out.withColumns({
        **{f"nb_dev_{c}": F.col(c) - F.col(f"_m_{c}") for c in compared},
        "nb_same_type": F.col("_n") - 1,
        "nb_silent_share": (F.col("_late") - F.coalesce(late, F.lit(0))) / F.greatest(F.col("_n") - 1, F.lit(1)),
    }).drop("_n", "_late", *[f"_m_{c}" for c in compared])


# ---- labels ----------------------------------------------------------------------------------------------------------


def dark_moments(sl: DataFrame, clock: DataFrame, spec: JournalSpec, out: str = "_dark") -> DataFrame:
    """Slice moments with a journal outage near them. Slices share their moments, so each is looked up once."""
    return flag_near_window(sl.select("T").distinct(), clock, "T", 24, spec.horizon_h, out)


def attach_label(f: DataFrame, sl: DataFrame, clock: DataFrame, spec: JournalSpec) -> DataFrame:
    """``y``: a fault in ``(T, T + horizon]``; NULL while the horizon is open. ``eligible``: no fault just before and no
    journal outage around the slice."""
    end = F.col("T") + F.expr(f"make_dt_interval(0, {spec.horizon_h})")
    hit = F.coalesce(F.col("next_fault_ts") <= end, F.lit(False))
    f = f.join(dark_moments(sl, clock, spec), "T")
    calm = F.col("last_fault_ts").isNull() | (
        F.col("last_fault_ts") <= F.col("T") - F.expr(f"make_dt_interval(0, {spec.exclude_h})"))
    return f.withColumns({
        "y": F.when(end <= F.lit(spec.data_end).cast("timestamp"), hit.cast("int")),
        "fault_at": F.when(hit, F.col("next_fault_ts")), "fault_kind": F.when(hit, F.col("next_fault_kind")),
        "eligible": calm & ~F.col("_dark"),
    }).drop("_dark")


def label(sl: DataFrame, faults: DataFrame, spec: JournalSpec, variant: str) -> DataFrame:
    """Label of one variant by a forward and a backward as-of lookup; columns end with the variant's name."""
    clean = faults.filter(clean_fault(spec, variant)).select("ch", F.col("ts").alias("nts"), F.col("kind").alias("nkind"))
    s = asof_many(sl.select("ch", "T"), ["ch"], "T", [
        Lookup(clean, "nts", ["nkind"], "forward", strict=True), Lookup(clean.select("ch", F.col("nts").alias("lts")), "lts")])
    end = F.col("T") + F.expr(f"make_dt_interval(0, {spec.horizon_h})")
    hit = F.coalesce(F.col("nts") <= end, F.lit(False))
    calm = F.col("lts").isNull() | (F.col("lts") <= F.col("T") - F.expr(f"make_dt_interval(0, {spec.exclude_h})"))
    return s.select(
        "ch", "T", F.when(end <= F.lit(spec.data_end).cast("timestamp"), hit.cast("int")).alias(f"y_{variant}"),
        F.when(hit, F.col("nkind")).alias(f"kind_{variant}"), F.when(hit, F.col("nts")).alias(f"at_{variant}"),
        calm.alias(f"elig_{variant}"))


def label_variants(slice_sets: list[DataFrame], faults: DataFrame, clock: DataFrame, spec: JournalSpec) -> DataFrame:
    """Variants a, b, c side by side for the union of slice sets, with the slices near a journal outage marked."""
    sl = union_distinct(slice_sets, ["ch", "T"])
    wide = reduce(lambda a, b: a.join(b, ["ch", "T"], "left"), [label(sl, faults, spec, v) for v in ("a", "b", "c")])
    return wide.join(dark_moments(sl, clock, spec, "outage_slice"), "T")


def label_counts(variants: DataFrame) -> DataFrame:
    """Slices and positives of each variant per half-year."""
    pos = lambda v: F.sum(F.when(F.col(f"elig_{v}") & ~F.col("outage_slice"), F.col(f"y_{v}")))
    return variants.groupBy(F.year("T").alias("year"), ((F.month("T") > 6).cast("int") + 1).alias("half")).agg(
        F.count(F.lit(1)).alias("n"), *[pos(v).alias(f"pos_{v}") for v in ("a", "b", "c")])


def silent_windows(norm: DataFrame, channels: DataFrame, dark_days: DataFrame, sensor_type: str, spec: JournalSpec) -> DataFrame:
    """Runs of at least two days when most active channels of a type in an object sent nothing."""
    typed = channels.filter(F.col("sensor_type") == sensor_type).select(F.col("id").alias("ch"), "object_id")
    n = norm.filter(F.col("n_ev_30d") > 0).join(dark_days, "day", "left_anti").join(typed, "ch")
    d = n.groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("n_ev") == 0).alias("silent"))
    s = d.filter((F.col("silent") >= spec.group_min_channels) & (F.col("silent") >= spec.group_min_share * F.col("active")))
    runs = W.day_islands(s, ["object_id"], "day").groupBy("object_id", "island").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"),
        F.max("silent").alias("silent"), F.max("active").alias("active"))
    return runs.filter(F.col("days") >= 2).drop("island")
