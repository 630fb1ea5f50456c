"""Questions "as of a moment" over predictions, outcomes, decisions, work orders and recent events.

A prediction table has ``(id, channel_id, at, horizon_h, prob, health, risk_level, model_version)``. The published tables are partitioned by
``day`` (of ``at`` or ``ts``): where that column is there, every question filters it too, so other days are neither listed nor read. Which snapshot is the last
one before a moment is asked of ``moments``, the index with one row per snapshot; without it, of the predictions themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.functions.risk import ALERT_LEVELS, LEVELS, level_in, risk_level_from_prob, round_prob
from lullwatch.functions.text import formula_safe
from lullwatch.functions.values import is_date_value
from lullwatch.operators.asof import asof_join
from lullwatch.operators.carry import band_distinct_count
from lullwatch.operators.intervals import seconds_between
from lullwatch.operators.ranking import heads_and_rest, latest_by, page
from lullwatch.operators.sets import union_distinct
from lullwatch.operators.tree import filter_channels, tree_rollup
from lullwatch.spec import JournalSpec, RiskBounds

OPEN_STATUSES = ("draft", "submitted", "in_progress")


def moment(at: str | Column) -> Column:
    return F.lit(at).cast("timestamp") if isinstance(at, str) else at


def hours(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, {n})")


def level(bounds: RiskBounds | None) -> Column:
    """Stored level, or the level of the probability when the bounds were changed."""
    return F.col("risk_level") if bounds is None else risk_level_from_prob(F.col("prob"), bounds)


def has_level(levels: Sequence[str], bounds: RiskBounds | None) -> Column:
    return F.col("risk_level").isin(*levels) if bounds is None else level_in(F.col("prob"), levels, bounds)


def on_days(df: DataFrame, lo: Column | None, hi: Column | None) -> DataFrame:
    """Partitions from the day of ``lo`` to the day of ``hi``; tables without a ``day`` column pass as they are."""
    if "day" not in df.columns:
        return df
    for cond in ([F.col("day") >= F.to_date(lo)] if lo is not None else []) + ([F.col("day") <= F.to_date(hi)] if hi is not None else []):
        df = df.filter(cond)
    return df


def snapshot_moments(preds: DataFrame) -> DataFrame:
    """The index ``moments``: one row per day, snapshot and horizon, with its number of predictions."""
    return preds.groupBy(F.to_date("at").alias("day"), "at", "horizon_h").agg(F.count(F.lit(1)).alias("n"))


def snapshot_at(preds: DataFrame, at: str, moments: DataFrame | None = None) -> Column:
    """The last prediction moment not after ``at``, as a scalar subquery (NULL before the first one)."""
    table = preds if moments is None else moments
    return on_days(table, None, moment(at)).filter(F.col("at") <= moment(at)).agg(F.max("at")).scalar()


def snapshot(preds: DataFrame, at: str, moments: DataFrame | None = None) -> DataFrame:
    snap = snapshot_at(preds, at, moments)
    return on_days(preds, snap, snap).filter(F.col("at") == snap)


def with_channel(preds: DataFrame, channels: DataFrame) -> DataFrame:
    c = channels.select(F.col("id").alias("channel_id"), "object_id", "sensor_type", "system_type", "name", "tag")
    return preds.join(c, "channel_id")


def predictions_at(preds: DataFrame, channels: DataFrame, objects: DataFrame, at: str, levels: Sequence[str] | None = None,
                   min_prob: float | None = None, bounds: RiskBounds | None = None, moments: DataFrame | None = None, **channel_filters) -> DataFrame:
    """Predictions of the snapshot with filters; order with ``page(…, [desc prob, id])``."""
    snap = snapshot(preds, at, moments)
    if levels:
        snap = snap.filter(has_level(levels, bounds))
    if min_prob is not None:
        snap = snap.filter(F.col("prob") >= min_prob)
    return with_channel(snap, filter_channels(channels, objects, **channel_filters))


# ---- decisions, orders, outcomes -------------------------------------------------------------------------------------


def latest_decisions(decisions: DataFrame, at: str | None = None) -> DataFrame:
    d = decisions if at is None else decisions.filter(F.col("created_at") <= moment(at))
    return latest_by(d, ["prediction_id"], ["id"], ["id", "decision_type", "reason_id", "created_at"]).withColumnRenamed(
        "id", "decision_id").withColumnRenamed("created_at", "decided_at")


def latest_orders(orders: DataFrame, at: str | None = None) -> DataFrame:
    """Last order of a prediction that was not cancelled."""
    o = orders.filter((F.col("status") != "cancelled") & F.col("prediction_id").isNotNull())
    if at is not None:
        o = o.filter(F.col("created_at") <= moment(at))
    return latest_by(o, ["prediction_id"], ["id"], ["id", "number", "status"]).withColumnsRenamed(
        {"id": "order_id", "number": "order_number", "status": "order_status"})


def visible_outcome(at: str) -> Column:
    """An outcome is known only once the horizon has closed."""
    return F.col("at") + F.make_dt_interval(hours=F.col("horizon_h")) <= moment(at)


def enrich(preds: DataFrame, decisions: DataFrame, orders: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    o = outcomes.withColumnsRenamed({"prediction_id": "id"}).select("id", "happened", "fault_at")
    out = (
        preds.drop("happened", "fault_at", "fault_kind")
        .join(latest_decisions(decisions, at).withColumnRenamed("prediction_id", "id"), "id", "left")
        .join(latest_orders(orders, at).withColumnRenamed("prediction_id", "id"), "id", "left")
        .join(o, "id", "left")
    )
    seen = visible_outcome(at)
    return out.withColumns({"prob": round_prob(F.col("prob")), "happened": F.when(seen, F.col("happened")),
                            "fault_at": F.when(seen, F.col("fault_at"))})


def open_at(at: str) -> Column:
    return (F.col("created_at") <= moment(at)) & (F.col("status").isin(*OPEN_STATUSES) | (F.col("closed_at") > moment(at)))


# ---- dashboard, tree, channels ---------------------------------------------------------------------------------------


def accuracy(preds: DataFrame, outcomes: DataFrame, at: str, threshold: float) -> DataFrame:
    """Confusion of the month before ``at`` over predictions whose horizon has closed."""
    lo, hi = moment(at) - F.expr("INTERVAL 30 DAYS"), moment(at) - hours(24)
    p = on_days(preds, lo, hi).filter((F.col("at") > lo) & (F.col("at") <= hi))
    j = p.select("id", "prob").join(on_days(outcomes, lo, hi).select(F.col("prediction_id").alias("id"), "happened"), "id")
    alert = F.col("prob") >= threshold
    c = j.agg(F.count_if(alert & F.col("happened")).alias("tp"), F.count_if(alert & ~F.col("happened")).alias("fp"),
              F.count_if(~alert & F.col("happened")).alias("fn"))
    return c.withColumns({"precision": F.bround(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 3),
                          "recall": F.bround(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 3)})


def dashboard(preds: DataFrame, orders: DataFrame, channels: DataFrame, at: str, threshold: float,
              bounds: RiskBounds | None = None, moments: DataFrame | None = None) -> DataFrame:
    """One row: channels per level, predicted and expected failures, open orders, channels in all."""
    snap = snapshot(preds, at, moments).withColumn("lvl", level(bounds))
    d = snap.agg(
        *[F.count_if(F.col("lvl") == x).alias(x) for x in LEVELS],
        F.count_if(F.col("lvl").isin(*ALERT_LEVELS)).alias("channels_at_risk"),
        F.count_if(F.col("prob") >= threshold).alias("predicted_failures"),
        F.round(F.coalesce(F.sum("prob"), F.lit(0.0)), 1).alias("expected_failures"))
    return d.withColumns({
        "open_orders": orders.filter(open_at(at)).agg(F.count(F.lit(1))).scalar(),
        "channels_total": channels.agg(F.count(F.lit(1))).scalar()})


def object_tree(preds: DataFrame, channels: DataFrame, objects: DataFrame, at: str, bounds: RiskBounds | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Every object with the channels and levels of its subtree; channels without a prediction count as channels only.

    Channels are combined per own object first, so the join with the closure sees one row per object.
    """
    c = channels.select(F.col("id").alias("channel_id"), "object_id")
    snap = snapshot(preds, at, moments).withColumn("lvl", level(bounds)).select("channel_id", "lvl")
    direct = c.join(snap, "channel_id", "left").groupBy("object_id").agg(
        F.count(F.lit(1)).alias("channels"), *[F.count_if(F.col("lvl") == x).alias(x) for x in LEVELS])
    rolled = tree_rollup(direct, objects, "object_id", [F.sum(x).alias(x) for x in ("channels", *LEVELS)])
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("channels", *LEVELS)}
    top = F.when(F.col("critical") > 0, "critical").when(F.col("risk") > 0, "risk").when(
        F.col("attention") > 0, "attention").when(F.col("normal") > 0, "normal")
    return rolled.withColumns(zero).withColumn("max_risk_level", top)


def channels_at(preds: DataFrame, channels: DataFrame, objects: DataFrame, at: str, levels: Sequence[str] | None = None,
                bounds: RiskBounds | None = None, moments: DataFrame | None = None, **channel_filters) -> DataFrame:
    """Channels with their prediction of the snapshot; channels without one stay unless a level is asked."""
    snap = snapshot(preds, at, moments).select(F.col("id").alias("prediction_id"), F.col("channel_id").alias("id"), "prob", "health",
                                      "risk_level")
    out = filter_channels(channels, objects, **channel_filters).join(snap, "id", "left")
    return out.filter(has_level(levels, bounds)) if levels else out


def by_risk(df: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    return page(df, [F.desc_nulls_last("prob"), F.col(key)], limit, offset)


def last_events(events: DataFrame) -> DataFrame:
    """The last event of every channel and day: ``day, ch, ts, raw, is_alarm``."""
    e = events.withColumn("day", F.to_date("ts"))
    return latest_by(e, ["day", "ch"], ["ts", "raw"], ["ts", "raw", "is_alarm"])


def channel_cards(preds: DataFrame, events: DataFrame, decisions: DataFrame, orders: DataFrame, channels: DataFrame,
                  at: str, moments: DataFrame | None = None, day_last: DataFrame | None = None) -> DataFrame:
    """Card facts of all channels: prediction, last event, open orders, and whether the last decision was to watch.

    ``day_last``: the last event of each channel and day (``last_events``); with it the journal is read on the day of ``at`` only.
    """
    t = moment(at)
    snap = snapshot(preds, at, moments).select(F.col("channel_id").alias("id"), "prob", "health", "risk_level")
    said_last = events.filter(F.col("ts") <= t).select("ch", "ts", "raw", "is_alarm")
    if day_last is not None:  # of earlier days only the last event of a channel is read
        said_last = on_days(events, t, t).filter(F.col("ts") <= t).select("ch", "ts", "raw", "is_alarm").unionByName(
            day_last.filter(F.col("day") < F.to_date(t)).select("ch", "ts", "raw", "is_alarm"))
    last = latest_by(said_last.withColumnRenamed("ch", "id"), ["id"], ["ts", "raw"],
                     ["ts", "raw", "is_alarm"]).withColumnsRenamed({"ts": "last_ts", "raw": "last_value", "is_alarm": "last_alarm"})
    open_orders = orders.filter((F.col("created_at") <= t) & F.col("status").isin(*OPEN_STATUSES)).groupBy(
        F.col("channel_id").alias("id")).agg(F.count(F.lit(1)).alias("open_orders"))
    week = t - F.expr("INTERVAL 7 DAYS")
    recent = on_days(preds, week, t).filter((F.col("at") <= t) & (F.col("at") > week)).select(
        F.col("id").alias("prediction_id"), "channel_id")
    said = decisions.filter(F.col("created_at") <= t).join(recent, "prediction_id")
    watch = latest_by(said, ["channel_id"], ["id"], ["decision_type"]).select(
        F.col("channel_id").alias("id"), (F.col("decision_type") == "monitor").alias("on_watch"))
    out = channels
    for part in (snap, last, open_orders, watch):
        out = out.join(part, "id", "left")
    return out.withColumns({"open_orders": F.coalesce("open_orders", F.lit(0)), "on_watch": F.coalesce("on_watch", F.lit(False))})


# ---- histories -------------------------------------------------------------------------------------------------------


def hourly_history(events: DataFrame, channels: DataFrame, date_from: str, date_to: str, spec: JournalSpec) -> DataFrame:
    """Exactly one row per channel and hour of the period; the last hour holds ``date_to``. ``channels(ch)``."""
    lo, hi = moment(date_from), moment(date_to)
    last = F.date_trunc("hour", hi)
    n = F.round((F.unix_timestamp(hi) - F.unix_timestamp(lo)) / 3600).cast("long")
    first = F.timestamp_seconds(F.unix_timestamp(last) - (n - 1) * 3600)
    grid = channels.select("ch", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    e = on_days(events, lo, hi).filter((F.col("ts") > lo) & (F.col("ts") <= hi)).withColumn("hour", F.date_trunc("hour", "ts"))
    e = e.join(channels, "ch", "left_semi")
    w = Window.partitionBy("ch", "hour").orderBy("ts", "raw").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_prev", F.last("txt", ignorenulls=True).over(w))
    per = e.groupBy("ch", "hour").agg(
        F.count(F.lit(1)).alias("events_count"), F.count_if("is_alarm").alias("alarm_count"),
        F.count_if(F.col("txt").isin(*spec.fault_statuses)).alias("fault_count"),
        F.count_if(F.col("txt") == spec.uncertain[0]).alias("uncertain_count"),
        F.count_if(F.col("txt") != F.col("_prev")).alias("status_changes"),
        F.round(F.avg("num"), 4).alias("value_avg"), F.min("num").alias("value_min"), F.max("num").alias("value_max"))
    counts = ("events_count", "alarm_count", "fault_count", "uncertain_count", "status_changes")
    return grid.join(per, ["ch", "hour"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def fault_marks(faults: DataFrame, events: DataFrame, spec: JournalSpec) -> DataFrame:
    """Distinct fault marks of the labels and of status messages."""
    status = events.filter(F.col("txt").isin(*spec.fault_statuses)).select("ch", "ts", F.col("txt").alias("kind"))
    return union_distinct([faults, status], ["ch", "ts", "kind"])


def daily_history(daily: DataFrame, preds: DataFrame, faults: DataFrame, events: DataFrame, at: str, days: int,
                  spec: JournalSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Day points, fault marks and prediction points of the last ``days`` days."""
    hi = moment(at)
    lo = hi - F.make_dt_interval(days=F.lit(days))
    points = daily.filter((F.col("day") > F.to_date(lo)) & (F.col("day") <= F.to_date(hi)))
    marks = fault_marks(on_days(faults, lo, hi), on_days(events, lo, hi), spec).filter((F.col("ts") > lo) & (F.col("ts") <= hi))
    scores = on_days(preds, lo, hi).filter((F.col("at") > lo) & (F.col("at") <= hi)).select(
        "channel_id", "id", "at", round_prob(F.col("prob")).alias("prob"), "health", "risk_level")
    return points, marks, scores


def journal(preds: DataFrame, channels: DataFrame, objects: DataFrame, decisions: DataFrame, outcomes: DataFrame, at: str,
            date_from: str | None = None, date_to: str | None = None, only_alerts: bool = True,
            levels: Sequence[str] | None = None, decision: str | None = None, outcome: str | None = None,
            bounds: RiskBounds | None = None, moments: DataFrame | None = None, **channel_filters) -> DataFrame:
    """Prediction journal of a period (a week up to the snapshot by default). Joins appear only for the filters in use."""
    if date_from:
        check_period(date_from, min(date_to or at, at, key=datetime.fromisoformat))
    hi = F.least(moment(date_to), moment(at)) if date_to else moment(at)
    lo = moment(date_from) if date_from else F.coalesce(snapshot_at(preds, at, moments), moment(at)) - F.expr("INTERVAL 7 DAYS")
    p = on_days(preds, lo, hi).filter((F.col("at") >= lo) & (F.col("at") <= hi)).drop("happened", "fault_at", "fault_kind", "day")
    said = latest_decisions(decisions, at).withColumnRenamed("prediction_id", "id")
    if only_alerts or decision:
        p = p.join(said.select("id", "decision_type"), "id", "left")
    if only_alerts:
        p = p.filter(has_level(ALERT_LEVELS, bounds) | F.col("decision_type").isNotNull())
    if levels:
        p = p.filter(has_level(levels, bounds))
    if decision:
        p = p.filter(F.col("decision_type").isNull() if decision == "none" else F.col("decision_type") == decision)
    if outcome:
        p = p.join(on_days(outcomes, lo, hi).select(F.col("prediction_id").alias("id"), "happened"), "id", "left")
        known = F.col("happened").isNotNull() & visible_outcome(at)
        p = p.filter({"happened": known & F.col("happened"), "not_happened": known & ~F.col("happened"), "unknown": ~known}[outcome])
    return with_channel(p, filter_channels(channels, objects, **channel_filters))


def journal_order() -> list[Column]:
    return [F.desc("at"), F.desc("prob"), F.col("id")]


def daily_facts(preds: DataFrame, outcomes: DataFrame, threshold: float, date_from: str, date_to: str) -> DataFrame:
    """Predicted and actual failures per day, counted in channel-days."""
    lo, hi = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    p = on_days(preds, lo, hi).filter((F.to_date("at") >= lo) & (F.to_date("at") <= hi))
    j = p.select("id", "channel_id", "at", "prob").join(on_days(outcomes, lo, hi).select(F.col("prediction_id").alias("id"), "happened"), "id")
    alert = F.col("prob") >= threshold
    per = j.groupBy(F.to_date("at").alias("day"), "channel_id").agg(
        F.max(alert.cast("int")).alias("p"), F.max(F.col("happened").cast("int")).alias("f"),
        F.max((alert & F.col("happened")).cast("int")).alias("t"))
    return per.groupBy("day").agg(F.sum("p").alias("predicted"), F.sum("f").alias("actual"), F.sum("t").alias("true_positive"))


# ---- model screen ----------------------------------------------------------------------------------------------------


def current_version(thresholds: DataFrame, metrics: DataFrame, preds: DataFrame) -> Column:
    """Version with a selected threshold, else of the newest metrics, else of the newest prediction."""
    chosen = thresholds.filter("is_selected").agg(F.min("model_version")).scalar()
    measured = metrics.agg(F.max_by("model_version", "computed_at")).scalar()
    used = preds.agg(F.max_by("model_version", "at")).scalar()
    return F.coalesce(chosen, measured, used)


def working_threshold(thresholds: DataFrame) -> Column:
    return F.coalesce(thresholds.filter("is_selected").agg(F.min("threshold")).scalar(), F.lit(0.5))


def model_screen(metrics: DataFrame, version: Column) -> DataFrame:
    """Metrics of the version with the order of each block: types by support, list sizes by K, the rest by key."""
    m = metrics.filter(F.col("model_version") == version)
    key = F.col("key").try_cast("int")
    w = Window.partitionBy("scope").orderBy(
        F.when(F.col("scope") == "sensor_type", F.col("support")).desc_nulls_last(),
        F.when(F.col("scope") == "precision_at_k", key).asc_nulls_last(), "key")
    return m.withColumn("pos", F.row_number().over(w))


# ---- events ----------------------------------------------------------------------------------------------------------


def check_period(date_from: str, date_to: str, max_days: int | None = None) -> None:
    """A period that is reversed, or longer than an answer may be, is refused."""
    span = datetime.fromisoformat(date_to) - datetime.fromisoformat(date_from)
    if span < timedelta(0) or max_days is not None and span > timedelta(days=max_days):
        limit = "" if max_days is None else f" and cover at most {max_days} days"
        raise ValueError(f"the period must run forward{limit}: {date_from} to {date_to}")


def events_at(events: DataFrame, at: str, spec: JournalSpec, kind: str = "status", only_alarms: bool = True,
              date_from: str | None = None, date_to: str | None = None, max_days: int = 31, day_last: DataFrame | None = None) -> DataFrame:
    """Event journal; the default period is the day before the last event not after ``at``, looked up in ``day_last`` where it is given."""
    if date_from:
        check_period(date_from, min(date_to or at, at, key=datetime.fromisoformat), max_days)
    hi = F.least(moment(date_to), moment(at)) if date_to else moment(at)
    if date_to is None:
        latest = lambda e: e.filter(F.col("ts") <= moment(at)).agg(F.max("ts")).scalar()
        if day_last is None:
            hi = F.coalesce(latest(on_days(events, None, moment(at))), hi)
        else:
            hi = F.coalesce(latest(on_days(events, moment(at), moment(at))), latest(day_last.filter(F.col("day") < F.to_date(moment(at)))), hi)
    lo = moment(date_from) if date_from else hi - hours(24)
    e = on_days(events, lo, hi).filter((F.col("ts") > lo) & (F.col("ts") <= hi))
    if only_alarms:
        e = e.filter("is_alarm")
    reading = F.col("kind").isin("number", "sentinel")
    if kind == "status":
        code = F.col("raw").try_cast("double").isin(*spec.sentinel_codes)
        e = e.filter(~reading | code)
    elif kind == "values":
        e = e.filter(reading)
    return e


def tag_events(events: DataFrame, channels: DataFrame, spec: JournalSpec) -> DataFrame:
    """Adds ``tags``: value failure, and planned check for gas in working hours of weekdays."""
    c = channels.select(F.col("id").alias("ch"), (F.col("sensor_type") == spec.gas_type).alias("_gas"))
    e = events.join(c, "ch").withColumn("_x", F.replace("raw", F.lit(","), F.lit(".")).try_cast("double"))
    service = F.col("_x").isin(*spec.sentinel_codes) | (F.abs("_x") >= spec.sentinel_abs)
    plain = F.col("_x").isNotNull() & ~service
    failed = F.coalesce(service, F.lit(False)) | is_date_value(F.col("raw"), spec) | F.coalesce(
        F.col("_gas") & plain & (F.col("_x") < 0), F.lit(False))
    gas = (F.trim("raw") == spec.gas_detected) | F.coalesce(F.col("_gas") & plain & (F.col("_x") >= spec.gas_alarm), F.lit(False))
    lo, hi = spec.work_hours
    in_hours = (F.weekday("ts") < 5) & F.hour("ts").between(lo, hi)
    tags = F.array(F.when(failed, "value_failure"), F.when(gas & in_hours, "planned_check"))
    return e.withColumn("tags", F.array_compact(tags)).drop("_x", "_gas")


def tag_group_off(events: DataFrame, faults: DataFrame, channels: DataFrame, objects: DataFrame, spec: JournalSpec) -> DataFrame:
    """Status events during a group switch-off: enough same-type channels of the object, or else of its parent, have a
    status or fault mark within the tolerance. Peers are counted by a sweep, never listed."""
    group = (*spec.fault_statuses, spec.power_off)
    c = channels.join(objects.select(F.col("id").alias("object_id"), F.col("parent_id").alias("pid")), "object_id").select(
        F.col("id").alias("ch"), F.col("object_id").alias("oid"), "pid", F.col("sensor_type").alias("st"))
    hit = events.filter(F.trim("raw").isin(*group)).select("event_id", "ch", "ts")
    marks = union_distinct([hit, faults], ["ch", "ts"]).withColumnRenamed("ts", "mark").join(c, "ch")
    out = hit.join(c, "ch")
    for key, n in (("oid", "obj"), ("pid", "par")):
        size = c.filter(F.col(key).isNotNull()).groupBy(key, "st").agg(F.count(F.lit(1)).alias(f"peers_{n}"))
        near = band_distinct_count(out, marks, [key, "st"], "ch", "ts", "mark", spec.group_tolerance_h, f"off_{n}")
        out = out.join(size, [key, "st"], "left").join(near, [key, "st", "ts"], "left")
    enough = lambda n: F.coalesce((F.col(f"peers_{n}") >= spec.group_min_channels) & (
        F.col(f"off_{n}") / F.col(f"peers_{n}") >= spec.group_min_share), F.lit(False))
    scope = F.when(enough("obj"), "object").when(enough("par"), "parent")
    pick = lambda a: F.when(F.col("scope") == "object", F.col(f"{a}_obj")).otherwise(F.col(f"{a}_par"))
    return out.withColumn("scope", scope).filter(F.col("scope").isNotNull()).select(
        "event_id", "ch", "ts", "scope", pick("off").alias("off"), pick("peers").alias("peers"))


# ---- outcomes and alerts ---------------------------------------------------------------------------------------------


def label_outcomes(preds: DataFrame, outcomes: DataFrame, faults: DataFrame, events: DataFrame, now: str, spec: JournalSpec,
                   until=None) -> DataFrame:
    """New outcomes: the first fault mark in ``(at, at + horizon]`` of predictions that are not labelled yet and whose
    horizon lies inside the data: up to its last event, or up to the moment ``until``."""
    until = events.agg(F.least(F.max("ts"), moment(now))).scalar() if until is None else F.lit(until)
    p = on_days(preds, None, until).select("id", F.col("channel_id").alias("ch"), "at", "horizon_h").filter(
        F.col("at") + F.make_dt_interval(hours=F.col("horizon_h")) <= until)
    p = p.join(outcomes.select(F.col("prediction_id").alias("id")), "id", "left_anti")
    marks = fault_marks(faults, events, spec).select("ch", F.col("ts").alias("fault_at"), F.col("kind").alias("fault_kind"))
    j = asof_join(p, marks, ["ch"], "at", "fault_at", ["fault_kind"], direction="forward", strict=True)
    hit = F.coalesce(F.col("fault_at") <= F.col("at") + F.make_dt_interval(hours=F.col("horizon_h")), F.lit(False))
    return j.select(F.col("id").alias("prediction_id"), hit.alias("happened"), F.when(hit, F.col("fault_at")).alias("fault_at"),
                    F.when(hit, F.col("fault_kind")).alias("fault_kind"))


def critical_transitions(preds: DataFrame, date_from: str | Column, date_to: str | Column, cooldown_h: int = 24,
                         bounds: RiskBounds | None = None) -> DataFrame:
    """Channels that became critical and were not critical in any snapshot of the cooldown before."""
    lo, hi = moment(date_from), moment(date_to)
    c = on_days(preds, lo - hours(cooldown_h), hi).filter(has_level(["critical"], bounds) & (F.col("at") >= lo - hours(cooldown_h)) & (F.col("at") <= hi))
    prev = F.lag("at").over(Window.partitionBy("channel_id").orderBy("at"))
    c = c.select("id", "channel_id", "at", "prob").withColumn("_prev", prev)
    fresh = F.col("_prev").isNull() | (F.col("_prev") < F.col("at") - hours(cooldown_h))
    return c.filter((F.col("at") >= lo) & fresh).drop("_prev")


def transition_feed(preds: DataFrame, at: str, window_h: int, cooldown_h: int = 24, moments: DataFrame | None = None) -> DataFrame:
    """Transitions of the hours before the last snapshot."""
    end = snapshot_at(preds, at, moments)
    return critical_transitions(preds, end - hours(window_h) + F.expr("INTERVAL 1 MICROSECOND"), end, cooldown_h)


def transition_groups(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("at").agg(F.count(F.lit(1)).alias("count"))


def slice_notifications(transitions: DataFrame, per_slice: int = 3) -> DataFrame:
    """Up to ``per_slice`` single notices per snapshot and one summary of the rest."""
    return heads_and_rest(transitions, "at", [F.desc("prob"), F.col("id")], per_slice, "id")


# ---- work orders, ranges, dictionaries -------------------------------------------------------------------------------


def work_orders_at(orders: DataFrame, channels: DataFrame, objects: DataFrame, at: str, statuses: Sequence[str] | None = None,
                   priorities: Sequence[str] | None = None, object_id: int | None = None) -> DataFrame:
    o = orders.filter(F.col("created_at") <= moment(at))
    if statuses:
        o = o.filter(F.col("status").isin(*statuses))
    if priorities:
        o = o.filter(F.col("priority").isin(*priorities))
    c = filter_channels(channels, objects, object_id=object_id).select(F.col("id").alias("channel_id"), "name")
    return o.join(c, "channel_id")


def available_range(preds: DataFrame) -> DataFrame:
    """First and last day with predictions, and the last day that is complete (its last snapshot is not before 18:00)."""
    return preds.agg(F.to_date(F.min("at")).alias("first_day"), F.to_date(F.max("at")).alias("last_day"),
                     F.to_date(F.max("at") - hours(18)).alias("default_day"))


def dictionaries(channels: DataFrame) -> DataFrame:
    return channels.groupBy("system_type", "sensor_type").agg(F.count(F.lit(1)).alias("channels"))


def entries_for(dictionary: DataFrame, column: str, value: str) -> DataFrame:
    """Active dictionary entries for a value, and the generic ones."""
    return dictionary.filter(F.col("is_active") & ((F.col(column) == value) | F.col(column).isNull()))


def default_entry(channels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Default recommendation per sensor type: an entry for the type before a generic one, then the smallest id."""
    d = dictionary.filter("is_active")
    own = d.filter(F.col("sensor_type").isNotNull()).groupBy("sensor_type").agg(F.min("id").alias("own_id"))
    generic = d.filter(F.col("sensor_type").isNull()).agg(F.min("id")).scalar()
    types = channels.select("sensor_type").distinct()
    return types.join(own, "sensor_type", "left").select("sensor_type", F.coalesce("own_id", generic).alias("recommendation_id"))


def validate_decisions(requests: DataFrame, preds: DataFrame, reasons: DataFrame) -> DataFrame:
    """Adds ``error`` (NULL for a valid decision), the effective decision time and the reaction in minutes."""
    r = reasons.select(F.col("id").alias("reason_id"), F.col("decision_type").alias("_fits"), "is_active")
    p = preds.select(F.col("id").alias("prediction_id"), "at")
    j = requests.join(r, "reason_id", "left").join(p, "prediction_id", "left")
    error = (
        F.when(F.col("at").isNull(), "prediction not found")
        .when(~F.coalesce("is_active", F.lit(False)), "reason not found")
        .when(F.col("_fits").isNotNull() & (F.col("_fits") != F.col("decision_type")), "reason does not fit")
    )
    return j.withColumns({
        "error": error, "decided_at": F.greatest("created_at", "at"),
        "reaction_min": F.bround(seconds_between(F.col("at"), F.greatest("created_at", "at")) / 60, 1)}).drop("_fits", "is_active")


def decisions_export(decisions: DataFrame, preds: DataFrame, channels: DataFrame, reasons: DataFrame, outcomes: DataFrame,
                     at: str, date_from: str, date_to: str, max_days: int = 92) -> DataFrame:
    """Decisions with their predictions and outcomes; text that a spreadsheet would run is made safe."""
    lo, hi = moment(date_from), moment(date_to)
    check_period(date_from, date_to, max_days)
    p = on_days(preds, lo, hi).filter((F.col("at") >= lo) & (F.col("at") <= hi)).select(
        F.col("id").alias("prediction_id"), "channel_id", "at", "prob", "risk_level", "model_version")
    c = channels.select(F.col("id").alias("channel_id"), "sensor_type", "system_type", "object_id")
    r = reasons.select(F.col("id").alias("reason_id"), F.col("name").alias("reason"))
    d = decisions.filter(F.col("created_at") <= moment(at)).join(p, "prediction_id").join(c, "channel_id").join(r, "reason_id")
    d = d.join(outcomes.select("prediction_id", "happened", "fault_at", "fault_kind"), "prediction_id", "left")
    return d.select(
        F.col("id").alias("decision_id"), "prediction_id", "channel_id", formula_safe(F.col("sensor_type")).alias("sensor_type"),
        formula_safe(F.col("system_type")).alias("system_type"), "object_id", "at", round_prob(F.col("prob")).alias("prob"),
        "risk_level", "model_version", "decision_type", formula_safe(F.col("reason")).alias("reason"),
        *([formula_safe(F.col("comment")).alias("comment")] if "comment" in d.columns else []), "created_at",
        F.bround(seconds_between(F.col("at"), F.col("created_at")) / 60, 1).alias("reaction_min"),
        F.col("happened").cast("int").alias("happened"), "fault_at", "fault_kind")
