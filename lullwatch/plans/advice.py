"""Maintenance advice as a batch job: signals around each prediction, the first matching rule, the plan, draft orders.

Predictions ``(id, channel_id, at, prob, risk_level, top_factors, kind_probs)`` have whole-hour moments;
``top_factors`` is an array of ``(feature, value, norm)`` and ``kind_probs`` a map or NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullwatch.functions.risk import level_rank, likely_kind
from lullwatch.functions.text import feature_group, short_number
from lullwatch.operators.asof import Lookup, asof_join, asof_many
from lullwatch.operators.columns import by_shuffle, settle
from lullwatch.operators.carry import lasting_distinct_count, running_totals
from lullwatch.operators.intervals import newest_open_at
from lullwatch.operators.ranking import page
from lullwatch.plans.features import counters_at, hour_after
from lullwatch.plans.rules import PRIORITIES, RuleSet
from lullwatch.plans.serving import OPEN_STATUSES, has_level, hours, with_channel
from lullwatch.spec import JournalSpec, RiskBounds

MODEL_KINDS = ("link", "fault", "disconnected", "value")
FLAP_SUFFIXES = ("_1h", "_6h", "_24h")
# allowed status changes of a work order
TRANSITIONS = (("draft", "submitted"), ("draft", "cancelled"), ("submitted", "in_progress"), ("submitted", "draft"),
               ("submitted", "cancelled"), ("in_progress", "done"), ("in_progress", "cancelled"))


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def sensor_groups(sensor_type: Column, rules: RuleSet) -> Column:
    """Groups whose words occur in the type's name."""
    low = F.concat(F.lower(F.coalesce(sensor_type, F.lit(""))), F.lit(" "))
    return F.array_compact(F.array(*[F.when(_any([low.contains(w) for w in words]), F.lit(g)) for g, words in rules.groups.items()]))


def in_group(sensor_type: Column, rules: RuleSet, *names: str) -> Column:
    return F.arrays_overlap(sensor_groups(sensor_type, rules), F.array(*[F.lit(n) for n in names]))


def type_groups(channels: DataFrame, rules: RuleSet) -> DataFrame:
    """Sensor types with their groups and the lowest priority the groups ask for."""
    floor = F.greatest(F.lit(0), F.lit(0), *[
        F.when(F.array_contains("sensor_groups", g), PRIORITIES.index(p)).otherwise(0) for g, p in rules.min_priority_by_group.items()])
    t = channels.select("sensor_type").distinct().withColumn("sensor_groups", sensor_groups(F.col("sensor_type"), rules))
    return t.withColumn("floor_rank", floor)


# ---- signals ---------------------------------------------------------------------------------------------------------


def faults_or_days(faults: DataFrame, daily: DataFrame, spec: JournalSpec) -> DataFrame:
    """``ch, ts, kind``: the labelled faults, or, where there is none at all, the days with fault messages; a day counts when it has ended."""
    none = faults.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    ended = F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")
    days = daily.filter((F.col("fault_count") > 0) & none).select(F.col("channel_id").alias("ch"), ended.alias("ts"), F.lit(spec.fault).alias("kind"))
    return faults.select("ch", "ts", "kind").unionByName(days)


def fault_counts(preds: DataFrame, faults: DataFrame, spec: JournalSpec) -> DataFrame:
    """Faults of the channel in the last 30 and 90 days by kind."""
    kinds = {"link": spec.link_loss, "fault": spec.fault, "disc": spec.disconnected, "value": spec.value_failure}
    per = faults.groupBy(F.col("ch").alias("channel_id"), hour_after(F.col("ts")).alias("hour")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"f_{n}") for n, k in kinds.items()])
    probes = preds.select("channel_id", F.col("at").alias("T"))
    out = counters_at(probes, per, "channel_id", [f"f_{n}" for n in kinds], {"30d": 720, "90d": 2160})
    total = lambda w: reduce(lambda a, b: a + b, [F.col(f"f_{n}_{w}") for n in kinds])
    return out.withColumnRenamed("T", "at").withColumns({"faults_30d": total("30d"), "faults_90d": total("90d")})


def _status_counts(probes: DataFrame, events: DataFrame, spec: JournalSpec, quiet_days: int) -> DataFrame:
    """Fault and power-off messages of the last day; power-off counts as new when the quiet days before had none."""
    e = events.filter(F.col("txt").isin(*spec.fault_statuses, spec.power_off))
    per = e.groupBy(F.col("ch").alias("channel_id"), hour_after(F.col("ts")).alias("hour")).agg(
        F.count_if(F.col("txt").isin(*spec.fault_statuses)).alias("msgs"), F.count_if(F.col("txt") == spec.power_off).alias("off"))
    c = counters_at(probes, per, "channel_id", ["msgs", "off"], {"day": 24, "quiet": 24 + 24 * quiet_days})
    return c.select("channel_id", F.col("T").alias("at"), F.col("msgs_day").alias("fault_msgs_24h"),
                    F.when(F.col("off_quiet") == F.col("off_day"), F.col("off_day")).otherwise(0).alias("power_off_24h"))


def new_power_off(preds: DataFrame, events: DataFrame, channels: DataFrame, spec: JournalSpec, rules: RuleSet) -> DataFrame:
    """Own messages of the last day and the other phase sensors of the object where power-off has just appeared.

    A phase sensor can count only on days with a message of its own or on those after them: it is asked at the moments of these days alone, not at all moments of its object.
    """
    days = rules.params["power_quiet_days"]
    c = by_shuffle(channels.select(F.col("id").alias("channel_id"), "object_id", in_group(F.col("sensor_type"), rules, "power").alias("phase")))
    own = _status_counts(preds.select("channel_id", F.col("at").alias("T")), events, spec, days)
    seats = preds.join(c, "channel_id").select("object_id", F.col("at").alias("T")).distinct()
    off = events.filter(F.col("txt") == spec.power_off).select(F.col("ch").alias("channel_id"), F.to_date(hour_after(F.col("ts"))).alias("_day")).distinct()
    off = off.join(c.filter("phase"), "channel_id").select("channel_id", "object_id", F.explode(F.array("_day", F.date_add("_day", 1))).alias("_day")).distinct()
    asked = seats.withColumn("_day", F.to_date("T")).join(by_shuffle(off), ["object_id", "_day"]).select("channel_id", "T")
    phases = _status_counts(asked, events, spec, days).filter(F.col("power_off_24h") > 0).join(
        c.select("channel_id", "object_id"), "channel_id")
    per_object = phases.groupBy("object_id", "at").agg(F.count(F.lit(1)).alias("_off"))
    out = own.join(c, "channel_id").join(per_object, ["object_id", "at"], "left")
    self_off = (F.col("phase") & (F.col("power_off_24h") > 0)).cast("int")
    return out.select("channel_id", "at", "fault_msgs_24h", "power_off_24h",
                      (F.coalesce("_off", F.lit(0)) - self_off).alias("object_power_off"))


def has_silence(factors: Column) -> Column:
    return F.exists(factors, lambda f: feature_group(f["feature"]).isin("silence", "link_losses", "past_gaps"))


def _seats(channels: DataFrame) -> DataFrame:
    return by_shuffle(channels.select(F.col("id").alias("channel_id"), "object_id", F.col("sensor_type").alias("st")))


def _link_losses(faults: DataFrame, spec: JournalSpec) -> DataFrame:
    return faults.filter(F.col("kind") == spec.link_loss).select(F.col("ch").alias("channel_id"), F.col("ts").alias("lost_at"))


def last_losses(preds: DataFrame, faults: DataFrame, channels: DataFrame, spec: JournalSpec, bounds: RiskBounds | None = None) -> DataFrame:
    """Predictions with their object and type, whether they are risky for silence, and the channel's last loss of the link."""
    asked = preds.select("id", "channel_id", "at", (has_level(["risk", "critical"], bounds) & has_silence(F.col("top_factors"))).alias("risky"))
    return asof_join(asked, _link_losses(faults, spec).distinct(), ["channel_id"], "at", "lost_at").join(_seats(channels), "channel_id")


def silent_neighbours(preds: DataFrame, faults: DataFrame, channels: DataFrame, spec: JournalSpec,
                      bounds: RiskBounds | None = None,
                      keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build(),
                      lost: DataFrame | None = None) -> DataFrame:
    """Other channels of the object that are silent too: risky for silence in the same snapshot, or lost the link within a day.

    A loss of the link silences its channel for a day: such spans are merged per channel and swept over the snapshots. Risky channels that no span covers
    are added from their own snapshot; counts are those of the object minus the channel itself. ``keep`` as for ``signals``; ``lost``: a written ``last_losses``.
    """
    c = _seats(channels)
    asked = preds.select("channel_id", "at").join(c, "channel_id")
    p = last_losses(preds, faults, channels, spec, bounds) if lost is None else lost
    since = F.coalesce(F.col("lost_at") > F.col("at") - hours(24), F.lit(False))
    p = p.withColumns({"_lost": since, "_self": (since | F.coalesce("risky", F.lit(False))).cast("int")})
    risky = p.filter("_self = 1 and not _lost").groupBy("object_id", "st", "at").agg(F.count_distinct("channel_id").alias("_risky_type"))
    risky_all = risky.groupBy("object_id", "at").agg(F.sum("_risky_type").alias("_risky_all"))
    marks = _link_losses(faults, spec).join(c, "channel_id")
    by_type = keep("signals_lost_of_type", lambda: lasting_distinct_count(asked, marks, ["object_id", "st"], "channel_id", "at", "lost_at", 24, "_lost_type"))
    by_object = keep("signals_lost_of_object", lambda: lasting_distinct_count(asked, marks, ["object_id"], "channel_id", "at", "lost_at", 24, "_lost_all"))
    size_type = c.groupBy("object_id", "st").agg(F.count(F.lit(1)).alias("same_type_channels"))
    size = size_type.groupBy("object_id").agg(F.sum("same_type_channels").alias("object_channels"))
    out = (
        p.join(by_object, ["object_id", "at"], "left").join(by_type, ["object_id", "st", "at"], "left")
        .join(risky_all, ["object_id", "at"], "left").join(risky, ["object_id", "st", "at"], "left")
        .join(size_type, ["object_id", "st"]).join(size, "object_id")
    )
    others = lambda n: F.coalesce(f"_lost_{n}", F.lit(0)) + F.coalesce(f"_risky_{n}", F.lit(0)) - F.col("_self")
    return out.select("id", others("all").alias("neighbors_silent"), others("type").alias("same_type_silent"), "object_channels", "same_type_channels")


def fault_totals(faults: DataFrame) -> DataFrame:
    """``channel_id, f_ts, c``: the channel's faults up to each moment with one."""
    return running_totals(faults.select(F.col("ch").alias("channel_id"), F.col("ts").alias("f_ts")), ["channel_id"], "f_ts", {"c": F.lit(1)})


def repairs(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """Done orders with the channel's faults before them; ``totals`` as of ``fault_totals``."""
    done = orders.filter((F.col("status") == "done") & F.col("closed_at").isNotNull()).select(
        "channel_id", F.col("closed_at").alias("repaired_at"), F.col("id").alias("repair_id"), F.col("number").alias("repair_number"))
    return asof_join(done, totals, ["channel_id"], "repaired_at", "f_ts", ["c"]).withColumnRenamed("c", "_before").drop("f_ts")


def orders_asked(preds: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of the channels that have predictions: no others can be open or done at one."""
    return orders.join(by_shuffle(preds.select("channel_id").distinct()), "channel_id", "left_semi")


def order_state(preds: DataFrame, orders: DataFrame, faults: DataFrame, rules: RuleSet,
                keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build(),
                totals: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Open order at the moment, last repair within the repair days, faults after it, and a visit within a day.

    ``keep`` as for ``signals``; ``totals`` and ``done``: written ``fault_totals`` and ``repairs``, each of which the plan reads several times.
    """
    p = preds.select("id", "channel_id", "at")
    o = orders.select("channel_id", F.col("id").alias("order_id"), "number", "status", "created_at", "closed_at")
    # an order is open from its creation until it is closed; closing at the moment itself no longer counts
    closed = F.when(~F.col("status").isin(*OPEN_STATUSES), F.col("closed_at"))
    spans = o.filter(F.col("status").isin(*OPEN_STATUSES) | F.col("closed_at").isNotNull()).withColumn("_closed", closed)
    newest = keep("signals_open_orders", lambda: newest_open_at(
        p, spans, ["channel_id"], "at", "created_at", "_closed", ["order_id"], ["order_id", "number"]).withColumnRenamed("number", "open_order"))
    total = fault_totals(faults) if totals is None else totals
    done = repairs(orders, total) if done is None else done
    q = asof_many(p, ["channel_id"], "at", [
        Lookup(done, "repaired_at", ["repair_id", "repair_number", "_before"]),
        Lookup(total, "f_ts", ["c"])])
    q = q.join(by_shuffle(newest), ["channel_id", "at"], "left")
    fresh = F.col("repaired_at") >= F.col("at") - F.make_dt_interval(days=F.lit(rules.params["repair_days"]))
    after = F.when(fresh, F.coalesce("c", F.lit(0)) - F.coalesce("_before", F.lit(0)))
    q = q.withColumns({"faults_since_repair": after, "repair_number": F.when(fresh, F.col("repair_number")),
                       "repaired_at": F.when(fresh, F.col("repaired_at"))})
    visit = (F.col("faults_since_repair") == 0) & (F.col("repaired_at") >= F.col("at") - hours(24))
    return q.select("id", "open_order", F.col("order_id").isNotNull().alias("has_open_order"), "repair_number", "repaired_at",
                    "faults_since_repair", F.when(visit, F.col("repair_number")).alias("recent_visit"))


def type_precision(metrics: DataFrame, version: Column) -> DataFrame:
    m = metrics.filter((F.col("scope") == "sensor_type") & (F.col("model_version") == version) & F.col("precision").isNotNull())
    return m.groupBy(F.col("key").alias("sensor_type")).agg(F.max("precision").alias("type_precision"))


def signals(preds: DataFrame, faults: DataFrame, events: DataFrame, orders: DataFrame, channels: DataFrame, metrics: DataFrame,
            version: Column, spec: JournalSpec, rules: RuleSet, bounds: RiskBounds | None = None,
            keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build(),
            lost: DataFrame | None = None, totals: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Predictions with everything the rules ask about.

    ``keep(name, build)`` writes a part and reads it back: the plan of all parts in one fills a small driver, whatever the tables hold.
    ``lost``, ``totals``, ``done``: written ``last_losses``, ``fault_totals`` and ``repairs`` of the same tables, which the parts read several times.
    """
    p = with_channel(preds, by_shuffle(channels))
    counts = keep("signals_faults", lambda: fault_counts(preds, faults, spec))
    power = keep("signals_power", lambda: new_power_off(preds, events, channels, spec, rules))
    silent = keep("signals_silent", lambda: silent_neighbours(preds, faults, channels, spec, bounds, keep, lost))
    state = keep("signals_orders", lambda: order_state(preds, orders, faults, rules, keep, totals, done))
    precise = keep("signals_precision", lambda: type_precision(metrics, version))
    return (
        p.join(by_shuffle(counts), ["channel_id", "at"], "left").join(by_shuffle(power), ["channel_id", "at"], "left")
        .join(by_shuffle(silent), "id", "left").join(by_shuffle(state), "id", "left")
        .join(precise, "sensor_type", "left").join(type_groups(channels, rules), "sensor_type", "left")
    )


# ---- fault kind ------------------------------------------------------------------------------------------------------


def _short(feature: Column) -> Column:
    return _any([feature.endswith(s) for s in FLAP_SUFFIXES])


def factor_value(name: str) -> Column:
    return F.get(F.filter("top_factors", lambda f: f["feature"] == name), F.lit(0))["value"]


def flapping(rules: RuleSet) -> Column:
    """Status changes of a short window reach the limit and three norms."""
    limit = rules.params["flap_changes"]
    return F.coalesce(F.exists("top_factors", lambda f: f["feature"].startswith("status_changes_") & _short(f["feature"])
                               & (f["value"] >= limit) & (f["value"] >= 3 * F.greatest(F.coalesce(f["norm"], F.lit(0.0)), F.lit(1.0)))),
                      F.lit(False))


def stuck_share() -> Column:
    """Share of repeated readings among the factors; percentages become shares."""
    v = F.get(F.filter("top_factors", lambda f: f["feature"].startswith("stuck_share_") & f["value"].isNotNull()), F.lit(0))["value"]
    return F.when(v > 1, v / 100).otherwise(v)


def mass_link(rules: RuleSet) -> Column:
    others = F.greatest(F.col("object_channels") - 1, F.lit(1))
    return (F.col("neighbors_silent") >= rules.params["mass_link_neighbors"]) & (
        F.col("neighbors_silent") / others >= rules.params["mass_link_share"])


def infer_kind(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``fault_kind``: group silence, then the model's kinds, then factors and data, then the history."""
    df = settle(df, {
        "_factors": F.transform("top_factors", lambda f: F.struct(
            f["feature"].alias("feature"), F.coalesce(f["value"], F.lit(0.0)).alias("v"),
            (f["value"].isNull() | (f["value"] != 0)).alias("live"), feature_group(f["feature"]).alias("grp"))),
        "_model": likely_kind(F.col("kind_probs"), MODEL_KINDS)["code"],
        "_nb_share": factor_value("nb_silent_share"), "_stuck": stuck_share(), "_flapping": flapping(rules),
    })
    share = rules.params["group_silence_share"]
    others = F.col("same_type_channels") - 1
    grouped = F.coalesce(F.col("_nb_share") >= share, F.lit(False)) | F.coalesce(
        (others >= 5) & (F.try_divide(F.col("same_type_silent"), others) >= share), F.lit(False))
    present = lambda *names: F.exists("_factors", lambda f: f["live"] & f["grp"].isin(*names))
    positive = lambda *names: F.exists("_factors", lambda f: (f["v"] > 0) & f["grp"].isin(*names))
    fresh_msgs = F.exists("_factors", lambda f: (f["v"] > 0) & f["grp"].isin("fault_msgs", "disc_msgs") & _short(f["feature"]))
    power = positive("power_off", "off_share", "phase_off") | (F.array_contains("sensor_groups", "power") & (F.col("power_off_24h") > 0))
    drift = present("values", "neighbors") | (present("stuck") & F.coalesce(F.col("_stuck") != 0, F.lit(False)))
    top = F.greatest("f_link_90d", "f_fault_90d", "f_disc_90d", "f_value_90d")
    history = (F.when(F.col("f_fault_90d") == top, "fault").when(F.col("f_disc_90d") == top, "fault")
               .when(F.col("f_link_90d") == top, "link").otherwise("value"))
    df = settle(df, {"_link": present("silence", "link_losses", "past_gaps"), "_power": power})
    kind = (
        F.when(grouped, "group").when(F.col("_model").isNotNull(), F.col("_model")).when(F.col("_power"), "power")
        .when(F.col("_link") & (F.col("object_power_off") > 0), "power").when((F.col("fault_msgs_24h") > 0) | fresh_msgs, "fault")
        .when(F.col("_link"), "link").when(F.col("_flapping"), "fault").when(drift, "drift")
        .when(F.col("faults_90d") > 0, history).otherwise("unknown")
    )
    return settle(df, {"fault_kind": kind}).drop("_factors", "_model", "_nb_share", "_link", "_power")


# ---- rules -----------------------------------------------------------------------------------------------------------


RISK_ORDER = ("normal", "attention", "risk", "critical")
# ---- fixed values: condition names of a rule, the column each looks at and how it compares ---------------------------
CONDITIONS = (
    ("faults_30d_min", "faults_30d", "at least"),
    ("faults_90d_min", "faults_90d", "at least"),
    ("faults_since_repair_min", "faults_since_repair", "at least"),
    ("flapping", "_flapping", "is"),
    ("group", "sensor_groups", "shares"),
    ("kind", "fault_kind", "one of"),
    ("low_precision_type", "_imprecise", "is"),
    ("mass_link", "_mass", "is"),
    ("max_risk", "_risk", "at most level"),
    ("min_risk", "_risk", "at least level"),
    ("not_group", "sensor_groups", "shares none"),
    ("object_power_off_min", "object_power_off", "at least"),
    ("same_kind_90d_min", "_same", "at least"),
    ("stuck_share_min", "_stuck", "at least"),
)
# ------------------------------------------------------------------------------------------------------------------------


def _holds(column: str, how: str, wanted) -> Column:
    """One comparison; a NULL in the column makes it false."""
    c = F.col(column)
    if how.endswith("level"):
        how, wanted = how.removesuffix(" level"), RISK_ORDER.index(wanted)
    if how in ("shares", "shares none"):
        common = F.arrays_overlap(c, F.array(*[F.lit(n) for n in wanted]))
        return F.coalesce(common if how == "shares" else ~common, F.lit(False))
    if how == "one of":
        return F.coalesce(c.isin(*wanted), F.lit(False))
    low, high = {"at least": (wanted, None), "at most": (None, wanted), "is": (bool(wanted), bool(wanted))}[how]
    return F.coalesce((F.lit(True) if low is None else c >= F.lit(low)) & (F.lit(True) if high is None else c <= F.lit(high)), F.lit(False))


def condition(when: dict) -> Column:
    """All conditions of a rule as one predicate over the settled columns."""
    known = {name: (column, how) for name, column, how in CONDITIONS}
    return reduce(Column.__and__, [_holds(*known[name], wanted) for name, wanted in when.items()], F.lit(True))


def select_rule(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``rule_id`` of the first matching rule; the order of the rules is the order of the chain."""
    kind = F.col("fault_kind")
    same = (F.when(kind == "link", F.col("f_link_90d")).when(kind.isin("fault", "disconnected"), F.col("f_fault_90d") + F.col("f_disc_90d"))
            .when(kind == "value", F.col("f_value_90d")).otherwise(0))
    df = settle(df, {"_same": same, "_mass": F.coalesce(mass_link(rules), F.lit(False)),
                     "_imprecise": F.coalesce(F.col("type_precision") < rules.params["low_precision"], F.lit(False)), "_risk": level_rank(F.col("risk_level"))})
    first, *rest = rules.rules
    chain = reduce(lambda c, r: c.when(condition(r.when), r.id), rest, F.when(condition(first.when), first.id))
    return settle(df, {"rule_id": chain})


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """Rules as rows: a table as long as the configuration."""
    at = lambda p: PRIORITIES.index(p) if p in PRIORITIES else None
    rows = [(r.id, r.action, r.conclusion, at(r.priority), r.priority == "raise", at(r.priority_min) or 0,
             None if r.due_hours is None else float(r.due_hours), r.due_limit, r.plan, r.work_order, r.per_object) for r in rules.rules]
    return spark.createDataFrame(rows, "rule_id string, action string, conclusion string, _fixed int, _raise boolean, _lowest int, "
                                       "_due double, _limit string, plan boolean, work_order boolean, per_object boolean")


def priority_and_due(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``priority``, ``due_hours`` (capped by the regulation), ``due_at`` and the rule's flags."""
    j = df.join(F.broadcast(rule_table(df.sparkSession, rules)), "rule_id")  # as many rows as there are rules
    own = F.coalesce("_fixed", F.when(F.col("_raise"), F.least(F.col("_risk") + 1, F.lit(3))).otherwise(F.col("_risk")))
    rank = F.greatest(own, "_lowest", F.when(F.col("work_order"), F.col("floor_rank")).otherwise(0))
    limit = F.lit(None).cast("double")
    for name, cases in rules.due_limits.items():
        hours_of = reduce(lambda c, wn: F.when(condition(wn[0]), float(rules.norms[wn[1]])).otherwise(c), reversed(cases),
                          F.lit(None).cast("double"))
        limit = F.when(F.col("_limit") == name, hours_of).otherwise(limit)
    j = settle(j, {"_rank": rank, "due_limit_hours": limit})
    by_rank = F.get(F.array(*[F.lit(float(rules.due_hours[p])) for p in PRIORITIES]), F.col("_rank"))
    j = settle(j, {"priority": F.get(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("_rank")),
                   "due_hours": F.least(F.coalesce("_due", by_rank), F.col("due_limit_hours"))})
    return j.withColumn("due_at", F.timestamp_seconds(F.unix_timestamp("at") + F.col("due_hours") * 3600)).drop(
        "_fixed", "_raise", "_lowest", "_due", "_limit", "_rank", "_same", "_mass", "_imprecise", "_risk", "_stuck", "_flapping")


# what a factor of a group says; its value and, where it is known, the norm of the sensor type follow
GROUP_TEXTS = {
    "silence": "пауза против личной нормы", "link_losses": "потери связи", "past_gaps": "прошлые паузы", "faults": "отказы", "fault_msgs": "сообщения о неисправности",
    "disc_msgs": "отключения", "status_changes": "смены статуса", "stuck": "доля повторов показания", "values": "отклонение показаний", "group_silence": "доля молчащих соседей",
    "value_failures": "сбои значения", "sentinel": "служебные коды", "date1970": "даты 1970 года", "date_current": "даты вместо показаний", "power_off": "обесточивания", "off_share": "доля «Обесточен»", "phase_off": "обесточенные фазы",
}


def factor_text(factor: Column, group: Column) -> Column:
    """One argument: the group's text (else the feature's name), the value and the norm."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_TEXTS.items() for x in kv]), group), factor["feature"])
    value = F.when(factor["value"].isNotNull(), F.concat(F.lit(" — "), short_number(F.round(factor["value"], 2))))
    norm = F.when(factor["value"].isNotNull() & factor["norm"].isNotNull(), F.concat(F.lit(" при норме "), short_number(F.round(factor["norm"], 2))))
    return F.concat(label, F.coalesce(value, F.lit("")), F.coalesce(norm, F.lit("")))


def with_told(df: DataFrame) -> DataFrame:
    """Adds ``_told``: group and text of every factor, each expression once. Spelt out where it is read, they fill the driver's memory with the plan."""
    df = settle(df, {"_grouped": F.transform("top_factors", lambda f: F.struct(feature_group(f["feature"]).alias("grp"), f.alias("f")))})
    return settle(df, {"_told": F.transform("_grouped", lambda t: F.struct(t["grp"].alias("grp"), factor_text(t["f"], t["grp"]).alias("text")))}).drop("_grouped")


def said_by(*groups: str) -> Column:
    """Text of the first factor of these groups, NULL without one; reads ``_told`` of ``with_told``."""
    return F.get(F.filter("_told", lambda t: t["grp"].isin(*groups)), F.lit(0))["text"]


def due_text(hours_: Column) -> Column:
    """Below two days in hours, then in days."""
    return F.when(hours_ < 48, F.format_string("%d ч", F.bround(hours_).cast("int"))).otherwise(F.format_string("%d сут", F.bround(hours_ / 24).cast("int")))


def advice_against(rules: RuleSet) -> Column:
    """What not to do: the rule's own advice, then that of the circumstances."""
    own = F.lit(None).cast("string")
    for r in rules.rules:
        own = F.when((F.col("rule_id") == r.id) & F.lit(bool(r.avoid)), F.lit(r.avoid)).otherwise(own)
    m = rules.modifiers
    named = lambda key, number: F.concat(*[F.lit(x) if k == 0 else F.concat(number, F.lit(x)) for k, x in enumerate(re.split(r"\{\w*\}", m[key], maxsplit=1))])
    more = [F.when(F.col("open_order").isNotNull() & F.col("work_order"), named("open_order", F.col("open_order"))) if "open_order" in m else None,
            F.when((F.col("rule_id") == "mass_link_loss") & F.array_contains("sensor_groups", "gas"), F.lit(m["gas_planned_works"])) if "gas_planned_works" in m else None,
            F.when(F.col("recent_visit").isNotNull(), named("recent_visit", F.col("recent_visit"))) if "recent_visit" in m else None]
    return F.array_compact(F.array(own, *[c for c in more if c is not None]))


def advice_text(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``facts`` (texts in the order the rule lists them), ``reason``, ``avoid`` and the basis of a deadline that the regulation sets."""
    df = with_told(df)
    others = F.col("object_channels") - 1
    text = {
        "current": F.format_string("вероятность отказа в ближайшие 24 ч — %d %%", F.bround(F.col("prob") * 100).cast("int")),
        "neighbors": F.when(F.col("neighbors_silent") > 0, F.format_string("молчат %d из %d других датчиков объекта", "neighbors_silent", others))
        .when(others > 0, F.format_string("у остальных %d датчиков объекта признаков потери связи нет", others)),
        "power": F.when(F.col("object_power_off") > 0, F.format_string("«Обесточен» впервые за неделю у %d датчиков фаз объекта", "object_power_off"))
        .when(F.col("power_off_24h") > 0, F.format_string("«Обесточен» впервые за неделю, сообщений за сутки: %d", "power_off_24h")),
        "fault_msgs": F.when(F.col("fault_msgs_24h") > 0, F.format_string("сообщений о неисправности за сутки: %d", "fault_msgs_24h")),
        "repeats": F.when(F.col("faults_90d") > 0, F.format_string("отказов за 30 дней — %d, за 90 дней — %d", "faults_30d", "faults_90d"))
        .otherwise("за 90 дней отказов не было"),
        "repair": F.when(F.col("repair_number").isNotNull(), F.format_string(
            "по заявке %s работы выполнены %s, после этого отказов — %d", "repair_number", F.date_format("repaired_at", "dd.MM.yyyy"), "faults_since_repair")),
        "precision": F.when(F.col("type_precision").isNotNull(), F.format_string("точность модели для типа — %.2f", "type_precision")),
        "group_silence": F.when(factor_value("nb_silent_share").isNotNull(), F.format_string(
            "молчат %.0f %% однотипных датчиков объекта", factor_value("nb_silent_share") * 100)),
        "silence": F.coalesce(said_by("silence"), said_by("link_losses", "past_gaps")),
        "flap": F.when(flapping(rules), F.coalesce(said_by("status_changes"), F.lit("дребезг статуса"))),
        "stuck": said_by("stuck"),
        "values": said_by("values", "neighbors"),
        "value_fail": F.coalesce(said_by("value_failures", "sentinel", "date1970", "date_current"), F.when(F.col("fault_kind") == "value", "ожидается служебный код или дата вместо показания")),
    }
    text["power"] = F.coalesce(text["power"], said_by("power_off", "off_share", "phase_off"))
    text["fault_msgs"] = F.coalesce(text["fault_msgs"], said_by("fault_msgs", "disc_msgs"))
    df = settle(df, {"_text": F.map_from_arrays(F.array(*[F.lit(k) for k in text]), F.array(*text.values()))})
    wanted = df.sparkSession.createDataFrame([(r.id, list(r.facts)) for r in rules.rules], "rule_id string, _facts array<string>")
    df = df.join(F.broadcast(wanted), "rule_id")  # as many rows as there are rules
    facts = F.array_compact(F.transform("_facts", lambda f: F.try_element_at("_text", f)))
    df = settle(df, {"facts": facts}).drop("_text", "_told", "_facts")
    body = F.array_join("facts", "; ")
    df = df.withColumns({"avoid": advice_against(rules), "due_basis": F.when(F.col("due_limit_hours").isNotNull(), F.concat(
        F.lit("по регламенту — не более "), due_text(F.col("due_limit_hours"))))})
    return df.withColumn("reason", F.concat_ws(
        " → ", F.nullif(F.concat(F.upper(F.substring(body, 1, 1)), F.expr("substring(array_join(facts, '; '), 2)")), F.lit("")),
        F.nullif(F.col("conclusion"), F.lit(""))))


def advise(sig: DataFrame, rules: RuleSet) -> DataFrame:
    return priority_and_due(select_rule(infer_kind(sig, rules), rules), rules)


# ---- plan and orders -------------------------------------------------------------------------------------------------


def repeat_channels(faults: DataFrame, at: Column, minimum: int = 2) -> DataFrame:
    """Channels with repeated faults in the month up to the moment."""
    f = faults.filter((F.col("ts") > at - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= at))
    return f.groupBy(F.col("ch").alias("channel_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)


def repeat_channels_daily(daily: DataFrame, at: Column, minimum: int = 2) -> DataFrame:
    """The same from day counts, for journals without labelled faults."""
    d = daily.filter((F.col("fault_count") > 0) & (F.col("day") > F.to_date(at - F.expr("INTERVAL 30 DAYS"))) & (F.col("day") < F.to_date(at)))
    return d.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)


def plan_candidates(snap: DataFrame, repeats: DataFrame, bounds: RiskBounds | None = None) -> DataFrame:
    """Predictions of a snapshot that are at least "attention" or belong to channels with repeated faults."""
    p = snap.join(repeats.select("channel_id", F.lit(True).alias("_rep")), "channel_id", "left")
    return p.filter(has_level(["attention", "risk", "critical"], bounds) | F.coalesce("_rep", F.lit(False))).drop("_rep")


def maintenance_plan(advised: DataFrame, objects: DataFrame) -> DataFrame:
    """Planned works without an open order; every row knows its object's top priority and size, ``plan_order`` sorts them."""
    items = advised.filter(F.col("plan") & F.col("work_order") & ~F.coalesce("has_open_order", F.lit(False)))
    items = items.withColumn("_rank", F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")))
    per = items.groupBy("object_id").agg(F.max("_rank").alias("top_rank"), F.count(F.lit(1)).alias("object_items"))
    names = objects.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    return items.join(per, "object_id").join(names, "object_id", "left")


def plan_order(plan: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return page(plan, [F.desc("top_rank"), F.desc("object_items"), F.col("object_name"), F.col("object_id"), F.desc("_rank"),
                       F.desc("prob"), F.col("id")], limit, offset)


def draft_orders(advised: DataFrame) -> DataFrame:
    """What happens to each prediction of one snapshot: ``created``, ``included`` in the object's order, or skipped.

    The first prediction of an (object, rule) is found by an aggregate, so a large object is not gathered.
    """
    able = F.col("work_order") & ~F.coalesce("has_open_order", F.lit(False))
    lead = advised.filter(able & F.col("per_object")).groupBy("object_id", "rule_id").agg(
        F.max(F.struct("prob", (-F.col("id")).alias("neg"))).alias("_lead")).select(
        "object_id", "rule_id", (-F.col("_lead.neg")).alias("lead_id"))
    j = advised.join(lead, ["object_id", "rule_id"], "left")
    result = (F.when(~F.col("work_order"), "no order needed").when(F.coalesce("has_open_order", F.lit(False)), "order already open")
              .when(F.col("per_object") & (F.col("id") != F.col("lead_id")), "included").otherwise("created"))
    return j.select("id", "channel_id", "object_id", "rule_id", "priority", "due_hours", result.alias("result"),
                    F.when(result == "included", F.col("lead_id")).alias("lead_id"))


def merge_factors(preds: DataFrame, k: int = 3) -> DataFrame:
    """Factors of one group become one argument, told by their best factor; the first ``k`` arguments with different texts, in order of their best factor."""
    f = preds.select("id", F.posexplode("top_factors").alias("pos", "f")).select(
        "id", "pos", "f", F.col("f.feature").alias("feature"), feature_group(F.col("f.feature")).alias("grp"))
    g = f.groupBy("id", "grp").agg(F.min(F.struct("pos", "f")).alias("best"), F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("features"))
    g = g.withColumns({"pos": F.col("best.pos"), "text": factor_text(F.col("best.f"), F.col("grp"))}).drop("best")
    again = Window.partitionBy("id", "text").orderBy("pos")
    g = g.withColumn("_again", F.row_number().over(again)).filter("_again = 1").drop("_again")
    w = Window.partitionBy("id").orderBy("pos")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pos")


def check_transitions(log: DataFrame) -> DataFrame:
    """Status changes of orders that are not allowed: ``log(order_id, seq, status)``."""
    w = Window.partitionBy("order_id").orderBy("seq")
    pair = log.withColumn("was", F.lag("status").over(w)).filter(F.col("was").isNotNull() & (F.col("was") != F.col("status")))
    allowed = _any([(F.col("was") == a) & (F.col("status") == b) for a, b in TRANSITIONS])
    return pair.filter(~allowed)


def sync_dictionary(rules: RuleSet, dictionary: DataFrame) -> DataFrame:
    """Actions that bring ``dictionary(code, text, is_active)`` in line with the rules: add, update, deactivate."""
    rows = [(f"rule:{r.id}", r.action, r.work_order) for r in rules.rules]
    want = dictionary.sparkSession.createDataFrame(rows, "code string, new_text string, new_active boolean")
    j = want.join(dictionary.filter(F.col("code").startswith("rule:")), "code", "full_outer")
    action = (F.when(F.col("text").isNull() & F.col("new_text").isNotNull(), "add")
              .when(F.col("new_text").isNull() & F.col("is_active"), "deactivate")
              .when((F.col("text") != F.col("new_text")) | (F.col("is_active") != F.col("new_active")), "update"))
    return j.withColumn("action", action).filter(F.col("action").isNotNull()).select("code", "action")
