"""Joins of moments and intervals with a calendar of windows (journal outages, planned works).

Windows are spread over the calendar days they touch, so every lookup is an equi-join on the day. The calendar has one
row per day between two literal dates: its size is fixed by the dates, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.operators.asof import Lookup, asof_many


def seconds_between(a: Column, b: Column) -> Column:
    """Whole and fractional seconds from ``a`` to ``b``."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1_000_000)


def days_touched(windows: DataFrame, start: str = "start", end: str = "end", day: str = "day") -> DataFrame:
    """One row per window and calendar day it touches; ``end`` is exclusive."""
    last = F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    return windows.filter(F.col(start) < F.col(end)).withColumn(
        day, F.explode(F.sequence(F.to_date(F.col(start)), last)))


def window_clock(windows: DataFrame, day_from: str, day_to: str) -> DataFrame:
    """Calendar ``(day, before_s, wins)``: window seconds before the day and the windows of the day.

    ``windows(start, end)`` must not overlap each other.
    """
    midnight = F.col("day").cast("timestamp")
    touched = days_touched(windows.select("start", "end")).groupBy("day").agg(
        F.sum(seconds_between(F.greatest("start", midnight), F.least("end", midnight + F.expr("INTERVAL 1 DAY")))).alias("s"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("wins"),
    )
    spark = windows.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(day_from)), F.to_date(F.lit(day_to)))).alias("day"))
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return (
        days.join(touched, "day", "left")
        .select("day", F.coalesce(F.sum("s").over(past), F.lit(0.0)).alias("before_s"),
                F.coalesce("wins", F.array().cast("array<struct<start:timestamp,end:timestamp>>")).alias("wins"))
    )


def _lookup(df: DataFrame, clock: DataFrame, moment: Column, tag: str) -> DataFrame:
    """Attach ``window seconds before moment`` and the end of the window that covers the moment (else the moment)."""
    c = F.broadcast(clock.select(  # one row per calendar day
        F.col("day").alias(f"_day_{tag}"), F.col("before_s").alias("_before"), F.col("wins").alias("_wins")))
    last = F.broadcast(clock.agg(F.max("day").alias("_last")))  # a moment after the calendar reads its last day
    df = df.withColumn(f"_m_{tag}", moment).crossJoin(last)
    df = df.withColumn("_d", F.when(F.col(f"_m_{tag}").isNotNull(), F.least(F.to_date(f"_m_{tag}"), F.col("_last")))).drop("_last")
    df = df.join(c, F.col("_d") == F.col(f"_day_{tag}"), "left")
    midnight = F.col("_d").cast("timestamp")
    inside = F.aggregate(
        "_wins", F.lit(0.0),
        lambda acc, w: acc + F.greatest(
            seconds_between(F.greatest(w["start"], midnight), F.least(w["end"], F.col(f"_m_{tag}"))), F.lit(0.0)))
    cover = F.filter("_wins", lambda w: (w["start"] < F.col(f"_m_{tag}")) & (w["end"] > F.col(f"_m_{tag}")))
    return df.withColumns({
        f"_clock_{tag}": F.coalesce(F.col("_before") + inside, F.lit(0.0)),
        f"_cover_{tag}": F.coalesce(F.get(cover, F.lit(0))["end"], F.col(f"_m_{tag}")),
    }).drop("_before", "_wins", "_d", f"_day_{tag}")


def overlap_seconds(df: DataFrame, clock: DataFrame, start: Column, end: Column, out: str) -> DataFrame:
    """Seconds of ``[start, end)`` covered by the windows of the clock, as a difference of two clock readings."""
    cols = df.columns
    df = _lookup(_lookup(df, clock, start, "a"), clock, end, "b")
    return df.select(*cols, (F.col("_clock_b") - F.col("_clock_a")).cast("long").alias(out))


def overlap_up_to(df: DataFrame, clock: DataFrame, start: Column, pivot: Column, end: Column, out: str) -> DataFrame:
    """Like ``overlap_seconds`` but only for windows that begin before ``pivot``; such a window counts to its end."""
    cols = df.columns
    df = _lookup(df, clock, pivot, "p").withColumn("_stop", F.least(F.col("_cover_p"), end))
    df = _lookup(_lookup(df, clock, start, "a"), clock, F.col("_stop"), "b")
    return df.select(*cols, (F.col("_clock_b") - F.col("_clock_a")).cast("long").alias(out))


def flag_in_window(df: DataFrame, clock: DataFrame, ts: str, out: str) -> DataFrame:
    """Point in interval: ``start <= ts < end`` for some window."""
    c = F.broadcast(clock.select(F.col("day").alias("_cal_day"), F.col("wins").alias("_wins")))  # one row per calendar day
    hit = F.exists("_wins", lambda w: (w["start"] <= F.col(ts)) & (w["end"] > F.col(ts)))
    return df.join(c, F.to_date(ts) == F.col("_cal_day"), "left").select(*df.columns, F.coalesce(hit, F.lit(False)).alias(out))


def flag_near_window(df: DataFrame, clock: DataFrame, ts: str, before_h: int, after_h: int, out: str) -> DataFrame:
    """``out`` is true when a window meets ``(ts - before_h, ts + after_h)``: its seconds in the span are above zero."""
    lo = F.col(ts) - F.expr(f"make_dt_interval(0, {before_h})")
    hi = F.col(ts) + F.expr(f"make_dt_interval(0, {after_h})")
    return overlap_seconds(df, clock, lo, hi, "_near").withColumn(out, F.col("_near") > 0).drop("_near")


def match_overlaps(spans: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of date spans that overlap: ``spans(first_day, last_day)`` x ``calendar(cal_from, cal_to)``, both inclusive.

    Both sides meet on a day: a pair is kept only at its first common day, so it appears once.
    """
    s = spans.withColumn("_day", F.explode(F.sequence("first_day", "last_day")))
    c = calendar.withColumn("_day", F.explode(F.sequence("cal_from", "cal_to")))
    return s.join(c, [*keys, "_day"]).filter(
        F.col("_day") == F.greatest("first_day", "cal_from")).drop("_day")


def newest_open_at(probes: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, order: Sequence[str], payload: Sequence[str],
                   levels: int = 21) -> DataFrame:
    """For every distinct ``(key, at)`` the payload of the span of the key with the greatest ``(start, order)`` that contains the whole hour ``at``.

    ``end`` is exclusive; NULL leaves a span open. One as-of pass finds the newest span that began before the probe, and the newest of those that never end. Where the former has
    ended by then, an older one may still be open: hours form a binary tree of ``levels`` levels, a span that ends is kept at the few nodes that cover its hours exactly (at most
    two a level), the greatest span of a node survives an aggregate, and such a probe asks the nodes above its hour, no higher than the longest of these spans reaches. All of it
    is equi-joins on the key and a node: spans of one key meet neither each other nor the probes one by one.
    """
    keys = list(keys)
    hour = lambda c: F.floor((F.unix_micros(c) + 3_599_999_999) / 3_600_000_000).cast("long")
    far = (1 << levels - 1) - 1
    # up the levels: an odd left end and an even right end are nodes of the cover, what is left between them goes on one level up
    left, right = "s.l + s.l % 2", "s.r - if(s.l + s.l % 2 <= s.r and s.r % 2 = 0, 1, 0)"
    goes_on = f"s.l <= s.r and {left} <= {right}"
    cover = f"""aggregate(sequence(0, {levels - 1}), named_struct('l', _lo, 'r', _hi, 'out', cast(array() as array<struct<level: int, node: bigint>>)), (s, k) -> named_struct(
        'l', if({goes_on}, ({left}) div 2, 1L), 'r', if({goes_on}, ({right}) div 2, 0L),
        'out', concat(s.out, if(s.l <= s.r and s.l % 2 = 1, array(named_struct('level', k, 'node', s.l)), array()),
                      if(s.l <= s.r and s.l + s.l % 2 <= s.r and s.r % 2 = 0, array(named_struct('level', k, 'node', s.r)), array()))), s -> s.out)"""
    value = F.struct(F.col(start).alias("_start"), *[F.col(c).alias(f"_{c}") for c in order], F.struct(*[F.col(c) for c in payload]).alias("_payload"))
    held = spans.dropna(subset=[*keys, start]).withColumns({
        "_lo": F.greatest(hour(F.col(start)), F.lit(0)).cast("long"), "_hi": F.coalesce(F.least(hour(F.col(end)) - 1, F.lit(far)), F.lit(far)).cast("long")})
    held = held.filter("_lo <= _hi").select(*keys, "_lo", "_hi", value.alias("_value"))
    ending = held.filter(F.col("_hi") < far)
    best = ending.select(*keys, "_value", F.inline(F.expr(cover))).groupBy(*keys, "level", "node").agg(F.max("_value").alias("_value"))
    first_hour = F.timestamp_seconds(F.col("_lo") * 3600)
    newest = held.select(*keys, first_hour.alias("_newest_from"), F.col("_value").alias("_newest"), F.col("_hi").alias("_newest_hi"))
    lasting = held.filter(F.col("_hi") == far).select(*keys, first_hour.alias("_lasting_from"), F.col("_value").alias("_lasting"))
    asks = probes.select(*keys, at).dropna().withColumn("_hour", (F.unix_timestamp(at) / 3600).cast("long")).filter(F.col("_hour").between(0, far))
    met = asof_many(asks.withColumn("_whole", F.timestamp_seconds(F.col("_hour") * 3600)), keys, "_whole", [
        Lookup(newest, "_newest_from", ["_newest", "_newest_hi"]), Lookup(lasting, "_lasting_from", ["_lasting"])])
    # a node of a span's cover holds no more hours than the span
    top = F.floor(F.log2(ending.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).scalar())).cast("int")
    above = F.transform(F.sequence(F.lit(0), F.col("_top")), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("_hour"), k).alias("node")))
    itself = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node")))
    known = F.when(F.col("_newest_hi") >= F.col("_hour"), F.col("_newest")).otherwise(F.col("_lasting"))
    asked = met.filter(F.col("_newest_hi").isNotNull()).withColumn("_top", top).select(
        *keys, at, known.alias("_known"), F.inline(F.when(F.col("_newest_hi") < F.col("_hour"), F.concat(itself, F.coalesce(above, F.array()))).otherwise(itself)))
    # a probe becomes a row a level, which Spark's size estimate of an exploded side leaves out: neither side may be broadcast by it
    found = asked.withColumn("_known", F.when(F.col("level") == -1, F.col("_known"))).join(best.hint("merge"), [*keys, "level", "node"], "left")
    found = found.groupBy(*keys, at).agg(F.max(F.coalesce("_known", "_value")).alias("_value")).filter(F.col("_value").isNotNull())
    return found.select(*keys, at, "_value._payload.*")
