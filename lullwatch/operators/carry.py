"""Ordered per-key programs that split long keys by time.

A key (a channel, an object, a sensor type) may own a large share of the journal, so no window here is partitioned by
the key alone over raw rows. Rows are partitioned by ``(key, time bucket)``; what a bucket must know about the past is
computed from one summary row per ``(key, bucket)`` and enters the bucket as a *carry row* that sorts first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
CARRY = "_carry"


def bucket_of(ts: Column | str, bucket: str) -> Column:
    return F.date_trunc(bucket, F.col(ts) if isinstance(ts, str) else ts)


SPLIT_ROWS = 5_000_000
"""Rows of a key and day above which the day is cut into hours."""


def hot_days(frames: Sequence[tuple[DataFrame, str]], keys: Sequence[str], split_rows: int) -> DataFrame:
    """``keys, _day`` of the days on which a key has more than ``split_rows`` rows in all frames ``(rows, ts)`` together.

    At most one row for every ``split_rows`` rows of the input, so it may be broadcast.
    """
    keys = list(keys)
    counts = [df.dropna(subset=[*keys, ts]).groupBy(*keys, F.date_trunc("day", ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n")) for df, ts in frames]
    return reduce(DataFrame.unionByName, counts).groupBy(*keys, "_day").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > split_rows).select(
        *keys, "_day", F.lit(True).alias("_hot"))


def with_bucket(df: DataFrame, ts: str, bucket: str, hot: DataFrame | None = None) -> DataFrame:
    """Adds the time bucket of every row: the day (or ``bucket``), an hour on the hot days of its key. Buckets of a key keep the order of time."""
    if hot is None:
        return df.withColumn(BUCKET, bucket_of(ts, bucket))
    keys = [c for c in hot.columns if c not in ("_day", "_hot")]
    j = df.withColumn("_day", F.date_trunc("day", ts)).join(F.broadcast(hot), [*keys, "_day"], "left")  # bounded by rows / split_rows
    return j.withColumn(BUCKET, F.when(F.col("_hot"), F.date_trunc("hour", ts)).otherwise(F.col("_day"))).drop("_day", "_hot").select(*df.columns, BUCKET)


def neighbour_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    earlier: dict[str, tuple[str, Column | None]] | None = None,
    later: dict[str, tuple[str, Column | None]] | None = None,
    bucket: str = "day",
    keep_bucket: bool = False,
    split_rows: int | None = None,
) -> DataFrame:
    """Add the nearest earlier and later values per key: ``earlier[name] = (column, condition or None)``.

    ``order[0]`` is the timestamp; the other columns break ties. With a condition only rows that satisfy it count, so
    "previous status text" and "previous reading" come out of one pass. ``keep_bucket`` leaves the time bucket in the
    result: an aggregation by the key, the bucket and anything else then needs no shuffle of its own. With ``split_rows`` days are counted first, and a day
    on which a key has more rows is cut into hours.
    """
    keys, order, earlier, later = list(keys), list(order), earlier or {}, later or {}
    wanted = {**earlier, **later}
    src = {n: f"_src_{n}" for n in wanted}
    hot = None if split_rows is None else hot_days([(df, order[0])], keys, split_rows)
    base = with_bucket(df, order[0], bucket, hot).withColumns({
        src[n]: (F.col(v) if c is None else F.when(c, F.col(v))) for n, (v, c) in wanted.items()})

    def edge(n: str) -> Column:
        pick = F.max if n in earlier else F.min
        if wanted[n] == (order[0], None):  # the moment itself needs no companion: a plain hash aggregate
            return F.struct(pick(src[n]).alias("v"))
        return pick(F.when(F.col(src[n]).isNotNull(), F.struct(*[F.col(c) for c in order], F.col(src[n]).alias("v"))))

    summary = base.groupBy(*keys, BUCKET).agg(*[edge(n).alias(src[n]) for n in wanted])
    # a later value is the first of the buckets after: both directions look back along their own order
    past = Window.partitionBy(*keys).orderBy(F.col(BUCKET).asc()).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, BUCKET, *[
        F.last(F.col(f"{src[n]}.v"), ignorenulls=True).over(past if n in earlier else future).alias(src[n]) for n in wanted])
    rows = base.withColumn(CARRY, F.lit(1))
    for names, pos in ((earlier, 0), (later, 2)):
        if names:
            rows = rows.unionByName(carry.select(*keys, BUCKET, F.lit(pos).alias(CARRY), *[src[n] for n in names]), allowMissingColumns=True)
    up = Window.partitionBy(*keys, BUCKET).orderBy(F.col(CARRY).asc(), *[F.col(c).asc() for c in order])
    down = Window.partitionBy(*keys, BUCKET).orderBy(F.col(CARRY).desc(), *[F.col(c).desc() for c in order])
    found = rows.select("*", *[
        F.last(src[n], ignorenulls=True).over((up if n in earlier else down).rowsBetween(Window.unboundedPreceding, -1)).alias(n)
        for n in wanted])
    return found.filter(F.col(CARRY) == 1).select(*df.columns, *([BUCKET] if keep_bucket else []), *wanted)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    measures: dict[str, Column],
    bucket: str = "day",
) -> DataFrame:
    """One row per ``(key, ts)`` with inclusive cumulative sums; rows of one instant are peers (RANGE semantics)."""
    keys = list(keys)
    instants = df.groupBy(*keys, ts).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    instants = instants.withColumn(BUCKET, bucket_of(ts, bucket))
    return _accumulate(instants, keys, [F.col(ts)], list(measures)).filter(F.col(ts).isNotNull()).select(*keys, ts, *measures)


def _accumulate(rows: DataFrame, keys: list[str], order: list[Column], measures: list[str]) -> DataFrame:
    """Running sums over rows that carry BUCKET; carry rows (all other columns NULL) stay in the result."""
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    prefix = rows.groupBy(*keys, BUCKET).agg(*[F.sum(m).alias(m) for m in measures])
    prefix = prefix.select(*keys, BUCKET, F.lit(True).alias(CARRY), *[F.sum(m).over(across).alias(m) for m in measures])
    prefix = prefix.filter(F.coalesce(*[F.col(m).cast("double") for m in measures]).isNotNull())
    allrows = rows.withColumn(CARRY, F.lit(False)).unionByName(prefix, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(F.col(CARRY).desc(), *order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return allrows.withColumns({m: F.sum(m).over(inside) for m in measures})


def band_distinct_count(
    probes: DataFrame, marks: DataFrame, keys: Sequence[str], member: str, at: str, ts: str, tolerance_h: int, out: str,
) -> DataFrame:
    """Distinct ``member`` values of the key with a mark within ``±tolerance_h`` of each probe moment.

    Marks of one member closer than two tolerances merge into one interval (only its first and last mark matter), so a
    member is counted once at any moment and the count is the number of open intervals.
    """
    return _sweep(probes, _member_steps(marks, list(keys), member, ts, tolerance_h, tolerance_h, 2, out), list(keys), at, out)


def lasting_distinct_count(
    probes: DataFrame, marks: DataFrame, keys: Sequence[str], member: str, at: str, ts: str, lasting_h: int, out: str,
) -> DataFrame:
    """Distinct ``member`` values of the key with a mark in ``(at - lasting_h, at]`` of each probe moment."""
    return _sweep(probes, _member_steps(marks, list(keys), member, ts, 0, lasting_h, 0, out), list(keys), at, out)


def _member_steps(marks: DataFrame, keys: list[str], member: str, ts: str, before_h: int, after_h: int, end_side: int, out: str) -> DataFrame:
    """Starts and ends of the intervals that the marks of one member cover, as independent +1 / -1 steps of the sweep."""
    m = marks.select(*keys, member, ts).dropna().distinct()
    m = neighbour_by(m, [*keys, member], [ts], {"_prev": (ts, None)}, {"_next": (ts, None)})
    reach = F.expr(f"make_dt_interval(0, {before_h + after_h})")
    first = F.col("_prev").isNull() | (F.col("_prev") + reach < F.col(ts))
    last = F.col("_next").isNull() | (F.col(ts) + reach < F.col("_next"))
    step = lambda cond, t, side, d: F.when(cond, F.struct(t.alias("_t"), F.lit(side).alias("_side"), F.lit(d).alias(out)))
    start, end = F.col(ts) - F.expr(f"make_dt_interval(0, {before_h})"), F.col(ts) + F.expr(f"make_dt_interval(0, {after_h})")
    return m.select(*keys, F.inline(F.array_compact(F.array(step(first, start, 0, 1), step(last, end, end_side, -1)))))


def _sweep(probes: DataFrame, steps: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """+1 at every start, -1 after every end, running sum read at the probes: linear work, pairs are never formed."""
    asks = probes.select(*keys, F.col(at).alias("_t")).distinct().select(
        *keys, "_t", F.lit(1).alias("_side"), F.lit(0).alias(out))
    rows = steps.unionByName(asks).dropna(subset=keys).withColumn(BUCKET, bucket_of("_t", "day"))
    swept = _accumulate(rows, keys, [F.col("_t"), F.col("_side")], [out])
    return swept.filter((~F.col(CARRY)) & (F.col("_side") == 1)).select(*keys, F.col("_t").alias(at), out)
