"""As-of joins: for every left row the nearest right row of the same key, before or after a moment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lullwatch.operators.carry import BUCKET, hot_days, with_bucket


@dataclass(frozen=True)
class Lookup:
    """One right side. backward: ``ts <= left_ts`` (``strict``: <); forward: ``ts >= left_ts`` (``strict``: >).

    Among right rows of one instant the largest payload wins backward, the smallest forward.
    """

    right: DataFrame
    ts: str
    payload: Sequence[str] = ()
    direction: str = "backward"
    strict: bool = False

    @property
    def backward(self) -> bool:
        return self.direction == "backward"

    @property
    def columns(self) -> list[str]:
        return [self.ts, *self.payload]


def asof_many(left: DataFrame, on: Sequence[str], left_ts: str, lookups: Sequence[Lookup], bucket: str = "day",
              split_rows: int | None = None) -> DataFrame:
    """Left as-of join with several right sides; adds their ``ts`` and payload columns, NULL where nothing matches.

    All sides are unioned and shuffled once by ``(key, time bucket)``. What a bucket inherits from its neighbours is one
    row per ``(key, bucket)``, taken from an aggregate of the right sides, so a key of any size is split by time. With ``split_rows`` days are counted first,
    and a day on which a key has more rows on all sides together is cut into hours.
    """
    on = list(on)
    recs = [f"_rec{i}" for i in range(len(lookups))]
    pick = [F.max if k.backward else F.min for k in lookups]
    lhs = left.select(*on, F.col(left_ts).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    rights = [k.right.dropna(subset=[*on, k.ts]).select(*on, F.col(k.ts).alias("_t"), F.struct(*[F.col(c) for c in k.columns]).alias(rec)) for k, rec in zip(lookups, recs)]
    hot = None if split_rows is None else hot_days([(side, "_t") for side in (lhs, *rights)], on, split_rows)
    lhs = with_bucket(lhs, "_t", bucket, hot)
    asked = lhs.select(*on, BUCKET).distinct().withColumn("_asked", F.lit(True))
    rows, summary = lhs.withColumns({"_pos": F.lit(1), "_side": F.lit(1)}), asked
    for k, rec, r in zip(lookups, recs, rights):
        r = with_bucket(r, "_t", bucket, hot)
        # at the moment itself a matching right row must stand on the side the frame looks at
        side = 0 if k.backward != k.strict else 2
        rows = rows.unionByName(r.withColumns({"_pos": F.lit(1), "_side": F.lit(side)}), allowMissingColumns=True)
        per = r.groupBy(*on, BUCKET).agg((F.max if k.backward else F.min)(rec).alias(rec))
        summary = summary.unionByName(per, allowMissingColumns=True)
    summary = summary.groupBy(*on, BUCKET).agg(F.max("_asked").alias("_asked"), *[p(rec).alias(rec) for p, rec in zip(pick, recs)])
    past = Window.partitionBy(*on).orderBy(F.col(BUCKET).asc()).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*on).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*on, BUCKET, "_asked", *[
        F.last(rec, ignorenulls=True).over(past if k.backward else future).alias(rec) for k, rec in zip(lookups, recs)]).filter("_asked")
    for flag, pos in ((True, 0), (False, 2)):
        mine = [rec for k, rec in zip(lookups, recs) if k.backward == flag]
        if mine:
            rows = rows.unionByName(carry.select(*on, BUCKET, F.lit(pos).alias("_pos"), *mine), allowMissingColumns=True)
    up = [F.col(c).asc() for c in ("_pos", "_t", "_side", *recs)]
    down = [F.col(c).desc() for c in ("_pos", "_t", "_side", *recs)]
    seen = {True: Window.partitionBy(*on, BUCKET).orderBy(*up).rowsBetween(Window.unboundedPreceding, Window.currentRow),
            False: Window.partitionBy(*on, BUCKET).orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.currentRow)}
    found = rows.select("_left", *[F.last(rec, ignorenulls=True).over(seen[k.backward]).alias(rec) for k, rec in zip(lookups, recs)])
    taken = set(left.columns)
    out = [f"{rec}.{c}" for k, rec in zip(lookups, recs) for c in k.columns if c not in taken]
    return found.filter(F.col("_left").isNotNull()).select("_left.*", *out)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str] = (),
    direction: str = "backward",
    strict: bool = False,
    bucket: str = "day",
    split_rows: int | None = None,
) -> DataFrame:
    """``asof_many`` with one right side."""
    return asof_many(left, on, left_ts, [Lookup(right, right_ts, payload, direction, strict)], bucket, split_rows)
