"""Risk levels, rounding, weights and calibration as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lullwatch.spec import RiskBounds

LEVELS = ("normal", "attention", "risk", "critical")
ALERT_LEVELS = ("risk", "critical")


def health(prob: Column) -> Column:
    """Health index: 100 * (1 - p), half to even."""
    return F.bround(100 * (1 - prob)).cast("int")


def round_prob(prob: Column) -> Column:
    return F.bround(prob, 4)


def risk_level(health_index: Column) -> Column:
    return (F.when(health_index >= 80, "normal").when(health_index >= 50, "attention")
            .when(health_index >= 20, "risk").otherwise("critical"))


def risk_level_from_prob(prob: Column, bounds: RiskBounds) -> Column:
    return (F.when(prob.isNull(), None).when(prob >= bounds.critical, "critical").when(prob >= bounds.risk, "risk")
            .when(prob >= bounds.attention, "attention").otherwise("normal"))


def level_in(prob: Column, levels: Sequence[str], bounds: RiskBounds) -> Column:
    """The levels as ranges of the probability: a predicate that Parquet statistics can use."""
    ranges = {"normal": (None, bounds.attention), "attention": (bounds.attention, bounds.risk),
              "risk": (bounds.risk, bounds.critical), "critical": (bounds.critical, None)}
    out = F.lit(False)
    for level in levels:
        lo, hi = ranges[level]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (prob >= lo)
        if hi is not None:
            cond = cond & (prob < hi)
        out = out | cond
    return out


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def half_life_weight(age_days: Column, half_life: float = 365.0) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear value on sorted breakpoints, constant outside them."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        if x1 > x0:
            out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(x.isNotNull(), F.lit(float(ys[-1]))))


def likely_kind(kind_probs: Column, known: Sequence[str]) -> Column:
    """``struct(code, share)`` of the most probable known kind of a map; ties go to the smaller code."""
    entries = F.filter(F.map_entries(kind_probs), lambda e: e["key"].isin(*known) & e["value"].isNotNull())
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"])
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("code"))))
    best = F.get(ranked, F.lit(0))
    return F.when(best.isNotNull(), F.struct(
        best["code"].alias("code"), F.when(total > 0, F.bround(-100 * best["neg"] / total).cast("int")).alias("share")))
