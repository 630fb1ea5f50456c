"""Checks of model work: folds, weights, thresholds, metrics, factors, replacement, training."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from lullwatch.plans import features as X
from lullwatch.plans import model as M
from lullwatch.testbed.adapter import KIND_CODES
from lullwatch.testbed.checks_features import feature_stage
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

GROUPS = {"GAS_GUARD": "gas", "FIRE_GUARD": "fire", "SECURITY": "security"}
THR = 0.45
FOLDS = {"w2": ("2024-01-15", "2024-01-19"), "w3": ("2024-01-20", "2024-01-24")}


def _alert():
    return F.col("p") >= THR


@query("p00_predictions", sql("preds", """SELECT id, channel_id, epoch("at")::BIGINT AS at, round(prob, 4) AS prob, health, risk_level, happened,
  epoch(fault_at)::BIGINT AS fault_at, fault_kind, round(p_link, 6) AS p_link, round(p_value, 6) AS p_value FROM preds"""))
def _(b):
    return b.predictions().select("id", "channel_id", secs("at"), F.round("prob", 4).alias("prob"), "health", "risk_level", "happened",
                                  secs("fault_at"), "fault_kind", F.round("p_link", 6).alias("p_link"), F.round("p_value", 6).alias("p_value"))


@query("m01_time_folds", sql("scored", """SELECT fold, role, count(*) AS n, sum(y)::BIGINT AS pos FROM (
   SELECT s.y, f.fold, CASE WHEN t BETWEEN f.d0 AND f.d1 THEN 'valid' WHEN t BETWEEN TIMESTAMP '2024-01-08' AND f.d0 - INTERVAL 2 DAY THEN 'train' END AS role
   FROM scored s, (VALUES ('w2', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-19'), ('w3', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-24')) f(fold, d0, d1))
  WHERE role IS NOT NULL GROUP BY 1, 2"""))
def _(b):
    return M.time_folds(b.scored(), FOLDS, "2024-01-08").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


@query("m02_sample_negatives", sql("scored", """SELECT epoch(t)::BIGINT AS t, ch, y, CASE WHEN y = 1 THEN 1.0 ELSE 2.5 END::DOUBLE AS weight FROM scored
  WHERE y = 1 OR ('0x' || substr(md5('42|' || ch || '|' || epoch(t)::BIGINT), 1, 8))::BIGINT / 4294967296.0 < 0.4"""))
def _(b):
    s = b.scored().withColumn("slot", F.unix_timestamp("T"))
    return M.sample_negatives(s, 0.4, ["ch", "slot"]).select(F.col("slot").alias("t"), "ch", "y", "weight")


@query("m03_f15_training_weights", sql("scored", """SELECT epoch(t)::BIGINT AS t, ch, round(pow(0.5, floor((epoch(m) - epoch(t)) / 86400) / 365)
   * CASE WHEN y = 1 THEN sqrt(neg / pos) ELSE 1 END, 6) AS train_weight
  FROM scored, (SELECT max(t) AS m, count(*) FILTER (WHERE y = 0) AS neg, greatest(count(*) FILTER (WHERE y = 1), 1) AS pos FROM scored)"""))
def _(b):
    return M.training_weights(b.scored()).select(secs("T", "t"), "ch", F.round("train_weight", 6).alias("train_weight"))


@query("a09_feature_norms", sql("scored", """SELECT sensor_type, median(ev_7d)::DOUBLE AS ev_7d, median(chg_24h)::DOUBLE AS chg_24h, median(fault_30d)::DOUBLE AS fault_30d
  FROM scored GROUP BY 1"""))
def _(b):
    return M.feature_norms(b.scored(), ["ev_7d", "chg_24h", "fault_30d"])


@query("m09_baseline", sql("scored", """SELECT tp, fp, fn, n AS rows, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support
  FROM (SELECT count(*) FILTER (WHERE faults_7d > 0 AND y = 1) AS tp, count(*) FILTER (WHERE faults_7d > 0 AND y = 0) AS fp,
    count(*) FILTER (WHERE faults_7d = 0 AND y = 1) AS fn, count(*) AS n FROM scored)"""))
def _(b):
    r = lambda c: F.round(c, 6).alias(c)
    return M.baseline(b.scored()).select("tp", "fp", "fn", "rows", r("precision"), r("recall"), r("f1"), "support")


_POINTS = """SELECT {g} p AS threshold, sum(n) OVER w AS n, sum(tp) OVER w AS tp, tp AS here, sum(tp) OVER ({pg}) AS positives FROM (
   SELECT {g} p, count(*) AS n, sum(y) AS tp FROM scored GROUP BY {g} p) WINDOW w AS ({pg} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""
cte("pts", "scored", _POINTS.format(g="", pg=""))
cte("pts_t", "scored", _POINTS.format(g="sensor_type,", pg="PARTITION BY sensor_type"))


@query("m10_score_points", sql("pts", "SELECT threshold, n::BIGINT AS n, tp::BIGINT AS tp, round(tp / n, 6) AS precision, round(tp / positives, 6) AS recall FROM pts"))
def _(b):
    return M.score_points(b.scored()).select("threshold", "n", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m10_pick_threshold", sql("pts", """SELECT threshold, round(tp / n, 6) AS precision, round(tp / positives, 6) AS recall FROM pts
  WHERE tp / n >= 0.42 ORDER BY tp DESC, threshold LIMIT 1"""))
def _(b):
    return M.pick_threshold(b.scored(), 0.42).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m10_pick_grid_threshold", sql("scored", """SELECT g AS threshold, round(tp / n, 6) AS precision, round(tp / pos, 6) AS recall FROM (
   SELECT g, count(*) FILTER (WHERE p >= g) AS n, count(*) FILTER (WHERE p >= g AND y = 1) AS tp, sum(y) AS pos
   FROM scored, (SELECT round(unnest(range(1, 20)) * 0.05, 2)::DOUBLE AS g) GROUP BY g) WHERE tp / n >= 0.4 ORDER BY recall DESC, threshold LIMIT 1"""))
def _(b):
    return M.pick_grid_threshold(b.scored(), 0.4).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m11_group_thresholds", sql("pts_t pts", """SELECT sensor_type, coalesce(arg_min(threshold, threshold) FILTER (WHERE ok AND tp = best),
    (SELECT threshold FROM pts WHERE tp / n >= 0.42 ORDER BY tp DESC, threshold LIMIT 1)) AS threshold, bool_or(ok) AS reached
  FROM (SELECT *, tp / n >= 0.42 AS ok, max(tp) FILTER (WHERE tp / n >= 0.42) OVER (PARTITION BY sensor_type) AS best FROM pts_t) GROUP BY 1"""))
def _(b):
    return M.pick_group_thresholds(b.scored(), "sensor_type", 0.42)


@query("m12_average_precision", sql("pts", "SELECT round(sum(here / positives * tp / n), 6) AS pr_auc FROM pts"))
def _(b):
    return M.average_precision(b.scored()).select(F.round("pr_auc", 6).alias("pr_auc"))


@query("m12_average_precision_by_type", sql("pts_t", "SELECT sensor_type, round(sum(here / positives * tp / n), 6) AS pr_auc FROM pts_t GROUP BY 1"))
def _(b):
    return M.average_precision(b.scored(), by=["sensor_type"]).select("sensor_type", F.round("pr_auc", 6).alias("pr_auc"))


@query("m12_average_precision_labels", """SELECT lang, round(sum(here / positives * tp / n), 6) AS pr_auc FROM (
   SELECT lang, p, tp AS here, sum(n) OVER w AS n, sum(tp) OVER w AS tp, sum(tp) OVER (PARTITION BY lang) AS positives FROM (
     SELECT d.lang, d.n_chars / (d.n_chars + 5000.0)::DOUBLE AS p, count(*) AS n, sum(l.quality) AS tp FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2)
   WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1""")
def _(b):
    d = b.table("documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0))).alias("p"))
    s = d.join(b.table("labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return M.average_precision(s, by=["lang"]).select("lang", F.round("pr_auc", 6).alias("pr_auc"))


@query("m13_threshold_table", sql("scored", f"""SELECT g AS threshold, round(coalesce(tp / nullif(n, 0), 0), 6) AS precision, round(tp / pos, 6) AS recall, round(n / days, 6) AS alerts_per_day,
    round(tp / days, 6) AS tp_per_day, round((n - tp) / days, 6) AS fp_per_day, g = 0.33 AS is_selected FROM (
   SELECT g, count(*) FILTER (WHERE p >= g) AS n, count(*) FILTER (WHERE p >= g AND y = 1) AS tp, sum(y) AS pos, count(DISTINCT t::DATE) AS days
   FROM scored, (SELECT round(unnest(range(1, 20)) * 0.05, 2)::DOUBLE AS g UNION ALL SELECT 0.33) GROUP BY g)"""))
def _(b):
    t = M.threshold_table(b.scored(), 0.33)
    r = lambda c: F.round(c, 6).alias(c)
    return t.select("threshold", r("precision"), r("recall"), r("alerts_per_day"), r("tp_per_day"), r("fp_per_day"), "is_selected")


_CONF = f"""count(*) FILTER (WHERE p >= {THR} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {THR} AND y = 0) AS fp,
  count(*) FILTER (WHERE p < {THR} AND y = 1) AS fn, count(*) AS rows"""


@query("m14_overall_metrics", sql("scored", f"""SELECT rows, tp, fp, fn, tp + fn AS support, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round((tp + fp) / days, 1) AS alerts_per_day, round(fp / days, 1) AS fp_per_day, round(warned / (tp + fn), 4) AS episodes_warned_1_24h, round(med, 1) AS median_lead_h
  FROM (SELECT {_CONF}, count(DISTINCT t::DATE) AS days, count(*) FILTER (WHERE p >= {THR} AND y = 1 AND epoch(fault_at) - epoch(t) >= 3600) AS warned,
    median((epoch(fault_at) - epoch(t)) / 3600) FILTER (WHERE p >= {THR} AND y = 1) AS med FROM scored)"""))
def _(b):
    return M.overall_metrics(b.scored(), _alert())


@query("m14_a14_metrics_by_type", sql("scored pts_t", f"""SELECT c.sensor_type, tp, fp, fn, rows, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(pr_auc, 6) AS pr_auc FROM (SELECT sensor_type, {_CONF} FROM scored GROUP BY 1) c
  JOIN (SELECT sensor_type, sum(here / positives * tp / n) AS pr_auc FROM pts_t GROUP BY 1) a ON a.sensor_type = c.sensor_type"""))
def _(b):
    r = lambda c: F.round(c, 6).alias(c)
    return M.group_metrics(b.scored(), _alert(), "sensor_type").select(
        "sensor_type", "tp", "fp", "fn", "rows", "support", r("precision"), r("recall"), r("pr_auc"))


@query("m14_metrics_by_customer_group", sql("scored", f"""SELECT grp, tp, fp, fn, rows FROM (SELECT CASE system_type WHEN 'GAS_GUARD' THEN 'gas' WHEN 'FIRE_GUARD' THEN 'fire'
  WHEN 'SECURITY' THEN 'security' ELSE 'other' END AS grp, {_CONF} FROM scored GROUP BY 1)"""))
def _(b):
    s = b.scored().withColumn("grp", M.customer_group(F.col("system_type"), GROUPS, "other"))
    return M.confusion(s, _alert(), by=["grp"]).select("grp", "tp", "fp", "fn", "rows")


@query("m14_recall_by_kind", sql("scored", f"SELECT fault_kind, count(*) AS support, round(avg((p >= {THR})::INT), 6) AS recall FROM scored WHERE y = 1 GROUP BY 1"))
def _(b):
    return M.recall_by_kind(b.scored(), _alert()).withColumn("recall", F.round("recall", 6))


_RANK = "SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, ch) AS rk FROM scored"


@query("m14_precision_at_k", sql("scored", f"SELECT k, round((SELECT avg(y) FROM ({_RANK}) WHERE rk <= k), 6) AS precision FROM (VALUES (20), (50), (100)) v(k)"))
def _(b):
    return M.precision_at_k(b.scored()).withColumn("precision", F.round("precision", 6))


@query("m14_daily_precision_at_k", sql("scored", f"""SELECT k, round(avg(d), 6) AS precision FROM (SELECT k, t::DATE AS day, avg(y) AS d FROM ({_RANK}), (VALUES (20), (50), (100)) v(k)
  WHERE rk <= k GROUP BY 1, 2) GROUP BY 1"""))
def _(b):
    return M.daily_precision_at_k(b.scored()).withColumn("precision", F.round("precision", 6))


@query("m15_daily_counts", sql("scored", f"""SELECT t::DATE::VARCHAR AS day, count(*) FILTER (WHERE p >= {THR}) AS predicted, sum(y)::BIGINT AS actual,
  count(*) FILTER (WHERE p >= {THR} AND y = 1) AS true_positive FROM scored GROUP BY 1"""))
def _(b):
    return M.daily_counts(b.scored(), _alert()).withColumn("day", F.col("day").cast("string"))


@query("m16_compare_models", sql("scored", f"""SELECT model, tp, fp, fn, rows, uncovered FROM (
   SELECT 'v3' AS model, {_CONF}, 0 AS uncovered FROM scored
   UNION ALL SELECT 'v2', count(*) FILTER (WHERE q >= 0.3 AND y = 1), count(*) FILTER (WHERE q < 0.3 AND y = 1) * 0 + count(*) FILTER (WHERE q >= 0.3 AND y = 0),
     count(*) FILTER (WHERE q < 0.3 AND y = 1), count(*), count(*) FILTER (WHERE ev_7d = 0)
   FROM (SELECT *, CASE WHEN ev_7d > 0 THEN p / 2 ELSE 0 END AS q FROM scored))"""))
def _(b):
    s = b.scored()
    v2 = s.filter("ev_7d > 0").select("ch", "T", (F.col("p") / 2).alias("p"))
    return M.compare_models(s.drop("p"), {"v3": s, "v2": v2}, {"v3": THR, "v2": 0.3}).select("model", "tp", "fp", "fn", "rows", "uncovered")


_COND = {"changes": ("chg_24h >= 1", lambda: F.col("chg_24h") >= 1), "faults": ("fault_30d > 0", lambda: F.col("fault_30d") > 0),
         "active": ("ev_7d >= 6", lambda: F.col("ev_7d") >= 6)}


@query("m17_precursor_lift", sql("scored", " UNION ALL ".join(
    f"""SELECT '{k}' AS kind, '{n}' AS precursor, w AS slices_with, round(wk / w, 5) AS rate_with, round((ak - wk) / (n - w), 5) AS rate_without,
    round((wk / w) / nullif((ak - wk) / (n - w), 0), 1) AS lift, round(wk / greatest(ak, 1), 3) AS share_of_kind_covered FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE {c}) AS w, count(*) FILTER (WHERE {c} AND fault_kind = '{k}') AS wk,
    count(*) FILTER (WHERE fault_kind = '{k}') AS ak FROM scored) WHERE w >= 100"""
    for n, (c, _) in _COND.items() for k in ("FAULT", "LINK_LOSS", "VALUE_FAILURE"))))
def _(b):
    return M.precursor_lift(b.scored(), {n: c() for n, (_, c) in _COND.items()}, ["FAULT", "LINK_LOSS", "VALUE_FAILURE"])


@query("m18_monthly_rate", sql("scored", """SELECT sensor_type, month(t)::INT AS month, round(avg(coalesce((fault_kind = 'FAULT')::INT, 0)), 6) AS rate FROM scored
  WHERE sensor_type IN ('MACHINERY', 'BUILDING') GROUP BY 1, 2"""))
def _(b):
    return M.monthly_rate(b.scored(), ["MACHINERY", "BUILDING"], "FAULT", F.month("T")).withColumn("rate", F.round("rate", 6))


@query("m19_combine_heads", sql("scored", """SELECT threshold, round(tp / n, 6) AS precision, round(tp / positives, 6) AS recall FROM (
   SELECT q AS threshold, sum(n) OVER w AS n, sum(tp) OVER w AS tp, sum(tp) OVER () AS positives FROM (
     SELECT greatest(p, least(fault_30d, 9) / 10.0)::DOUBLE AS q, count(*) AS n, sum(y) AS tp FROM scored GROUP BY 1) WINDOW w AS (ORDER BY q DESC ROWS UNBOUNDED PRECEDING))
  WHERE tp / n >= 0.42 ORDER BY tp DESC, threshold LIMIT 1"""))
def _(b):
    s = b.scored().withColumn("ps", F.least("fault_30d", F.lit(9)) / 10.0)
    return M.combine_heads(s, "p", "ps", 0.42).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_SURR = {"fall_24h": (0.25, 0.5), "faults_7d": (0.09, 1.0), "ev_7d": (0.006, 5.0), "fault_30d": (0.04, 1.5), "chg_24h": (-0.05, 0.25)}
cte("contrib", "scored", " UNION ALL ".join(f"SELECT t, ch, '{f}' AS feature, {f}::DOUBLE AS value, {w} * ({f} - {m})::DOUBLE AS contrib FROM scored"
                                            for f, (w, m) in _SURR.items()))


@query("m20_top_factors", sql("contrib", """SELECT epoch(t)::BIGINT AS t, ch, feature, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY t, ch
   ORDER BY (contrib > 0) DESC, round(CASE WHEN contrib > 0 THEN contrib END, 9) DESC NULLS LAST, round(abs(contrib), 9) DESC, feature) AS pos FROM contrib) WHERE pos <= 3"""))
def _(b):
    c = M.contributions(b.scored(), ["T", "ch"], _SURR).withColumn("contrib", F.round("contrib", 9))
    return M.top_factors(c, ["T", "ch"]).select(secs("T", "t"), "ch", "feature", "pos")


@query("m20_factors_with_norms")
def _(b):
    s = b.scored()
    top = M.top_factors(M.contributions(s, ["T", "ch"], _SURR), ["T", "ch"])
    types = b.channels().select(F.col("id").alias("ch"), "sensor_type")
    out = M.factors_with_norms(top, ["T", "ch"], M.feature_norms(s, list(_SURR)), types, "ch")
    return out.select(secs("T", "t"), "ch", F.to_json("top_factors").alias("top_factors"))


@query("m21_metrics_long", sql("scored", f"""SELECT 'v3' AS model_version, scope, key, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, (tp + fn)::DOUBLE AS support
  FROM (SELECT 'overall' AS scope, '' AS key, {_CONF} FROM scored UNION ALL SELECT 'sensor_type', sensor_type, {_CONF} FROM scored GROUP BY sensor_type)"""))
def _(b):
    s = b.scored()
    long = M.metrics_long("v3", [("overall", F.lit(""), M.confusion(s, _alert())),
                                 ("sensor_type", F.col("sensor_type"), M.confusion(s, _alert(), by=["sensor_type"]))])
    return long.select("model_version", "scope", "key", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("m23_replace_predictions", sql("preds decisions wo", """
 SELECT id, channel_id, epoch("at")::BIGINT AS at, prob FROM kept UNION ALL
 SELECT (SELECT max(id) FROM kept) + row_number() OVER (ORDER BY "at", channel_id), channel_id, epoch("at")::BIGINT, prob / 2 FROM preds p
 WHERE "at" >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.channel_id = p.channel_id AND k."at" = p."at")""").replace(
    "\n\n SELECT", "\n, kept AS (SELECT * FROM preds WHERE id IN (SELECT prediction_id FROM decisions UNION SELECT prediction_id FROM wo))\n SELECT"))
def _(b):
    cols = ["id", "channel_id", "at", "horizon_h", "prob", "model_version"]
    old = b.predictions().select(*cols)
    new = old.filter(F.col("at") >= "2024-01-10").withColumns({"prob": F.col("prob") / 2, "model_version": F.lit("v4")}).drop("id")
    refs = b.decisions().select(F.col("prediction_id").alias("id")).union(b.work_orders().select("prediction_id"))
    return M.replace_predictions(old, new, refs).select("id", "channel_id", secs("at"), "prob")


@query("u04_referenced_rows_survive", sql("preds decisions", "SELECT 0::BIGINT AS lost"))
def _(b):
    cols = ["id", "channel_id", "at", "horizon_h", "prob"]
    old = b.predictions().select(*cols)
    refs = b.decisions().select(F.col("prediction_id").alias("id"))
    out = M.replace_predictions(old, old.drop("id"), refs)
    return old.join(refs, "id", "left_semi").join(out, cols, "left_anti").agg(F.count(F.lit(1)).alias("lost"))


# ---- training: rows only. Three periods in a row: fit, calibrate and pick the threshold, score

FIT_TO, CALIBRATE_TO = "2024-01-18", "2024-01-22"
NOT_FEATURES = {"ch", "y", "eligible", "object_id", "parent_id"}


def _features(f):
    return [c.name for c in f.schema.fields if c.name not in NOT_FEATURES and isinstance(c.dataType, (NumericType, BooleanType))]


def _part(f, lo, hi):
    t = F.col("T")
    f = f.filter("y is not null")
    f = f if lo is None else f.filter(t >= F.lit(lo).cast("timestamp"))
    return f if hi is None else f.filter(t < F.lit(hi).cast("timestamp"))


def _fitted(b, fit_to=FIT_TO, calibrate_to=CALIBRATE_TO):
    """The model of the first period and its calibration on the second: slices whose horizon has closed before the period ends."""
    f = feature_stage(b)
    names = _features(f)
    model = M.fit_risk(_part(f, None, fit_to), names, rounds=8, depth=4)
    return f, names, model, M.fit_calibration(M.raw_score(_part(f, fit_to, calibrate_to), model, names))


def _norms(f, names):
    return M.feature_norms(f.filter(F.col("T") < F.lit(FIT_TO).cast("timestamp")), names)


@query("m04_m07_fit_and_score")
def _(b):
    f, names, model, calibration = _fitted(b)
    scored = M.calibrate(M.raw_score(_part(f, CALIBRATE_TO, None), model, names), calibration)
    kinds = list(KIND_CODES)
    km = M.fit_kind(_part(f, None, FIT_TO), names, kinds, trees=8, depth=4)
    explained = M.explain(M.kind_probs(scored, km, names, [KIND_CODES[k] for k in kinds]), model, names, _norms(f, names))
    out = M.predictions(explained, "gbt-1")
    return out.withColumn("at", F.unix_timestamp("at")).select("channel_id", "at", "prob", "health", "risk_level", "model_version",
                                                               F.to_json("kind_probs").alias("kind_probs"), F.to_json("top_factors").alias("top_factors"))


@query("m05_calibrated_threshold")
def _(b):
    """The threshold picked on the calibration period and what it gives on the later one."""
    f, names, model, calibration = _fitted(b)
    middle = M.calibrate(M.raw_score(_part(f, FIT_TO, CALIBRATE_TO), model, names), calibration)
    later = M.calibrate(M.raw_score(_part(f, CALIBRATE_TO, None), model, names), calibration)
    threshold = M.pick_threshold(middle.select("p", "y"), 0.5)
    return later.crossJoin(F.broadcast(threshold.select("threshold"))).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= F.col("threshold")) & (F.col("y") == 1)).alias("tp"), F.sum("y").alias("positives"))


@query("m08_predict_at")
def _(b):
    """One moment, by a model that was fitted and calibrated on slices whose day after lies before it."""
    moment = "2024-01-25 13:20:00"
    f, names, model, calibration = _fitted(b, "2024-01-20", "2024-01-24")
    at = X.slices(b.norm(), b.channels(), "at", at=moment)

    def table(sl):
        return X.feature_table(sl, b.hourly(), b.norm(), b.faults(), b.gaps_eff(), b.clock(), b.channels(), b.objects(), b.spec)

    out = M.predict_at(at, table, model, calibration, names, "gbt-1", _norms(f, names))
    return out.select("channel_id", secs("at"), "prob", "health", "risk_level", F.to_json("top_factors").alias("top_factors"))


@query("m22_importance")
def _(b):
    f, names, model, _ = _fitted(b)
    return M.importance(model, names, b.spark)
