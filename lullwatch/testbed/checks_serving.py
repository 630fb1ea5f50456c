"""Checks of questions as of a moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullwatch.operators import ranking, tree
from lullwatch.plans import serving as S
from lullwatch.spec import RiskBounds
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

AT = "2024-01-20 15:20:00"
SNAP = "TIMESTAMP '2024-01-20 12:00:00'"
_SNAP = f"""(SELECT max("at") FROM preds WHERE "at" <= TIMESTAMP '{AT}')"""
cte("snap", "preds", f"""SELECT * FROM preds WHERE "at" = {_SNAP}""")


@query("v01_k05_snapshot", sql("preds", f"SELECT epoch({_SNAP})::BIGINT AS snap"))
def _(b):
    return b.spark.range(1).select(F.unix_timestamp(S.snapshot_at(b.predictions(), AT)).alias("snap"))


@query("v02_predictions_at", sql("snap chn clo", """SELECT p.id, p.channel_id, p.prob, p.risk_level, c.object_id FROM snap p JOIN chn c ON c.id = p.channel_id
  WHERE p.risk_level IN ('attention', 'risk', 'critical') AND c.object_id IN (SELECT id FROM clo WHERE ancestor_id IN (1001, 1003))"""))
def _(b):
    sub = tree.scope_filter(b.channels(), b.objects(), [1001, 1003])
    p = S.predictions_at(b.predictions(), sub, b.objects(), AT, levels=["attention", "risk", "critical"])
    return p.select("id", "channel_id", "prob", "risk_level", "object_id")


@query("v02_k01_risk_page", sql("snap chn", """SELECT p.id, p.prob FROM snap p JOIN chn c ON c.id = p.channel_id WHERE c.sensor_type = 'BUILDING'
  ORDER BY p.prob DESC, p.id LIMIT 10 OFFSET 5"""))
def _(b):
    p = S.predictions_at(b.predictions(), b.channels(), b.objects(), AT, sensor_type="BUILDING")
    return ranking.page(p, [F.desc("prob"), "id"], 10, 5).select("id", "prob")


cte("ldec", "decisions", f"""SELECT prediction_id, max(id) AS decision_id, arg_max(decision_type, id) AS decision_type FROM decisions
  WHERE created_at <= TIMESTAMP '{AT}' GROUP BY 1""")
cte("lwo", "wo", f"""SELECT prediction_id, max(id) AS order_id, arg_max(status, id) AS order_status FROM wo
  WHERE status <> 'cancelled' AND created_at <= TIMESTAMP '{AT}' GROUP BY 1""")


@query("v03_enrich", sql("preds ldec lwo", f"""SELECT p.id, round_even(p.prob, 4) AS prob, d.decision_id, d.decision_type, o.order_id, o.order_status,
  CASE WHEN p."at" + INTERVAL 24 HOUR <= TIMESTAMP '{AT}' THEN p.happened END AS happened,
  epoch(CASE WHEN p."at" + INTERVAL 24 HOUR <= TIMESTAMP '{AT}' THEN p.fault_at END)::BIGINT AS fault_at
  FROM preds p LEFT JOIN ldec d ON d.prediction_id = p.id LEFT JOIN lwo o ON o.prediction_id = p.id"""))
def _(b):
    e = S.enrich(b.predictions(), b.decisions(), b.work_orders(), b.outcomes(), AT)
    return e.select("id", "prob", "decision_id", "decision_type", "order_id", "order_status", "happened", secs("fault_at"))


@query("v04_dashboard", sql("snap wo chn", f"""SELECT count(*) FILTER (WHERE risk_level = 'normal') AS normal, count(*) FILTER (WHERE risk_level = 'attention') AS attention,
  count(*) FILTER (WHERE risk_level = 'risk') AS risk, count(*) FILTER (WHERE risk_level = 'critical') AS critical,
  count(*) FILTER (WHERE risk_level IN ('risk', 'critical')) AS channels_at_risk, count(*) FILTER (WHERE prob >= 0.4) AS predicted_failures,
  round(sum(prob), 1) AS expected_failures,
  (SELECT count(*) FROM wo WHERE created_at <= TIMESTAMP '{AT}' AND (status IN ('draft', 'submitted', 'in_progress') OR closed_at > TIMESTAMP '{AT}')) AS open_orders,
  (SELECT count(*) FROM chn) AS channels_total FROM snap"""))
def _(b):
    return S.dashboard(b.predictions(), b.work_orders(), b.channels(), AT, 0.4)


@query("v05_accuracy", sql("preds", f"""SELECT tp, fp, fn, round_even(tp / (tp + fp), 3) AS precision, round_even(tp / (tp + fn), 3) AS recall FROM (
  SELECT count(*) FILTER (WHERE prob >= 0.4 AND happened) AS tp, count(*) FILTER (WHERE prob >= 0.4 AND NOT happened) AS fp, count(*) FILTER (WHERE prob < 0.4 AND happened) AS fn
  FROM preds WHERE happened IS NOT NULL AND "at" > TIMESTAMP '{AT}' - INTERVAL 30 DAY AND "at" <= TIMESTAMP '{AT}' - INTERVAL 24 HOUR)"""))
def _(b):
    return S.accuracy(b.predictions(), b.outcomes(), AT, 0.4)


@query("v06_a15_object_tree", sql("snap chn clo obj", """SELECT o.id, o.level, count(c.id) AS channels,
  count(*) FILTER (WHERE p.risk_level = 'normal') AS normal, count(*) FILTER (WHERE p.risk_level = 'attention') AS attention,
  count(*) FILTER (WHERE p.risk_level = 'risk') AS risk, count(*) FILTER (WHERE p.risk_level = 'critical') AS critical,
  CASE max(CASE p.risk_level WHEN 'critical' THEN 3 WHEN 'risk' THEN 2 WHEN 'attention' THEN 1 WHEN 'normal' THEN 0 END)
    WHEN 3 THEN 'critical' WHEN 2 THEN 'risk' WHEN 1 THEN 'attention' WHEN 0 THEN 'normal' END AS max_risk_level
  FROM obj o LEFT JOIN clo l ON l.ancestor_id = o.id LEFT JOIN chn c ON c.object_id = l.id LEFT JOIN snap p ON p.channel_id = c.id GROUP BY 1, 2"""))
def _(b):
    return S.object_tree(b.predictions(), b.channels(), b.objects(), AT).select(
        "id", "level", "channels", "normal", "attention", "risk", "critical", "max_risk_level")


@query("v07_j12_channels_at", sql("chn snap", "SELECT c.id, c.object_id, p.id AS prediction_id, p.prob, p.health FROM chn c LEFT JOIN snap p ON p.channel_id = c.id"))
def _(b):
    return S.channels_at(b.predictions(), b.channels(), b.objects(), AT).select("id", "object_id", "prediction_id", "prob", "health")


@query("v07_k01_channels_page", sql("chn snap", "SELECT c.id, p.prob FROM chn c LEFT JOIN snap p ON p.channel_id = c.id ORDER BY p.prob DESC NULLS LAST, c.id LIMIT 200"))
def _(b):
    return S.by_risk(S.channels_at(b.predictions(), b.channels(), b.objects(), AT), 200).select("id", "prob")


@query("v08_channel_cards", sql("chn snap ev wo decisions preds", f"""SELECT c.id, p.prob, p.risk_level, epoch(e.ts)::BIGINT AS last_ts, e.raw AS last_value,
  (SELECT count(*) FROM wo WHERE wo.channel_id = c.id AND wo.created_at <= TIMESTAMP '{AT}' AND wo.status IN ('draft', 'submitted', 'in_progress')) AS open_orders,
  coalesce(w.watch, false) AS on_watch FROM chn c LEFT JOIN snap p ON p.channel_id = c.id
  LEFT JOIN (SELECT ch, max(ts) AS ts, max(struct_pack(ts := ts, raw := raw)).raw AS raw FROM ev WHERE ts <= TIMESTAMP '{AT}' GROUP BY 1) e ON e.ch = c.id
  LEFT JOIN (SELECT q.channel_id, arg_max(d.decision_type, d.id) = 'monitor' AS watch FROM decisions d JOIN preds q ON q.id = d.prediction_id
    WHERE d.created_at <= TIMESTAMP '{AT}' AND q."at" <= TIMESTAMP '{AT}' AND q."at" > TIMESTAMP '{AT}' - INTERVAL 7 DAY GROUP BY 1) w ON w.channel_id = c.id"""))
def _(b):
    c = S.channel_cards(b.predictions(), b.events(), b.decisions(), b.work_orders(), b.channels(), AT)
    return c.select("id", "prob", "risk_level", secs("last_ts"), "last_value", "open_orders", "on_watch")


@query("v09_hourly_history", sql("ev", """SELECT g.ch, epoch(g.hour)::BIGINT AS hour, count(e.ch) AS events_count, count(*) FILTER (WHERE e.is_alarm) AS alarm_count,
  count(*) FILTER (WHERE e.txt IN ('FAULT', 'DISCONNECTED')) AS fault_count, count(*) FILTER (WHERE e.txt = 'UNCERTAIN') AS uncertain_count,
  count(*) FILTER (WHERE e.txt <> e.pt) AS status_changes, round(avg(e.num), 4) AS value_avg, min(e.num) AS value_min, max(e.num) AS value_max
  FROM (SELECT ch, unnest(generate_series(TIMESTAMP '2024-01-13 16:00:00', TIMESTAMP '2024-01-20 15:00:00', INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT ch FROM ev)) g
  LEFT JOIN (SELECT *, last_value(txt IGNORE NULLS) OVER (PARTITION BY ch, date_trunc('hour', ts) ORDER BY ts, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt
     FROM ev WHERE ts > TIMESTAMP '2024-01-13 15:20:00' AND ts <= TIMESTAMP '2024-01-20 15:20:00') e ON e.ch = g.ch AND date_trunc('hour', e.ts) = g.hour GROUP BY 1, 2"""))
def _(b):
    ch = b.events().select("ch").distinct()
    h = S.hourly_history(b.events(), ch, "2024-01-13 15:20:00", AT, b.spec)
    return h.withColumn("hour", F.unix_timestamp("hour"))


@query("v10_daily_points", sql("hourly", f"""SELECT ch AS channel_id, hour::DATE::VARCHAR AS day, sum(n_ev)::BIGINT AS events_count, sum(n_fault + n_disc)::BIGINT AS fault_count
  FROM hourly WHERE hour::DATE > DATE '2024-01-13' AND hour::DATE <= DATE '2024-01-20' GROUP BY 1, 2"""))
def _(b):
    from lullwatch.plans.journal import channel_daily
    points, _, _ = S.daily_history(channel_daily(b.hourly()), b.predictions(), b.faults(), b.events(), AT, 7, b.spec)
    return points.select("channel_id", F.col("day").cast("string").alias("day"), "events_count", "fault_count")


@query("v10_u03_fault_marks", sql("faults ev", f"""SELECT ch, epoch(ts)::BIGINT AS ts, kind FROM (SELECT ch, ts, kind FROM faults UNION SELECT ch, ts, txt FROM ev WHERE txt IN ('FAULT', 'DISCONNECTED'))
  WHERE ts > TIMESTAMP '{AT}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AT}'"""))
def _(b):
    from lullwatch.plans.journal import channel_daily
    _, marks, _ = S.daily_history(channel_daily(b.hourly()), b.predictions(), b.faults(), b.events(), AT, 7, b.spec)
    return marks.select("ch", secs("ts"), "kind")


@query("v11_journal_alerts", sql("preds chn ldec", f"""SELECT p.id, epoch(p."at")::BIGINT AS at, p.prob, d.decision_type FROM preds p JOIN chn c ON c.id = p.channel_id
  LEFT JOIN ldec d ON d.prediction_id = p.id WHERE p."at" >= {_SNAP} - INTERVAL 7 DAY AND p."at" <= TIMESTAMP '{AT}'
  AND (p.risk_level IN ('risk', 'critical') OR d.decision_type IS NOT NULL)"""))
def _(b):
    j = S.journal(b.predictions(), b.channels(), b.objects(), b.decisions(), b.outcomes(), AT)
    return j.select("id", secs("at"), "prob", "decision_type")


@query("v11_journal_outcome", sql("preds chn ldec", f"""SELECT p.id FROM preds p JOIN chn c ON c.id = p.channel_id LEFT JOIN ldec d ON d.prediction_id = p.id
  WHERE p."at" >= TIMESTAMP '2024-01-10' AND p."at" <= TIMESTAMP '{AT}' AND d.decision_type IS NULL AND c.system_type = 'FIRE_GUARD'
  AND p.happened AND p."at" + INTERVAL 24 HOUR <= TIMESTAMP '{AT}'"""))
def _(b):
    j = S.journal(b.predictions(), b.channels(), b.objects(), b.decisions(), b.outcomes(), AT, date_from="2024-01-10", only_alerts=False,
                  decision="none", outcome="happened", system_type="FIRE_GUARD")
    return j.select("id")


@query("v11_journal_unknown", sql("preds", f"""SELECT p.id FROM preds p WHERE p."at" >= {_SNAP} - INTERVAL 7 DAY AND p."at" <= TIMESTAMP '{AT}'
  AND (p.happened IS NULL OR p."at" + INTERVAL 24 HOUR > TIMESTAMP '{AT}') AND p.prob >= 0.2"""))
def _(b):
    return S.journal(b.predictions(), b.channels(), b.objects(), b.decisions(), b.outcomes(), AT, only_alerts=False,
                     levels=["attention", "risk", "critical"], outcome="unknown", bounds=RiskBounds()).select("id")


@query("v12_a06_daily_facts", sql("preds", """SELECT day::VARCHAR AS day, sum(p)::BIGINT AS predicted, sum(f)::BIGINT AS actual, sum(t)::BIGINT AS true_positive FROM (
   SELECT "at"::DATE AS day, channel_id, max((prob >= 0.4)::INT) AS p, max(happened::INT) AS f, max((prob >= 0.4 AND happened)::INT) AS t
   FROM preds WHERE happened IS NOT NULL AND "at" >= TIMESTAMP '2024-01-10' AND "at" < TIMESTAMP '2024-01-26' GROUP BY 1, 2) GROUP BY 1"""))
def _(b):
    return S.daily_facts(b.predictions(), b.outcomes(), 0.4, "2024-01-10", "2024-01-25").withColumn("day", F.col("day").cast("string"))


def _metrics(b):
    from lullwatch.plans import model as M
    s = b.scored()
    alert = F.col("p") >= 0.4
    return M.metrics_long("v3", [("overall", F.lit(""), M.confusion(s, alert)), ("sensor_type", F.col("sensor_type"), M.confusion(s, alert, by=["sensor_type"])),
                                 ("precision_at_k", F.col("k"), M.precision_at_k(s).withColumnRenamed("precision", "value"))])


@query("v13_model_screen", sql("scored", """SELECT scope, key, support, (row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN scope = 'sensor_type' THEN support END DESC NULLS LAST,
   CASE WHEN scope = 'precision_at_k' THEN key::INT END, key))::INT AS pos FROM (
   SELECT 'overall' AS scope, '' AS key, sum(y)::DOUBLE AS support FROM scored UNION ALL SELECT 'sensor_type', sensor_type, sum(y)::DOUBLE FROM scored GROUP BY 2
   UNION ALL SELECT 'precision_at_k', unnest(['20', '50', '100']), NULL)"""))
def _(b):
    m = _metrics(b).withColumn("computed_at", F.lit("2024-02-01"))
    thr = b.predictions().select("model_version", F.lit(0.4).alias("threshold"), F.lit(True).alias("is_selected")).distinct()
    return S.model_screen(m, S.current_version(thr, m, b.predictions())).select("scope", "key", "support", "pos")


@query("v14_events_at", sql("ev", f"""SELECT event_id, epoch(ts)::BIGINT AS ts, raw FROM ev WHERE is_alarm AND kind NOT IN ('number', 'sentinel')
  AND ts <= (SELECT max(ts) FROM ev WHERE ts <= TIMESTAMP '{AT}') AND ts > (SELECT max(ts) FROM ev WHERE ts <= TIMESTAMP '{AT}') - INTERVAL 1 DAY"""))
def _(b):
    return S.events_at(b.events(), AT, b.spec).select("event_id", secs("ts"), "raw")


@query("v15_tag_events", sql("ev place", """SELECT event_id, array_to_string(list_filter([CASE WHEN fail THEN 'value_failure' END, CASE WHEN gasev AND work THEN 'planned_check' END], lambda x: x IS NOT NULL), ',') AS tags FROM (
  SELECT e.event_id, kind = 'date_value' OR coalesce(abs(x) >= 1000, false) OR coalesce(x IN (-127, -100, 255, 327.68, -3276.8), false) AS fail,
    raw = 'GAS' OR coalesce(p.st = 'MACHINERY' AND x >= 50 AND x < 1000 AND x NOT IN (255, 327.68), false) AS gasev,
    isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 13 AS work FROM ev e JOIN place p ON p.ch = e.ch)"""))
def _(b):
    return S.tag_events(b.events(), b.channels(), b.spec).select("event_id", F.array_join("tags", ",").alias("tags"))


cte("gmark", "ev faults", "SELECT ch, ts FROM ev WHERE raw IN ('FAULT', 'DISCONNECTED', 'POWER_OFF') UNION SELECT ch, ts FROM faults")
cte("goff", "ev place gmark", """SELECT e.event_id,
  (SELECT count(*) FROM place q WHERE q.oid = p.oid AND q.st = p.st) AS peers_o, (SELECT count(*) FROM place q WHERE q.pid = p.pid AND q.st = p.st) AS peers_p,
  (SELECT count(DISTINCT m.ch) FROM gmark m JOIN place q ON q.ch = m.ch WHERE q.oid = p.oid AND q.st = p.st AND m.ts BETWEEN e.ts - INTERVAL 12 HOUR AND e.ts + INTERVAL 12 HOUR) AS off_o,
  (SELECT count(DISTINCT m.ch) FROM gmark m JOIN place q ON q.ch = m.ch WHERE q.pid = p.pid AND q.st = p.st AND m.ts BETWEEN e.ts - INTERVAL 12 HOUR AND e.ts + INTERVAL 12 HOUR) AS off_p
  FROM ev e JOIN place p ON p.ch = e.ch WHERE e.raw IN ('FAULT', 'DISCONNECTED', 'POWER_OFF')""")


@query("v16_tag_group_off", sql("goff", """SELECT event_id, CASE WHEN o THEN 'object' ELSE 'parent' END AS scope, CASE WHEN o THEN off_o ELSE off_p END AS off,
  CASE WHEN o THEN peers_o ELSE peers_p END AS peers FROM (SELECT *, peers_o >= 3 AND off_o / peers_o >= 0.08 AS o, peers_p >= 3 AND off_p / peers_p >= 0.08 AS p FROM goff) WHERE o OR p"""))
def _(b):
    from dataclasses import replace
    return S.tag_group_off(b.events(), b.faults(), b.channels(), b.objects(), replace(b.spec, group_min_share=0.08)).select(
        "event_id", "scope", "off", "peers")


cte("marks", "faults ev", "SELECT ch, ts, min(kind) AS kind FROM (SELECT ch, ts, kind FROM faults UNION SELECT ch, ts, txt FROM ev WHERE txt IN ('FAULT', 'DISCONNECTED')) GROUP BY 1, 2")


@query("v17_label_outcomes", sql("preds marks ev", f"""SELECT p.id AS prediction_id, coalesce(m.ts <= p."at" + INTERVAL 24 HOUR, false) AS happened,
  epoch(CASE WHEN m.ts <= p."at" + INTERVAL 24 HOUR THEN m.ts END)::BIGINT AS fault_at, CASE WHEN m.ts <= p."at" + INTERVAL 24 HOUR THEN m.kind END AS fault_kind
  FROM (SELECT * FROM preds WHERE "at" + INTERVAL 24 HOUR <= (SELECT least(max(ts), TIMESTAMP '2024-01-28 13:00:00') FROM ev) AND NOT ("at" < TIMESTAMP '2024-01-12' AND happened)) p
  ASOF LEFT JOIN marks m ON m.ch = p.channel_id AND p."at" < m.ts"""))
def _(b):
    done = b.outcomes().join(b.predictions().filter(F.col("at") < "2024-01-12").select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi")
    o = S.label_outcomes(b.predictions(), done.filter("happened"), b.faults(), b.events(), "2024-01-28 13:00:00", b.spec)
    return o.withColumn("fault_at", F.unix_timestamp("fault_at"))


cte("trans", "preds", """SELECT id, channel_id, "at", prob FROM (SELECT *, lag("at") OVER (PARTITION BY channel_id ORDER BY "at") AS pa FROM preds
  WHERE risk_level = 'critical' AND "at" >= TIMESTAMP '2024-01-11' AND "at" <= TIMESTAMP '2024-01-20 12:00:00')
  WHERE "at" >= TIMESTAMP '2024-01-12' AND (pa IS NULL OR pa < "at" - INTERVAL 24 HOUR)""")


@query("v18_critical_transitions", sql("trans", 'SELECT id, channel_id, epoch("at")::BIGINT AS at, prob FROM trans'))
def _(b):
    t = S.critical_transitions(b.predictions(), "2024-01-12 00:00:00", "2024-01-20 12:00:00")
    return t.withColumn("at", F.unix_timestamp("at"))


@query("v19_transition_groups", sql("trans", f"""SELECT epoch("at")::BIGINT AS at, count(*) AS count FROM trans WHERE "at" > {SNAP} - INTERVAL 72 HOUR GROUP BY 1"""))
def _(b):
    return S.transition_groups(S.transition_feed(b.predictions(), AT, 72)).select(secs("at"), "count")


@query("v19_k03_slice_notifications", sql("trans", """SELECT epoch("at")::BIGINT AS at, id, CASE WHEN rk <= 2 THEN 'single' ELSE 'summary' END AS item, CASE WHEN rk <= 2 THEN 1 ELSE n - 2 END AS count, rk::INT AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY prob DESC, id) AS rk, count(*) OVER (PARTITION BY "at") AS n FROM trans) WHERE rk <= 3"""))
def _(b):
    t = S.critical_transitions(b.predictions(), "2024-01-12 00:00:00", "2024-01-20 12:00:00")
    return S.slice_notifications(t, 2).withColumn("at", F.unix_timestamp("at"))


@query("v20_work_orders_at", sql("wo chn clo", f"""SELECT w.id, w.status, w.priority, epoch(w.created_at)::BIGINT AS created_at FROM wo w WHERE created_at <= TIMESTAMP '{AT}'
  AND status IN ('draft', 'submitted') AND object_id IN (SELECT id FROM clo WHERE ancestor_id = 1002)"""))
def _(b):
    return S.work_orders_at(b.work_orders(), b.channels(), b.objects(), AT, ["draft", "submitted"], object_id=1002).select(
        "id", "status", "priority", secs("created_at"))


@query("v21_available_range", sql("preds", """SELECT min("at")::DATE::VARCHAR AS first_day, max("at")::DATE::VARCHAR AS last_day, (max("at") - INTERVAL 18 HOUR)::DATE::VARCHAR AS default_day FROM preds"""))
def _(b):
    r = S.available_range(b.predictions())
    return r.select(*[F.col(c).cast("string").alias(c) for c in r.columns])


@query("v22_dictionaries", sql("chn", "SELECT system_type, sensor_type, count(*) AS channels FROM chn GROUP BY 1, 2"))
def _(b):
    return S.dictionaries(b.channels())


@query("v22_reasons_for", sql("reasons", "SELECT id, name FROM reasons WHERE is_active AND (decision_type = 'dispatch' OR decision_type IS NULL)"))
def _(b):
    return S.entries_for(b.reasons(), "decision_type", "dispatch").select("id", "name")


@query("v22_default_entry", sql("chn", """SELECT DISTINCT sensor_type, CASE WHEN sensor_type IN ('BUILDING', 'MACHINERY') THEN ascii(sensor_type[1]) ELSE 7 END::BIGINT AS recommendation_id FROM chn"""))
def _(b):
    own = b.channels().filter(F.col("sensor_type").isin("BUILDING", "MACHINERY")).select("sensor_type").distinct().withColumn("id", F.ascii("sensor_type").cast("long"))
    generic = own.limit(1).select(F.lit(None).cast("string").alias("sensor_type"), F.lit(7).cast("long").alias("id"))
    return S.default_entry(b.channels(), own.unionByName(generic).withColumn("is_active", F.lit(True)))


@query("p19_validate_decisions", sql("decisions reasons preds", """SELECT d.id, CASE WHEN r.id IS NULL OR NOT r.is_active THEN 'reason not found' WHEN r.decision_type <> d.decision_type THEN 'reason does not fit' END AS error,
  epoch(greatest(d.created_at, p."at"))::BIGINT AS decided_at, round_even((epoch(greatest(d.created_at, p."at")) - epoch(p."at")) / 60, 1) AS reaction_min
  FROM decisions d JOIN preds p ON p.id = d.prediction_id LEFT JOIN reasons r ON r.id = d.reason_id"""))
def _(b):
    v = S.validate_decisions(b.decisions(), b.predictions(), b.reasons())
    return v.select("id", "error", secs("decided_at"), "reaction_min")


@query("s10_decisions_export", sql("decisions preds chn reasons", """SELECT d.id AS decision_id, p.channel_id, p.prob, d.decision_type, r.name AS reason, '''' || d.comment AS comment,
  round_even((epoch(d.created_at) - epoch(p."at")) / 60, 1) AS reaction_min, p.happened::INT AS happened, p.fault_kind
  FROM decisions d JOIN preds p ON p.id = d.prediction_id JOIN reasons r ON r.id = d.reason_id WHERE p."at" >= TIMESTAMP '2024-01-10' AND p."at" <= TIMESTAMP '2024-01-25'"""))
def _(b):
    e = S.decisions_export(b.decisions(), b.predictions(), b.channels(), b.reasons(), b.outcomes(), "2024-02-01", "2024-01-10", "2024-01-25")
    return e.select("decision_id", "channel_id", "prob", "decision_type", "reason", "comment", "reaction_min", "happened", "fault_kind")


# ---- tree


@query("p12_scope_objects", sql("clo obj", """SELECT o.id, o.id IN (SELECT id FROM clo WHERE ancestor_id IN (1001, 3)) AS own FROM obj o
  WHERE o.id IN (SELECT ancestor_id FROM clo WHERE id IN (SELECT id FROM clo WHERE ancestor_id IN (1001, 3)))"""))
def _(b):
    return tree.scope_objects(b.objects(), [1001, 3]).select("id", "own")


@query("p12_scope_filter", sql("chn clo", "SELECT id FROM chn WHERE object_id IN (SELECT id FROM clo WHERE ancestor_id IN (1001, 3))"))
def _(b):
    return tree.scope_filter(b.channels(), b.objects(), [1001, 3]).select("id")


@query("p11_filter_channels", sql("chn clo", """SELECT id, name FROM chn WHERE object_id IN (SELECT id FROM clo WHERE ancestor_id = 1001) AND (name ILIKE '%12%' OR tag ILIKE '%12%' OR id = 12)"""))
def _(b):
    return tree.filter_channels(b.channels(), b.objects(), object_id=1001, q="12").select("id", "name")


@query("p18_fix_roots", "SELECT n_nationkey AS id, CASE WHEN n_regionkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) THEN n_regionkey END AS parent_id FROM nation WHERE n_nationkey < 3 OR n_nationkey >= 3".replace(
    " WHERE n_nationkey < 3)", " )").replace(" WHERE n_nationkey < 3 OR n_nationkey >= 3", ""))
def _(b):
    return tree.fix_roots(b.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id")))


@query("f18_paths", sql("obj clo", "SELECT l.id, string_agg(o.name, ' → ' ORDER BY l.distance DESC) AS path FROM clo l JOIN obj o ON o.id = l.ancestor_id GROUP BY 1"))
def _(b):
    return tree.paths(b.objects())


@query("g02_complex_of", sql("clo obj chn", "SELECT c.id, l.ancestor_id AS complex_id FROM chn c JOIN clo l ON l.id = c.object_id JOIN obj o ON o.id = l.ancestor_id AND o.level = 2"))
def _(b):
    from lullwatch.plans.scheme import complex_of
    return complex_of(b.channels(), b.objects()).select("id", "complex_id")
