"""Checks of maintenance advice."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from lullwatch.plans import advice as A
from lullwatch.plans import journal as J
from lullwatch.plans import model as M
from lullwatch.plans.rules import DEFAULT_RULES
from lullwatch.plans.serving import snapshot, snapshot_at
from lullwatch.testbed.checks_serving import AT
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

RULES = replace(
    DEFAULT_RULES,
    groups={**DEFAULT_RULES.groups, "gas": ("machinery",), "smoke": ("building",), "power": ("furniture",), "pump": ("household",),
            "security": ("automobile",)},
    params={**DEFAULT_RULES.params, "flap_changes": 3, "mass_link_neighbors": 2, "mass_link_share": 0.02, "repair_days": 7,
            "power_quiet_days": 2},
)

cte("r1", "preds faults", """SELECT p.id, {}, count(f.ts) FILTER (WHERE f.ts > p."at" - INTERVAL 30 DAY) AS faults_30d, count(f.ts) AS faults_90d
  FROM preds p LEFT JOIN faults f ON f.ch = p.channel_id AND f.ts <= p."at" AND f.ts > p."at" - INTERVAL 90 DAY GROUP BY 1""".format(
    ", ".join(f"count(*) FILTER (WHERE f.kind = '{k}') AS f_{n}_90d" for n, k in
              (("link", "LINK_LOSS"), ("fault", "FAULT"), ("disc", "DISCONNECTED"), ("value", "VALUE_FAILURE")))))
cte("r2c", "ev place", "SELECT ch, ts, txt, p.oid, p.st FROM ev JOIN place p USING (ch) WHERE txt IN ('FAULT', 'DISCONNECTED', 'POWER_OFF')")
cte("r2own", "preds r2c place", """SELECT p.id, p.channel_id, p."at", q.oid, q.st, count(*) FILTER (WHERE e.txt <> 'POWER_OFF' AND e.ts > p."at" - INTERVAL 24 HOUR) AS msgs,
  count(*) FILTER (WHERE e.txt = 'POWER_OFF' AND e.ts > p."at" - INTERVAL 24 HOUR) AS off1, count(*) FILTER (WHERE e.txt = 'POWER_OFF') AS off3
  FROM preds p JOIN place q ON q.ch = p.channel_id LEFT JOIN r2c e ON e.ch = p.channel_id AND e.ts <= p."at" AND e.ts > p."at" - INTERVAL 72 HOUR GROUP BY ALL""")
cte("r2ph", "preds r2c place", """SELECT m."at", e.oid, e.ch FROM (SELECT DISTINCT "at" FROM preds) m JOIN r2c e ON e.txt = 'POWER_OFF' AND e.st = 'FURNITURE'
  AND e.ts <= m."at" AND e.ts > m."at" - INTERVAL 72 HOUR GROUP BY ALL HAVING count(*) = count(*) FILTER (WHERE e.ts > m."at" - INTERVAL 24 HOUR)""")
cte("r2", "r2own r2ph", """SELECT o.id, o.msgs AS fault_msgs_24h, CASE WHEN off1 = off3 THEN off1 ELSE 0 END AS power_off_24h,
  (SELECT count(*) FROM r2ph h WHERE h."at" = o."at" AND h.oid = o.oid AND h.ch <> o.channel_id) AS object_power_off FROM r2own o""")
cte("r3s", "preds faults place", """SELECT s.*, q.oid, q.st FROM (
   SELECT "at", channel_id AS ch FROM preds WHERE risk_level IN ('risk', 'critical') AND ev_7d <= 2
   UNION SELECT m."at", f.ch FROM (SELECT DISTINCT "at" FROM preds) m JOIN faults f ON f.kind = 'LINK_LOSS' AND f.ts <= m."at" AND f.ts > m."at" - INTERVAL 24 HOUR) s
  JOIN place q ON q.ch = s.ch""")
cte("r3", "preds r3s place", """SELECT p.id, count(s.ch) AS neighbors_silent, count(s.ch) FILTER (WHERE s.st = q.st) AS same_type_silent,
  any_value(n.n) AS object_channels, any_value(t.n) AS same_type_channels
  FROM preds p JOIN place q ON q.ch = p.channel_id LEFT JOIN r3s s ON s."at" = p."at" AND s.oid = q.oid AND s.ch <> p.channel_id
  JOIN (SELECT oid, count(*) AS n FROM place GROUP BY 1) n ON n.oid = q.oid
  JOIN (SELECT oid, st, count(*) AS n FROM place GROUP BY 1, 2) t ON t.oid = q.oid AND t.st = q.st GROUP BY 1""")
cte("r4o", "preds wo", """SELECT p.id, max({'c': w.created_at, 'i': w.id, 'n': w.number}).n AS open_order FROM preds p JOIN wo w ON w.channel_id = p.channel_id
  AND w.created_at <= p."at" AND (w.status IN ('draft', 'submitted', 'in_progress') OR w.closed_at > p."at") GROUP BY 1""")
cte("r4d", "preds wo", """SELECT p.id, p.channel_id, p."at", max({'c': w.closed_at, 'i': w.id, 'n': w.number}).c AS repaired_at, max({'c': w.closed_at, 'i': w.id, 'n': w.number}).n AS repair_number
  FROM preds p JOIN wo w ON w.channel_id = p.channel_id AND w.status = 'done' AND w.closed_at <= p."at" AND w.closed_at >= p."at" - INTERVAL 7 DAY GROUP BY ALL""")
cte("r4", "preds r4o r4d faults", """SELECT p.id, o.open_order, o.id IS NOT NULL AS has_open_order, d.repair_number,
  CASE WHEN d.id IS NOT NULL THEN (SELECT count(*) FROM faults f WHERE f.ch = d.channel_id AND f.ts <= d."at" AND f.ts > d.repaired_at) END AS faults_since_repair,
  d.repaired_at FROM preds p LEFT JOIN r4o o ON o.id = p.id LEFT JOIN r4d d ON d.id = p.id""")
cte("r5", "scored", """SELECT sensor_type, count(*) FILTER (WHERE p >= 0.4 AND y = 1) / count(*) FILTER (WHERE p >= 0.4) AS type_precision FROM scored GROUP BY 1""")
cte("sig", "preds chn r1 r2 r3 r4 r5", """SELECT p.*, c.sensor_type, c.object_id, r1.* EXCLUDE (id), r2.* EXCLUDE (id), r3.* EXCLUDE (id), r4.* EXCLUDE (id), r5.type_precision,
  ev_7d <= 2 AS f_sil, chg_24h >= 3 AS f_flap, ev_7d >= 8 AS f_stuck, CASE WHEN fall_7d >= 4 THEN fall_7d / 8 END AS f_nb,
  neighbors_silent >= 2 AND neighbors_silent / greatest(object_channels - 1, 1) >= 0.02 AS mass_l
  FROM preds p JOIN chn c ON c.id = p.channel_id JOIN r1 ON r1.id = p.id JOIN r2 ON r2.id = p.id JOIN r3 ON r3.id = p.id JOIN r4 ON r4.id = p.id
  LEFT JOIN r5 ON r5.sensor_type = c.sensor_type""")
cte("kinded", "sig", """SELECT *, CASE risk_level WHEN 'normal' THEN 0 WHEN 'attention' THEN 1 WHEN 'risk' THEN 2 ELSE 3 END AS rr,
  CASE fk WHEN 'link' THEN f_link_90d WHEN 'fault' THEN f_fault_90d + f_disc_90d WHEN 'disconnected' THEN f_fault_90d + f_disc_90d WHEN 'value' THEN f_value_90d ELSE 0 END AS same_kind FROM (
  SELECT *, CASE WHEN coalesce(f_nb >= 0.5, false) OR (same_type_channels - 1 >= 5 AND same_type_silent / (same_type_channels - 1) >= 0.5) THEN 'group'
    WHEN prob >= 0.3 THEN CASE greatest(p_link, p_fault, p_disconnected, p_value) WHEN p_disconnected THEN 'disconnected' WHEN p_fault THEN 'fault' WHEN p_link THEN 'link' ELSE 'value' END
    WHEN sensor_type = 'FURNITURE' AND power_off_24h > 0 THEN 'power'
    WHEN f_sil AND object_power_off > 0 THEN 'power'
    WHEN fault_msgs_24h > 0 THEN 'fault' WHEN f_sil THEN 'link' WHEN f_flap THEN 'fault' WHEN f_stuck THEN 'drift'
    WHEN faults_90d > 0 THEN CASE greatest(f_link_90d, f_fault_90d, f_disc_90d, f_value_90d) WHEN f_fault_90d THEN 'fault' WHEN f_disc_90d THEN 'fault' WHEN f_link_90d THEN 'link' ELSE 'value' END
    ELSE 'unknown' END AS fk FROM sig)""")
cte("ruled", "kinded", """SELECT *, CASE WHEN fk = 'group' THEN 'group_planned_works' WHEN fk = 'power' AND rr >= 1 THEN 'power_object'
  WHEN fk = 'link' AND mass_l AND rr >= 1 THEN 'mass_link_loss' WHEN rr >= 1 AND faults_since_repair >= 1 THEN 'repeat_after_repair'
  WHEN fk = 'value' THEN 'value_failure' WHEN fk IN ('fault', 'disconnected') AND same_kind >= 3 THEN 'chronic_fault'
  WHEN fk = 'link' AND same_kind >= 3 AND NOT mass_l THEN 'chronic_link'
  WHEN fk IN ('link', 'unknown') AND coalesce(type_precision < 0.5, false) AND rr >= 1 THEN 'verify_remote_first'
  WHEN fk IN ('fault', 'disconnected') THEN 'fault_diagnostics' WHEN sensor_type = 'MACHINERY' AND fk = 'drift' THEN 'gas_calibration'
  WHEN fk = 'drift' THEN 'drift_check' WHEN sensor_type = 'HOUSEHOLD' AND rr >= 1 THEN 'pump_unit' WHEN fk = 'link' AND rr >= 1 THEN 'single_link'
  WHEN rr >= 1 THEN 'watch' ELSE 'routine' END AS rule_id FROM kinded""")
cte("advised", "ruled", """SELECT *, least(CASE rule_id WHEN 'group_planned_works' THEN 24 WHEN 'verify_remote_first' THEN 4 WHEN 'watch' THEN 24
    ELSE CASE pr WHEN 0 THEN 168 WHEN 1 THEN 72 WHEN 2 THEN 24 ELSE 4 END END,
    CASE WHEN rule_id = 'power_object' THEN CASE WHEN object_power_off >= 3 THEN 72 ELSE 48 END
      WHEN rule_id = 'mass_link_loss' THEN CASE sensor_type WHEN 'MACHINERY' THEN 24 WHEN 'HOUSEHOLD' THEN 72 WHEN 'FURNITURE' THEN 48 ELSE 16 END
      WHEN rule_id = 'pump_unit' THEN 72
      WHEN rule_id IN ('repeat_after_repair', 'value_failure', 'chronic_fault', 'chronic_link', 'fault_diagnostics', 'gas_calibration', 'drift_check', 'single_link')
        THEN CASE sensor_type WHEN 'MACHINERY' THEN 24 WHEN 'HOUSEHOLD' THEN 72 ELSE 48 END END)::DOUBLE AS due_hours FROM (
  SELECT *, CASE WHEN work_order THEN greatest(pr0, CASE sensor_type WHEN 'MACHINERY' THEN 2 WHEN 'BUILDING' THEN 1 ELSE 0 END) ELSE pr0 END AS pr FROM (
    SELECT *, rule_id NOT IN ('group_planned_works', 'watch', 'routine') AS work_order,
      rule_id IN ('power_object', 'mass_link_loss', 'repeat_after_repair', 'value_failure', 'chronic_fault', 'chronic_link', 'gas_calibration', 'pump_unit') AS plan,
      rule_id IN ('group_planned_works', 'power_object', 'mass_link_loss') AS per_object,
      CASE WHEN rule_id IN ('power_object', 'mass_link_loss') THEN greatest(rr, 2) WHEN rule_id IN ('value_failure', 'chronic_link', 'gas_calibration') THEN greatest(rr, 1)
        WHEN rule_id IN ('repeat_after_repair', 'chronic_fault') THEN least(rr + 1, 3) WHEN rule_id IN ('group_planned_works', 'verify_remote_first') THEN 1
        WHEN rule_id IN ('watch', 'routine') THEN 0 ELSE rr END AS pr0 FROM ruled))""")


def _metrics(b):
    return M.metrics_long("v3", [("sensor_type", F.col("sensor_type"), M.confusion(b.scored(), F.col("p") >= 0.4, by=["sensor_type"]))])


def _signals(b, preds, keep):
    faults, channels = b.faults(), b.channels()
    orders = keep("orders_asked", lambda: A.orders_asked(preds, b.work_orders()))
    lost = keep("last_losses", lambda: A.last_losses(preds, faults, channels, b.spec))
    totals = b.stage("fault_totals", lambda: A.fault_totals(faults))
    done = keep("repairs", lambda: A.repairs(orders, totals))
    return A.signals(preds, faults, b.events(), orders, channels, _metrics(b), F.lit("v3"), b.spec, RULES, keep=keep,
                     lost=lost, totals=totals, done=done)


def signals(b):
    return b.stage("signals", lambda: _signals(b, b.stage("advised", b.advised), b.stage))


def snapshot_signals(b):
    """Signals of the snapshot alone: each is a matter of its own prediction and of others of the same moment."""
    def keep(name, build):
        return b.stage(f"snapshot_{name}", build)

    preds = keep("advised", lambda: snapshot(b.stage("advised", b.advised), AT))
    return keep("signals", lambda: _signals(b, preds, keep))


def advised(b):
    return A.advise(signals(b), RULES)


@query("r01_fault_counts", sql("r1", "SELECT id, f_link_90d, f_fault_90d, f_disc_90d, f_value_90d, faults_30d, faults_90d FROM r1"))
def _(b):
    p = b.advised()
    return p.select("id", "channel_id", "at").join(A.fault_counts(p, b.faults(), b.spec), ["channel_id", "at"]).select(
        "id", "f_link_90d", "f_fault_90d", "f_disc_90d", "f_value_90d", "faults_30d", "faults_90d")


@query("r02_new_power_off", sql("r2", "SELECT * FROM r2"))
def _(b):
    p = b.advised()
    return p.select("id", "channel_id", "at").join(A.new_power_off(p, b.events(), b.channels(), b.spec, RULES), ["channel_id", "at"]).select(
        "id", "fault_msgs_24h", "power_off_24h", "object_power_off")


@query("r03_silent_neighbours", sql("r3", "SELECT * FROM r3"))
def _(b):
    return A.silent_neighbours(b.advised(), b.faults(), b.channels(), b.spec)


@query("r04_order_state", sql("r4", """SELECT id, open_order, has_open_order, repair_number, epoch(repaired_at)::BIGINT AS repaired_at, faults_since_repair FROM r4"""))
def _(b):
    return A.order_state(b.advised(), b.work_orders(), b.faults(), RULES).select(
        "id", "open_order", "has_open_order", "repair_number", secs("repaired_at"), "faults_since_repair")


@query("r05_type_precision", sql("r5", "SELECT sensor_type, round(type_precision, 6) AS type_precision FROM r5"))
def _(b):
    return A.type_precision(_metrics(b), F.lit("v3")).withColumn("type_precision", F.round("type_precision", 6))


@query("r06_fault_kind", sql("kinded", "SELECT id, fk AS fault_kind FROM kinded"))
def _(b):
    return A.infer_kind(signals(b), RULES).select("id", "fault_kind")


@query("r07_rule", sql("ruled", "SELECT id, rule_id FROM ruled"))
def _(b):
    return advised(b).select("id", "rule_id")


@query("r08_mass_link_flapping", sql("sig", "SELECT id, mass_l AS mass_link, f_flap AS flapping, CASE WHEN f_stuck THEN CASE WHEN ev_7d / 10 > 1 THEN ev_7d / 1000 ELSE ev_7d / 10 END END AS stuck FROM sig"))
def _(b):
    s = signals(b)
    return s.select("id", A.mass_link(RULES).alias("mass_link"), A.flapping(RULES).alias("flapping"), A.stuck_share().alias("stuck"))


@query("r09_priority_and_due", sql("advised", """SELECT id, CASE pr WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority, due_hours, epoch("at")::BIGINT + (due_hours * 3600)::BIGINT AS due_at FROM advised"""))
def _(b):
    return advised(b).select("id", "priority", "due_hours", secs("due_at"))


@query("r10_sensor_groups", sql("chn", """SELECT id, CASE sensor_type WHEN 'MACHINERY' THEN 'gas' WHEN 'BUILDING' THEN 'smoke' WHEN 'FURNITURE' THEN 'power' WHEN 'HOUSEHOLD' THEN 'pump' WHEN 'AUTOMOBILE' THEN 'security' END AS groups FROM chn"""))
def _(b):
    return b.channels().select("id", F.array_join(A.sensor_groups(F.col("sensor_type"), RULES), ",").alias("groups"))


@query("r01_counts_from_days", sql("preds hourly", """SELECT p.id, count(d.day) FILTER (WHERE d.t > p."at" - INTERVAL 30 DAY) AS faults_30d, count(d.day) AS faults_90d FROM preds p
  LEFT JOIN (SELECT ch, hour::DATE AS day, hour::DATE + INTERVAL 1 DAY - INTERVAL 1 SECOND AS t FROM hourly GROUP BY ALL HAVING sum(n_fault + n_disc) > 0) d
  ON d.ch = p.channel_id AND d.t <= p."at" AND d.t > p."at" - INTERVAL 90 DAY GROUP BY 1"""))
def _(b):
    p = b.advised()
    faults = A.faults_or_days(b.faults().limit(0), J.channel_daily(b.hourly()), b.spec)
    return p.select("id", "channel_id", "at").join(A.fault_counts(p, faults, b.spec), ["channel_id", "at"]).select("id", "faults_30d", "faults_90d")


@query("r11_advice_text")
def _(b):
    return A.advice_text(advised(b), RULES).select("id", "rule_id", "reason", F.array_join("facts", "; ").alias("facts"), F.array_join("avoid", "; ").alias("avoid"), "due_basis")


# what the advice says of the signals, in SQL: the facts of three rules, what not to do, and the basis of the deadline
@query("r11_facts_against_basis", sql("advised", """SELECT id, rule_id, CASE rule_id
   WHEN 'repeat_after_repair' THEN 'за 90 дней отказов — ' || faults_90d WHEN 'verify_remote_first' THEN round(type_precision, 6)::VARCHAR END AS said,
  concat_ws('; ', CASE rule_id WHEN 'group_planned_works' THEN 'No visit to each sensor of the object' WHEN 'power_object' THEN 'No new sensors before the power is back'
      WHEN 'mass_link_loss' THEN 'No order for each sensor, one for the object' WHEN 'value_failure' THEN 'Service codes are no readings' WHEN 'verify_remote_first' THEN 'No brigade before a remote check' END,
    CASE WHEN open_order IS NOT NULL AND work_order THEN 'No second order: ' || open_order || ' is open for this sensor' END,
    CASE WHEN rule_id = 'mass_link_loss' AND sensor_type = 'MACHINERY' THEN 'Compare with the calendar of planned works before a visit' END,
    CASE WHEN faults_since_repair = 0 AND repaired_at >= "at" - INTERVAL 24 HOUR THEN 'No second visit: ' || repair_number || ' was done within a day and nothing failed since' END) AS avoid,
  CASE WHEN lim IS NOT NULL THEN 'по регламенту — не более ' || CASE WHEN lim < 48 THEN lim || ' ч' ELSE (lim // 24) || ' сут' END END AS due_basis FROM (SELECT *,
    CASE WHEN rule_id = 'power_object' THEN CASE WHEN object_power_off >= 3 THEN 72 ELSE 48 END
      WHEN rule_id = 'mass_link_loss' THEN CASE sensor_type WHEN 'MACHINERY' THEN 24 WHEN 'HOUSEHOLD' THEN 72 WHEN 'FURNITURE' THEN 48 ELSE 16 END WHEN rule_id = 'pump_unit' THEN 72
      WHEN rule_id IN ('repeat_after_repair', 'value_failure', 'chronic_fault', 'chronic_link', 'fault_diagnostics', 'gas_calibration', 'drift_check', 'single_link')
        THEN CASE sensor_type WHEN 'MACHINERY' THEN 24 WHEN 'HOUSEHOLD' THEN 72 ELSE 48 END END AS lim FROM advised)"""))
def _(b):
    said = F.when(F.col("rule_id") == "repeat_after_repair", F.concat(F.lit("за 90 дней отказов — "), F.col("faults_90d").cast("string"))).when(
        F.col("rule_id") == "verify_remote_first", F.round("type_precision", 6).cast("string"))
    return A.advice_text(advised(b), RULES).select("id", "rule_id", said.alias("said"), F.array_join("avoid", "; ").alias("avoid"), "due_basis")


_SNAP = f"""(SELECT max("at") FROM preds WHERE "at" <= TIMESTAMP '{AT}')"""


@query("r12_repeat_channels", sql("preds faults", f"SELECT ch AS channel_id, count(*) AS n FROM faults WHERE ts <= {_SNAP} AND ts > {_SNAP} - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 2"))
def _(b):
    return A.repeat_channels(b.faults(), snapshot_at(b.predictions(), AT))


@query("r12_repeat_channels_daily", sql("hourly", """SELECT ch AS channel_id, count(*) AS n FROM (SELECT ch, hour::DATE AS day FROM hourly GROUP BY 1, 2 HAVING sum(n_fault + n_disc) > 0)
  WHERE day < DATE '2024-01-20' GROUP BY 1 HAVING count(*) >= 2"""))
def _(b):
    from lullwatch.plans.journal import channel_daily
    return A.repeat_channels_daily(channel_daily(b.hourly()), F.lit(AT).cast("timestamp"))


cte("plan", "advised faults obj", f"""SELECT a.*, o.name AS object_name, max(pr) OVER (PARTITION BY object_id) AS top_pr, count(*) OVER (PARTITION BY object_id) AS object_items FROM advised a
  JOIN obj o ON o.id = a.object_id WHERE "at" = {_SNAP} AND (risk_level IN ('attention', 'risk', 'critical') OR channel_id IN (
   SELECT ch FROM faults WHERE ts <= {_SNAP} AND ts > {_SNAP} - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 2)) AND plan AND work_order AND NOT has_open_order""")


def _plan(b):
    snap = snapshot_signals(b)
    cand = A.plan_candidates(snap, A.repeat_channels(b.faults(), snapshot_at(b.predictions(), AT)))
    return A.maintenance_plan(A.advise(cand, RULES), b.objects())


@query("r13_k04_maintenance_plan", sql("plan", """SELECT id, object_id, object_name, rule_id, object_items, (row_number() OVER (ORDER BY top_pr DESC, object_items DESC, object_name, object_id, pr DESC, prob DESC, id))::INT AS pos
  FROM plan ORDER BY pos LIMIT 50"""))
def _(b):
    p = A.plan_order(_plan(b), 50)
    w = Window.orderBy(F.desc("top_rank"), F.desc("object_items"), "object_name", "object_id", F.desc("_rank"), F.desc("prob"), "id")
    return p.withColumn("pos", F.row_number().over(w)).select("id", "object_id", "object_name", "rule_id", "object_items", "pos")


@query("r13_plan_rows", sql("plan", "SELECT id, object_id, rule_id, object_items FROM plan"))
def _(b):
    return _plan(b).select("id", "object_id", "rule_id", "object_items")


@query("r14_draft_orders", sql("advised", f"""SELECT id, rule_id, CASE WHEN NOT work_order THEN 'no order needed' WHEN has_open_order THEN 'order already open'
   WHEN per_object AND rk > 1 THEN 'included' ELSE 'created' END AS result FROM (SELECT *, row_number() OVER (PARTITION BY object_id, rule_id, work_order AND NOT has_open_order ORDER BY prob DESC, id) AS rk
   FROM advised WHERE "at" = {_SNAP})"""))
def _(b):
    return A.draft_orders(A.advise(snapshot(signals(b), AT), RULES)).select("id", "rule_id", "result")


@query("r15_f14_merge_factors", sql("preds", """SELECT id, grp, features, (row_number() OVER (PARTITION BY id ORDER BY pos))::INT AS rank FROM (
   SELECT id, grp, min(pos) AS pos, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM (
     SELECT id, 1 AS pos, 'silence' AS grp, 'hours_to_norm' AS feature FROM preds WHERE ev_7d <= 2 UNION ALL SELECT id, 2, 'faults', 'faults_24h' FROM preds WHERE fall_24h > 0
     UNION ALL SELECT id, 3, 'status_changes', 'status_changes_24h' FROM preds WHERE chg_24h >= 3 UNION ALL SELECT id, 4, 'fault_msgs', 'fault_msgs_30d' FROM preds WHERE fault_30d > 2
     UNION ALL SELECT id, 5, 'stuck', 'stuck_share_24h' FROM preds WHERE ev_7d >= 8 UNION ALL SELECT id, 6, 'group_silence', 'nb_silent_share' FROM preds WHERE fall_7d >= 4
     UNION ALL SELECT id, 7, 'silence', 'gap_to_norm' FROM preds WHERE ev_7d <= 1) GROUP BY 1, 2) QUALIFY rank <= 3"""))
def _(b):
    return A.merge_factors(b.advised()).select("id", "grp", "features", "rank")


@query("r16_check_transitions", """SELECT order_id, seq, was, status FROM (SELECT o_custkey AS order_id, o_orderkey AS seq, st AS status, lag(st) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM (
   SELECT *, CASE o_orderpriority[1] WHEN '1' THEN 'done' WHEN '2' THEN 'in_progress' WHEN '3' THEN 'submitted' WHEN '4' THEN 'draft' ELSE 'cancelled' END AS st FROM orders))
  WHERE was <> status AND NOT ((was = 'draft' AND status IN ('submitted', 'cancelled')) OR (was = 'submitted' AND status IN ('in_progress', 'draft', 'cancelled'))
   OR (was = 'in_progress' AND status IN ('done', 'cancelled')))""")
def _(b):
    log = b.work_orders().select(F.col("channel_id").alias("order_id"), F.col("id").alias("seq"), "status")
    return A.check_transitions(log).select("order_id", "seq", "was", "status")


@query("r17_sync_dictionary", """SELECT * FROM (SELECT 'rule:' || p_name AS code, 'deactivate' AS action FROM part GROUP BY p_name) UNION ALL
  SELECT unnest(['rule:routine', 'rule:watch']) AS code, 'update' AS action UNION ALL SELECT 'rule:' || unnest(['group_planned_works', 'power_object', 'mass_link_loss', 'repeat_after_repair',
   'value_failure', 'chronic_fault', 'chronic_link', 'verify_remote_first', 'fault_diagnostics', 'gas_calibration', 'temperature_check', 'drift_check', 'pump_unit', 'fan_unit', 'ups_check', 'single_link']), 'add'""")
def _(b):
    names = b.table("part").select(F.concat(F.lit("rule:"), "p_name").alias("code")).distinct()
    known = names.limit(1).select(F.explode(F.array(F.lit("rule:routine"), F.lit("rule:watch"))).alias("code"))
    d = names.unionByName(known).select("code", F.lit("old text").alias("text"), F.lit(True).alias("is_active"))
    return A.sync_dictionary(RULES, d)
