"""Checks of features and labels: the running-counter programs against direct counting over ranges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lullwatch.operators.intervals import days_touched, match_overlaps
from lullwatch.plans import features as X
from lullwatch.plans.journal import clean_fault
from lullwatch.testbed.adapter import SLICE_FROM, SLICE_TO, SPEC
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

_W = SPEC.windows


def slices(b):
    return X.slices(b.norm(), b.channels(), "daily", SLICE_FROM, SLICE_TO)


def feature_stage(b):
    return b.stage("features", lambda: X.feature_table(
        slices(b), b.hourly(), b.norm(), b.faults(), b.gaps_eff(), b.clock(), b.channels(), b.objects(), b.spec))


cte("sl", "norm", f"""SELECT ch, day::TIMESTAMP AS t FROM norm WHERE n_ev_30d > 0 AND day >= DATE '{SLICE_FROM}' AND day < DATE '{SLICE_TO}'""")
cte("cleanf", "faults", """SELECT ch, ts, kind FROM faults WHERE NOT mass AND NOT grp AND NOT in_outage
  AND (kind <> 'VALUE_FAILURE' OR sub IN ('date_1970', 'gas_anomaly'))""")
cte("recs", "faults geff", """SELECT f.ch, g.ts, (epoch(g.ts) - epoch(f.ts)) / 3600.0 AS hours
  FROM faults f JOIN geff g ON g.ch = f.ch AND f.ts > g.prev_ts AND f.ts < g.ts_end
  WHERE f.kind = 'LINK_LOSS' AND NOT mass AND NOT grp AND NOT in_outage AND g.ts IS NOT NULL""")


def _range_sums(expr: str, name: str, windows: dict[str, int], ts: str) -> str:
    return ", ".join(f"coalesce(sum({expr}) FILTER (WHERE {ts} t - INTERVAL {h} HOUR), 0) AS {name}_{w}" for w, h in windows.items())


_HOURLY = {"ev": "n_ev", "fault": "n_fault", "disc": "n_disc", "unc": "n_unc", "off": "n_off", "alarm": "n_alarm", "txt": "n_txt",
           "chg": "n_chg", "num": "n_num", "sv": "s_v", "sv2": "s_v2", "same": "n_same", "sent": "n_sent", "date": "n_date",
           "d1970": "n_date1970", "g1wk": "n_gas1_wk", "g1off": "n_gas1_off", "g5": "n_gas5", "gdet": "n_gasdet"}
cte("fh", "sl hourly", f"""SELECT s.ch, s.t, max(s.last_ts) AS last_ts,
  {", ".join(_range_sums("h." + c, m, _W, "h.hour >=") for m, c in _HOURLY.items())}
  FROM (SELECT x.ch, x.t, max(g.last_ts) AS last_ts FROM sl x LEFT JOIN hourly g ON g.ch = x.ch AND g.hour < x.t GROUP BY 1, 2) s
  LEFT JOIN hourly h ON h.ch = s.ch AND h.hour < s.t AND h.hour >= s.t - INTERVAL {max(_W.values())} HOUR GROUP BY 1, 2""")
_KINDS = {"fall": "1", "flnk": "(f.kind = 'LINK_LOSS')::INT", "fflt": "(f.kind = 'FAULT')::INT", "fdsc": "(f.kind = 'DISCONNECTED')::INT",
          "fvf": "(f.kind = 'VALUE_FAILURE')::INT"}
_FW = {w: _W[w] for w in ("24h", "7d", "30d", "90d")}
cte("ff", "sl cleanf", f"""SELECT s.ch, s.t, max(f.ts) FILTER (WHERE f.ts <= s.t) AS last_fault, min(f.ts) FILTER (WHERE f.ts > s.t) AS next_fault,
  {", ".join(_range_sums(e, k, _FW, "f.ts <= t AND f.ts >") for k, e in _KINDS.items())}
  FROM sl s LEFT JOIN cleanf f ON f.ch = s.ch GROUP BY 1, 2""")
cte("nextkind", "ff cleanf", """SELECT x.ch, x.t, min(f.kind) AS next_kind FROM ff x JOIN cleanf f ON f.ch = x.ch AND f.ts = x.next_fault GROUP BY 1, 2""")


@query("d14_d19_activity_features", sql("fh", f"""SELECT ch, epoch(t)::BIGINT AS t,
  {", ".join(f"ev_{w}::BIGINT AS ev_{w}, fault_{w}::BIGINT AS fault_msgs_{w}" for w in _W)},
  {", ".join(f"round(ev_{w} / (greatest(ev_30d, 1) * {h} / {_W['30d']}.0), 6) AS ev_ratio_{w}" for w, h in _W.items() if w not in ('30d', '90d'))},
  {", ".join(f"round({m}_{w} / greatest(ev_{w}, 1), 6) AS {m}_share_{w}" for m in ('unc', 'off', 'alarm') for w in _FW)},
  {", ".join(f"disc_{w}::BIGINT AS disc_msgs_{w}, chg_{w}::BIGINT AS status_changes_{w}" for w in _FW)},
  {", ".join(f"round(sv_{w} / nullif(num_{w}, 0), 7) AS v_mean_{w}, round(sqrt(greatest(sv2_{w} / nullif(num_{w}, 0) - pow(sv_{w} / nullif(num_{w}, 0), 2), 0)), 3) AS v_std_{w}, "
             f"round(same_{w} / nullif(num_{w}, 0), 6) AS stuck_share_{w}, sent_{w}::BIGINT AS sentinel_{w}, d1970_{w}::BIGINT AS date1970_{w}"
             for w in ('24h', '7d', '30d'))},
  round(sent_7d / greatest(ev_7d, 1), 6) AS sentinel_share_7d, (date_7d - d1970_7d)::BIGINT AS date_current_7d,
  g1wk_7d::BIGINT AS gas1_work_7d, g1off_7d::BIGINT AS gas1_offhours_7d, gdet_7d::BIGINT AS gas_detected_7d, g5_30d::BIGINT AS gas5_30d FROM fh"""))
def _(b):
    f = feature_stage(b)
    r = lambda c, n=6: F.round(c, n).alias(c)
    cols = []
    for w in _W:
        cols += [f"ev_{w}", f"fault_msgs_{w}"]
        if w not in ("30d", "90d"):
            cols.append(r(f"ev_ratio_{w}"))
    for w in _FW:
        cols += [r(f"{m}_share_{w}") for m in ("unc", "off", "alarm")] + [f"disc_msgs_{w}", f"status_changes_{w}"]
    for w in ("24h", "7d", "30d"):
        cols += [r(f"v_mean_{w}", 7), r(f"v_std_{w}", 3), r(f"stuck_share_{w}"), f"sentinel_{w}", f"date1970_{w}"]
    return f.select("ch", secs("T", "t"), *cols, r("sentinel_share_7d"), "date_current_7d", "gas1_work_7d", "gas1_offhours_7d",
                    "gas_detected_7d", "gas5_30d")


@query("d15_fault_features", sql("ff recs faults", f"""SELECT x.ch, epoch(x.t)::BIGINT AS t,
  {", ".join(f"fall_{w}::BIGINT AS faults_{w}, flnk_{w}::BIGINT AS link_losses_{w}" for w in _FW)},
  {", ".join(f"fflt_{w}::BIGINT AS fault_episodes_{w}, fdsc_{w}::BIGINT AS disc_episodes_{w}, fvf_{w}::BIGINT AS value_failures_{w}" for w in ('30d', '90d'))},
  (epoch(x.t) - epoch(last_fault))::BIGINT AS days_since_fault,
  (SELECT count(*) FROM recs r WHERE r.ch = x.ch AND r.ts <= x.t AND r.ts > x.t - INTERVAL {_W['90d']} HOUR)::BIGINT AS recoveries_90d,
  (SELECT round(avg(hours) * 3600, 1) FROM recs r WHERE r.ch = x.ch AND r.ts <= x.t AND r.ts > x.t - INTERVAL {_W['90d']} HOUR) AS recovery_h_90d,
  (SELECT count(*) FROM faults g WHERE g.grp AND g.ch = x.ch AND g.ts <= x.t AND g.ts > x.t - INTERVAL {_W['30d']} HOUR)::BIGINT AS group_silences_30d
  FROM ff x"""))
def _(b):
    f = feature_stage(b)
    cols = [c for w in _FW for c in (f"faults_{w}", f"link_losses_{w}")]
    cols += [c for w in ("30d", "90d") for c in (f"fault_episodes_{w}", f"disc_episodes_{w}", f"value_failures_{w}")]
    return f.select("ch", secs("T", "t"), *cols, F.round(F.col("days_since_fault") * 86400).cast("long").alias("days_since_fault"),
                    "recoveries_90d", F.round(F.col("recovery_h_90d") * 3600, 1).alias("recovery_h_90d"), "group_silences_30d")


@query("d16_phase_counters", sql("hourly place", """SELECT p.oid, epoch(h.hour)::BIGINT AS hour, sum(h.n_off)::BIGINT AS po, sum(h.n_ev)::BIGINT AS pe
  FROM hourly h JOIN place p ON p.ch = h.ch WHERE p.st = 'FURNITURE' GROUP BY 1, 2"""))
def _(b):
    return X.phase_hours(b.hourly(), b.channels(), b.spec).select("oid", secs("hour"), "po", "pe")


cte("surround", "sl place cleanf hourly norm", f"""SELECT s.ch, s.t, p.oid, p.pid, p.st,
  {", ".join(f"(SELECT count(*) FROM cleanf f JOIN place q ON q.ch = f.ch WHERE q.{k} = p.{k} AND f.ts <= s.t AND f.ts > s.t - INTERVAL {_W[w]} HOUR) AS {n}_{w}"
             for n, k in (('ob', 'oid'), ('pa', 'pid'), ('ty', 'st')) for w in ('24h', '7d'))},
  (SELECT count(*) FROM cleanf f JOIN place q ON q.ch = f.ch WHERE q.st = p.st AND f.ts <= s.t AND f.ts > s.t - INTERVAL {_W['90d']} HOUR) AS ty_90d,
  (SELECT count(*) FROM cleanf f JOIN place q ON q.ch = f.ch WHERE q.st = p.st AND f.kind = 'FAULT' AND f.ts <= s.t AND f.ts > s.t - INTERVAL {_W['7d']} HOUR) AS tyf_7d,
  (SELECT sum(n_off) FROM hourly h JOIN place q ON q.ch = h.ch WHERE q.oid = p.oid AND q.st = 'FURNITURE' AND h.hour < s.t AND h.hour >= s.t - INTERVAL {_W['7d']} HOUR) AS po_7d,
  (SELECT sum(n_ev) FROM hourly h JOIN place q ON q.ch = h.ch WHERE q.oid = p.oid AND q.st = 'FURNITURE' AND h.hour < s.t AND h.hour >= s.t - INTERVAL {_W['7d']} HOUR) AS pe_7d,
  (SELECT count(*) FROM norm n JOIN place q ON q.ch = n.ch WHERE q.st = p.st AND n.day = s.t::DATE AND n.n_ev_30d > 0) AS n_act
  FROM sl s JOIN place p ON p.ch = s.ch""")


@query("d20_surrounding_features", sql("surround ff", """SELECT x.ch, epoch(x.t)::BIGINT AS t,
  (ob_24h - f.fall_24h)::BIGINT AS obj_faults_24h, (ob_7d - f.fall_7d)::BIGINT AS obj_faults_7d, pa_24h AS parent_faults_24h, pa_7d AS parent_faults_7d,
  round(ty_24h / greatest(n_act, 1), 6) AS type_fault_rate_24h, round(ty_7d / greatest(n_act, 1), 6) AS type_fault_rate_7d,
  round(tyf_7d / greatest(n_act, 1), 6) AS type_fault_msg_rate_7d, round((ty_7d / 7.0) / greatest(ty_90d / 90.0, 1), 6) AS type_fault_trend_7d_90d,
  round(coalesce(po_7d, 0) / greatest(coalesce(pe_7d, 0), 1), 6) AS obj_phase_off_share_7d
  FROM surround x JOIN ff f ON f.ch = x.ch AND f.t = x.t"""))
def _(b):
    f = feature_stage(b)
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("ch", secs("T", "t"), "obj_faults_24h", "obj_faults_7d", "parent_faults_24h", "parent_faults_7d",
                    r("type_fault_rate_24h"), r("type_fault_rate_7d"), r("type_fault_msg_rate_7d"), r("type_fault_trend_7d_90d"),
                    r("obj_phase_off_share_7d"))


cte("since", "fh outages", """SELECT ch, t, last_ts, (epoch(t) - epoch(last_ts) - coalesce((SELECT sum(epoch(least(x.t, o_end)) - epoch(greatest(x.last_ts, o_start)))
  FROM outages WHERE o_start < x.t AND o_end > x.last_ts), 0)) / 3600.0 AS hours_since_event FROM fh x""")
cte("silence", "since pulse", """SELECT x.ch, x.t, x.hours_since_event, d.norm_s / 3600.0 AS norm_gap_h, l.norm_s / 3600.0 AS norm_last_h,
  l.norm_s / 3600.0 - x.hours_since_event AS hours_to_norm, d.max_gap_7d, d.zero_days_30d, d.history_days
  FROM since x JOIN pulse d ON d.ch = x.ch AND d.day = x.t::DATE
  LEFT JOIN pulse l ON l.ch = x.ch AND l.day = (x.t - to_microseconds(round(x.hours_since_event * 3600000000)::BIGINT))::DATE""")


@query("d20_silence_features", sql("silence", """SELECT ch, epoch(t)::BIGINT AS t, round(hours_since_event, 5) AS hours_since_event,
  round(norm_gap_h, 5) AS norm_gap_h, round(norm_last_h, 5) AS norm_last_h, round(hours_since_event / norm_gap_h, 5) AS gap_to_norm,
  round(max_gap_7d / 3600.0, 5) AS max_gap_7d_h, zero_days_30d::BIGINT AS zero_days_30d, history_days,
  hour(t)::INT AS cal_hour, isodow(t)::INT AS cal_dow, month(t)::INT AS cal_month, (isodow(t) >= 6)::INT AS cal_weekend FROM silence"""))
def _(b):
    r = lambda c: F.round(c, 5).alias(c)
    return feature_stage(b).select("ch", secs("T", "t"), r("hours_since_event"), r("norm_gap_h"), r("norm_last_h"), r("gap_to_norm"),
                                   r("max_gap_7d_h"), "zero_days_30d", "history_days", "cal_hour", "cal_dow", "cal_month", "cal_weekend")


@query("d21_w08_neighbour_features", sql("fh silence place", f"""SELECT ch, epoch(t)::BIGINT AS t, round(er - median(er) OVER w, 6) AS nb_dev_ev_ratio_24h,
  round(us - median(us) OVER w, 6) AS nb_dev_unc_share_24h, count(*) OVER w - 1 AS nb_same_type,
  round((sum((htn < 0)::INT) OVER w - coalesce((htn < 0)::INT, 0)) / greatest(count(*) OVER w - 1, 1), 6) AS nb_silent_share
  FROM (SELECT x.ch, x.t, p.oid, p.st, ev_24h / (greatest(ev_30d, 1) * 24 / {_W['30d']}.0) AS er, unc_24h / greatest(ev_24h, 1) AS us, s.hours_to_norm AS htn
        FROM fh x JOIN place p ON p.ch = x.ch JOIN silence s ON s.ch = x.ch AND s.t = x.t)
  WINDOW w AS (PARTITION BY oid, st, t)"""))
def _(b):
    r = lambda c: F.round(c, 6).alias(c)
    return feature_stage(b).select("ch", secs("T", "t"), r("nb_dev_ev_ratio_24h"), r("nb_dev_unc_share_24h"), "nb_same_type", r("nb_silent_share"))


@query("d22_label", sql("ff nextkind outages", """SELECT x.ch, epoch(x.t)::BIGINT AS t,
  CASE WHEN x.t + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31' THEN coalesce(next_fault <= x.t + INTERVAL 24 HOUR, false)::INT END AS y,
  epoch(CASE WHEN next_fault <= x.t + INTERVAL 24 HOUR THEN next_fault END)::BIGINT AS fault_at,
  CASE WHEN next_fault <= x.t + INTERVAL 24 HOUR THEN next_kind END AS fault_kind,
  coalesce(last_fault <= x.t - INTERVAL 72 HOUR, true)
    AND NOT EXISTS (SELECT 1 FROM outages WHERE o_start < x.t + INTERVAL 24 HOUR AND o_end > x.t - INTERVAL 24 HOUR) AS eligible
  FROM ff x LEFT JOIN nextkind k ON k.ch = x.ch AND k.t = x.t"""))
def _(b):
    return feature_stage(b).select("ch", secs("T", "t"), "y", secs("fault_at"), "fault_kind", "eligible")


def _variant_sql(v: str, cond: str) -> str:
    return f"""SELECT s.ch, s.t, min(f.ts) FILTER (WHERE f.ts > s.t) AS nx, max(f.ts) FILTER (WHERE f.ts <= s.t) AS lx
      FROM sl s LEFT JOIN (SELECT * FROM faults WHERE NOT mass AND NOT grp AND NOT in_outage AND {cond}) f ON f.ch = s.ch GROUP BY 1, 2"""


for _v, _c in (("a", "kind <> 'VALUE_FAILURE'"), ("b", "(kind <> 'VALUE_FAILURE' OR sub IN ('date_1970', 'gas_anomaly'))"), ("c", "true")):
    cte(f"lab_{_v}", "sl faults", _variant_sql(_v, _c))
_LAB = """CASE WHEN {v}.t + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31' THEN coalesce({v}.nx <= {v}.t + INTERVAL 24 HOUR, false)::INT END AS y_{v},
  coalesce({v}.lx <= {v}.t - INTERVAL 72 HOUR, true) AS elig_{v}"""
cte("labels3", "lab_a lab_b lab_c outages", f"""SELECT a.ch, a.t, {_LAB.format(v='a')}, {_LAB.format(v='b')}, {_LAB.format(v='c')},
  EXISTS (SELECT 1 FROM outages WHERE o_start < a.t + INTERVAL 24 HOUR AND o_end > a.t - INTERVAL 24 HOUR) AS outage_slice
  FROM lab_a a JOIN lab_b b ON b.ch = a.ch AND b.t = a.t JOIN lab_c c ON c.ch = a.ch AND c.t = a.t""")


def label_stage(b):
    return b.stage("labels", lambda: X.label_variants([slices(b)], b.faults(), b.clock(), b.spec))


@query("d23_label_variants", sql("labels3", "SELECT * EXCLUDE (t), epoch(t)::BIGINT AS t FROM labels3"))
def _(b):
    return label_stage(b).select("ch", secs("T", "t"), "y_a", "elig_a", "y_b", "elig_b", "y_c", "elig_c", "outage_slice")


@query("d23_label_counts", sql("labels3", """SELECT year(t)::INT AS year, (month(t) > 6)::INT + 1 AS half, count(*) AS n,
  sum(y_a) FILTER (WHERE elig_a AND NOT outage_slice)::BIGINT AS pos_a, sum(y_b) FILTER (WHERE elig_b AND NOT outage_slice)::BIGINT AS pos_b,
  sum(y_c) FILTER (WHERE elig_c AND NOT outage_slice)::BIGINT AS pos_c FROM labels3 GROUP BY 1, 2"""))
def _(b):
    return X.label_counts(label_stage(b))


@query("d18_slices_hourly", sql("norm chn", f"""SELECT n.ch, count(*) AS slices, epoch(max(t))::BIGINT AS last_t FROM (
   SELECT ch, unnest(generate_series(day::TIMESTAMP, day::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS t FROM norm
   WHERE n_ev_30d > 0 AND day >= DATE '{SLICE_FROM}' AND day < DATE '{SLICE_TO}') n JOIN chn c ON c.id = n.ch GROUP BY 1"""))
def _(b):
    s = X.slices(b.norm(), b.channels(), "hourly", SLICE_FROM, SLICE_TO)
    return s.groupBy("ch").agg(F.count(F.lit(1)).alias("slices"), F.unix_timestamp(F.max("T")).alias("last_t"))


@query("d18_slices_at", sql("norm chn", """SELECT n.ch, epoch(TIMESTAMP '2024-01-20 15:00:00')::BIGINT AS t FROM norm n JOIN chn c ON c.id = n.ch
  WHERE n.day = DATE '2024-01-20' AND n.n_ev_30d > 0"""))
def _(b):
    return X.slices(b.norm(), b.channels(), "at", at="2024-01-20 15:40:00").select("ch", secs("T", "t"))


cte("swin", "norm chn outages", """SELECT object_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days, max(silent) AS silent, max(active) AS active FROM (
   SELECT *, day - (row_number() OVER (PARTITION BY object_id ORDER BY day))::INT AS run FROM (
     SELECT c.object_id, n.day, count(*) AS active, count(*) FILTER (WHERE n.n_ev = 0) AS silent
     FROM norm n JOIN chn c ON c.id = n.ch WHERE c.sensor_type = 'BUILDING' AND n.n_ev_30d > 0
       AND n.day NOT IN (SELECT o_start::DATE FROM outages) GROUP BY 1, 2)
   WHERE silent >= 1 AND silent >= 0.3 * active) GROUP BY object_id, run HAVING count(*) >= 2""")
# the works calendar: the first and last supplier-free stretch of a nation, as dates of January
cte("works", "", """SELECT s_nationkey::BIGINT AS object_id, min(s_name) AS work, DATE '2024-01-05' + (min(s_suppkey) % 20)::INT AS cal_from,
  DATE '2024-01-09' + (min(s_suppkey) % 20)::INT AS cal_to FROM supplier GROUP BY 1""")


def _silent(b):
    dark = days_touched(b.outages().select("start", (F.col("start") + F.expr("INTERVAL 1 SECOND")).alias("end"))).select("day").distinct()
    return X.silent_windows(b.norm(), b.channels(), dark, "BUILDING", replace(b.spec, group_min_channels=1))


@query("d24_silent_windows", sql("swin", "SELECT object_id, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, days, silent, active FROM swin"))
def _(b):
    return _silent(b).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("d24_match_works_calendar", sql("swin works", """SELECT s.object_id, s.first_day::VARCHAR AS first_day, string_agg(w.work, '; ' ORDER BY w.work) AS works,
  min(s.first_day - w.cal_from) AS start_off, min(s.last_day - w.cal_to) AS end_off
  FROM swin s JOIN works w ON s.first_day <= w.cal_to AND s.last_day >= w.cal_from GROUP BY 1, 2"""))
def _(b):
    first = F.min("s_suppkey")
    works = b.table("supplier").groupBy("s_nationkey").agg(
        F.min("s_name").alias("work"), first.alias("k")).select(
        "work", F.expr("date_add(DATE'2024-01-05', cast(k % 20 as int))").alias("cal_from"),
        F.expr("date_add(DATE'2024-01-09', cast(k % 20 as int))").alias("cal_to"))
    m = match_overlaps(_silent(b), works)
    return m.groupBy("object_id", F.col("first_day").cast("string").alias("first_day")).agg(
        F.array_join(F.sort_array(F.collect_list("work")), "; ").alias("works"),
        F.min(F.date_diff("first_day", "cal_from")).cast("long").alias("start_off"),
        F.min(F.date_diff("last_day", "cal_to")).cast("long").alias("end_off"))


@query("a10_silence_share_histogram", sql("faults chn", """SELECT CASE c.system_type WHEN 'GAS_GUARD' THEN 'gas' ELSE 'other' END AS grp_type, f.kind,
  CASE WHEN coalesce(n_act_par, 0) = 0 THEN 'none' WHEN n_sil_par / n_act_par < 0.1 THEN '00-10' WHEN n_sil_par / n_act_par < 0.25 THEN '10-25'
       WHEN n_sil_par / n_act_par < 0.5 THEN '25-50' WHEN n_sil_par / n_act_par < 0.75 THEN '50-75' ELSE '75-100' END AS share,
  count(*) AS n, count(*) FILTER (WHERE n_sil_par >= 2) AS n_ge2 FROM faults f JOIN chn c ON c.id = f.ch
  WHERE NOT f.mass AND f.kind IN ('LINK_LOSS', 'FAULT') GROUP BY 1, 2, 3"""))
def _(b):
    from lullwatch.plans.quality import silence_share_hist
    return silence_share_hist(b.faults(), b.channels(), b.spec, gas_system="GAS_GUARD", kinds=("LINK_LOSS", "FAULT"),
                              silent="n_sil_par", active="n_act_par", at_least=2)


@query("a11_group_share", sql("faults", """SELECT year(ts)::INT AS year, kind, count(*) AS n, count(*) FILTER (WHERE grp) AS grp, round(avg(grp::INT), 4) AS share
  FROM faults WHERE NOT mass GROUP BY 1, 2"""))
def _(b):
    f = b.faults().filter("NOT mass")
    return f.groupBy(F.year("ts").alias("year"), "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("grp").alias("grp"), F.round(F.avg(F.col("grp").cast("int")), 4).alias("share"))


@query("clean_fault_counts", sql("cleanf", "SELECT kind, count(*) AS n FROM cleanf GROUP BY 1"))
def _(b):
    return b.faults().filter(clean_fault(b.spec)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
