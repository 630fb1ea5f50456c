"""Checks of the journal programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullwatch.plans import journal as J
from lullwatch.testbed.oracle import sql
from lullwatch.testbed.registry import query, secs

_HOURLY = """ch, n_ev, n_fault, n_disc, n_unc, n_off, n_alarm, n_txt, n_chg, n_num, n_same, n_sent, n_date, n_date1970,
 n_gas1_wk, n_gas1_off, n_gas5, n_gasdet, v_min, v_max, max_gap_s"""


@query("d01_hourly_aggregates", sql("hourly", f"""SELECT {_HOURLY}, epoch(hour)::BIGINT AS hour, epoch(last_ts)::BIGINT AS last_ts,
  round(s_v, 4) AS s_v, round(s_v2, 4) AS s_v2 FROM hourly"""))
def _(b):
    h = b.hourly()
    return h.select(*[c.strip() for c in _HOURLY.split(",")], secs("hour"), secs("last_ts"),
                    F.round("s_v", 4).alias("s_v"), F.round("s_v2", 4).alias("s_v2"))


@query("d02_gaps", sql("gaps", "SELECT ch, epoch(prev_ts)::BIGINT AS prev_ts, epoch(ts)::BIGINT AS ts, gap_s FROM gaps"))
def _(b):
    return J.extract_gaps(b.events(), b.spec).select("ch", secs("prev_ts"), secs("ts"), "gap_s")


@query("d03_value_failures", sql("vfail", "SELECT ch, epoch(ts)::BIGINT AS ts, is_alarm, raw, sub FROM vfail"))
def _(b):
    return b.failures().select("ch", secs("ts"), "is_alarm", "raw", "sub")


@query("d04_outages", sql("outages", "SELECT epoch(o_start)::BIGINT AS start_s, epoch(o_end)::BIGINT AS end_s, hours, events FROM outages"))
def _(b):
    return J.detect_outages(b.hourly(), b.spec.grid_from, b.spec.data_end, b.spec).select(
        secs("start", "start_s"), secs("end", "end_s"), "hours", "events")


@query("d05_effective_gaps", sql("geff", "SELECT ch, epoch(prev_ts)::BIGINT AS prev_ts, epoch(ts_end)::BIGINT AS ts_end, gap_eff_s, outage_s FROM geff"))
def _(b):
    return J.effective_gaps(b.gaps(), b.clock(), b.spec).select("ch", secs("prev_ts"), secs("ts_end"), "gap_eff_s", "outage_s")


@query("d06_dense_grid", sql("norm", "SELECT ch, count(*) AS days, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM norm GROUP BY ch"))
def _(b):
    daily = b.hourly().select("ch", F.to_date("hour").alias("day"))
    return J.dense_grid(daily, b.spec).groupBy("ch").agg(
        F.count(F.lit(1)).alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("d07_personal_norm", sql("norm", "SELECT ch, day::VARCHAR AS day, n_ev, max_gap_s, n_ev_30d, norm_s FROM norm"))
def _(b):
    return J.personal_norm(b.hourly(), b.gaps_eff(), b.spec).withColumn("day", F.col("day").cast("string"))


@query("d08_link_losses", sql("link", "SELECT ch, epoch(prev_ts)::BIGINT AS prev_ts, epoch(ts_end)::BIGINT AS ts_end, gap_eff_s, norm_s, epoch(ts)::BIGINT AS ts FROM link"))
def _(b):
    return J.link_losses(b.gaps_eff(), b.norm(), b.clock(), b.spec).select(
        "ch", secs("prev_ts"), secs("ts_end"), "gap_eff_s", "norm_s", secs("ts"))


@query("d09_fault_candidates", sql("cand", "SELECT ch, epoch(ts)::BIGINT AS ts, kind, sub, is_alarm, mass, epoch(silent_from)::BIGINT AS silent_from FROM cand"))
def _(b):
    return b.candidates().select("ch", secs("ts"), "kind", "sub", "is_alarm", "mass", secs("silent_from"))


@query("d10_group_onset", sql("faults", """SELECT ch, epoch(ts)::BIGINT AS ts, kind, n_sil_obj, n_act_obj, n_sil_par, n_act_par, grp_onset FROM faults"""))
def _(b):
    return J.group_onset(b.candidates(), b.link(), b.norm(), b.channels(), b.objects(), b.spec).select(
        "ch", secs("ts"), "kind", "n_sil_obj", "n_act_obj", "n_sil_par", "n_act_par", "grp_onset")


@query("d11_silent_group_days", sql("zo zp", """
 SELECT day::VARCHAR AS day, oid, NULL::BIGINT AS pid, st FROM zo WHERE day - d0 = 1 OR d1 - day = 1
 UNION ALL SELECT day::VARCHAR, NULL, pid, st FROM zp WHERE day - d0 = 1 OR d1 - day = 1"""))
def _(b):
    z = J.silent_group_days(b.norm(), b.clock(), b.channels(), b.objects(), b.spec)
    return z.select(F.col("day").cast("string").alias("day"), "oid",
                    F.when(F.col("parent_level") == 1, F.col("pid")).alias("pid"), "st")


@query("d12_faults", sql("faults", "SELECT ch, epoch(ts)::BIGINT AS ts, kind, sub, mass, grp_onset, grp_day, grp, in_outage FROM faults"))
def _(b):
    return b.faults().select("ch", secs("ts"), "kind", "sub", "mass", "grp_onset", "grp_day", "grp", "in_outage")


@query("d25_fault_summary", sql("faults", """SELECT kind, sub, year(ts)::INT AS year, count(*) AS n, count(*) FILTER (WHERE mass)::BIGINT AS mass,
  count(*) FILTER (WHERE grp)::BIGINT AS grp, count(DISTINCT ch) AS channels FROM faults GROUP BY 1, 2, 3"""))
def _(b):
    return J.fault_summary(b.faults())


@query("a07_channel_daily", sql("hourly", """SELECT ch AS channel_id, hour::DATE::VARCHAR AS day, sum(n_ev)::BIGINT AS events_count,
  sum(n_alarm)::BIGINT AS alarm_count, sum(n_fault + n_disc)::BIGINT AS fault_count, sum(n_unc)::BIGINT AS uncertain_count,
  sum(n_off)::BIGINT AS power_off_count, sum(n_chg)::BIGINT AS status_changes, round(sum(s_v) / nullif(sum(n_num), 0), 4) AS value_avg,
  min(v_min) AS value_min, max(v_max) AS value_max, round_even(max(max_gap_s) / 60, 0)::INT AS max_gap_min FROM hourly GROUP BY 1, 2"""))
def _(b):
    return J.channel_daily(b.hourly()).withColumn("day", F.col("day").cast("string"))


@query("flagship_overdue_channels", sql("geff norm", """SELECT g.ch, epoch(g.prev_ts)::BIGINT AS silent_since, g.gap_eff_s, n.norm_s,
  round(g.gap_eff_s / n.norm_s, 4) AS ratio FROM geff g JOIN norm n ON n.ch = g.ch AND n.day = g.prev_ts::DATE
  WHERE g.ts IS NULL AND n.n_ev_30d > 0 AND g.gap_eff_s > n.norm_s"""))
def _(b):
    return J.overdue_channels(b.gaps_eff(), b.norm())


@query("flagship_silence_report", sql("geff norm", """SELECT g.ch, epoch(g.prev_ts)::BIGINT AS silent_since, g.gap_eff_s, n.norm_s,
  round(g.gap_eff_s / n.norm_s, 4) AS ratio, n.n_ev_30d > 0 AND g.gap_eff_s > n.norm_s AS overdue
  FROM geff g JOIN norm n ON n.ch = g.ch AND n.day = g.prev_ts::DATE WHERE g.ts IS NULL"""))
def _(b):
    return J.silence_report(b.gaps_eff(), b.norm())
