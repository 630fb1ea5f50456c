"""Checks of joins, windows, intervals and set programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullwatch.operators import carry, intervals, ranking, sets, windows as W
from lullwatch.operators.asof import asof_join
from lullwatch.plans import features as X
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

# probes: every clean event of a channel, asked against the channel's status faults
cte("sfault", "ev", "SELECT ch, ts, max(txt) AS kind FROM ev WHERE txt IN ('FAULT', 'DISCONNECTED') GROUP BY 1, 2")
cte("probe", "ev", "SELECT event_id, ch, ts AS t FROM ev")


def _sfault(b):
    return b.events().filter(F.col("txt").isin("FAULT", "DISCONNECTED")).groupBy("ch", "ts").agg(F.max("txt").alias("kind"))


def _probe(b):
    return b.events().select("event_id", "ch", F.col("ts").alias("t"))


def _out(df):
    return df.select("event_id", secs("ts"), "kind")


@query("j02_asof_backward", sql("probe sfault", """SELECT p.event_id, epoch(f.ts)::BIGINT AS ts, f.kind
  FROM probe p ASOF LEFT JOIN sfault f ON f.ch = p.ch AND p.t >= f.ts"""))
def _(b):
    return _out(asof_join(_probe(b), _sfault(b), ["ch"], "t", "ts", ["kind"]))


@query("j03_asof_strict", sql("probe sfault", """SELECT p.event_id, epoch(f.ts)::BIGINT AS ts, f.kind
  FROM probe p ASOF LEFT JOIN sfault f ON f.ch = p.ch AND p.t > f.ts"""))
def _(b):
    return _out(asof_join(_probe(b), _sfault(b), ["ch"], "t", "ts", ["kind"], strict=True))


@query("j04_asof_forward", sql("probe sfault", """SELECT p.event_id, epoch(f.ts)::BIGINT AS ts, f.kind
  FROM probe p ASOF LEFT JOIN sfault f ON f.ch = p.ch AND p.t < f.ts"""))
def _(b):
    return _out(asof_join(_probe(b), _sfault(b), ["ch"], "t", "ts", ["kind"], direction="forward", strict=True))


@query("j05_asof_by_object", sql("probe sfault place", """SELECT p.event_id, epoch(f.ts)::BIGINT AS ts
  FROM (SELECT p.*, q.oid FROM probe p JOIN place q ON q.ch = p.ch) p
  ASOF LEFT JOIN (SELECT DISTINCT q.oid, s.ts FROM sfault s JOIN place q ON q.ch = s.ch) f ON f.oid = p.oid AND p.t >= f.ts"""))
def _(b):
    dim = b.channels().select(F.col("id").alias("ch"), F.col("object_id").alias("oid"))
    return asof_join(_probe(b).join(dim, "ch"), _sfault(b).join(dim, "ch").select("oid", "ts"), ["oid"], "t", "ts", split_rows=carry.SPLIT_ROWS).select(
        "event_id", secs("ts"))


@query("j05_asof_by_type", sql("probe sfault place", """SELECT p.event_id, epoch(f.ts)::BIGINT AS ts
  FROM (SELECT p.*, q.st FROM probe p JOIN place q ON q.ch = p.ch) p
  ASOF LEFT JOIN (SELECT DISTINCT q.st, s.ts FROM sfault s JOIN place q ON q.ch = s.ch) f ON f.st = p.st AND p.t >= f.ts"""))
def _(b):
    dim = b.channels().select(F.col("id").alias("ch"), F.col("sensor_type").alias("st"))
    return asof_join(_probe(b).join(dim, "ch"), _sfault(b).join(dim, "ch").select("st", "ts"), ["st"], "t", "ts", split_rows=carry.SPLIT_ROWS).select(
        "event_id", secs("ts"))


@query("j01_dimension_lookup", sql("ev place", """SELECT q.st, q.oid, count(*) AS n, count(e.num) AS n_num FROM ev e JOIN place q ON q.ch = e.ch GROUP BY 1, 2"""))
def _(b):
    dim = b.channels().select(F.col("id").alias("ch"), F.col("object_id").alias("oid"), F.col("sensor_type").alias("st"))
    return b.events().groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.count("num").alias("n_num")).join(dim, "ch").groupBy(
        "st", "oid").agg(F.sum("n").alias("n"), F.sum("n_num").alias("n_num"))


@query("j06_overlap_seconds", sql("gaps outages", """SELECT g.ch, epoch(g.prev_ts)::BIGINT AS prev_ts,
  sum(epoch(least(g.ts, o_end)) - epoch(greatest(g.prev_ts, o_start)))::BIGINT AS dark_s
  FROM gaps g JOIN outages ON o_start < g.ts AND o_end > g.prev_ts WHERE g.ts IS NOT NULL GROUP BY 1, 2"""))
def _(b):
    g = b.gaps().filter(F.col("ts").isNotNull())
    return intervals.overlap_seconds(g, b.clock(), F.col("prev_ts"), F.col("ts"), "dark_s").filter("dark_s > 0").select(
        "ch", secs("prev_ts"), "dark_s")


@query("j07_band_distinct_peers", sql("sfault place", """SELECT p.oid, p.st, epoch(a.ts)::BIGINT AS ts, count(DISTINCT z.ch) AS peers
  FROM sfault a JOIN place p ON p.ch = a.ch JOIN place q ON q.oid = p.oid AND q.st = p.st
  JOIN sfault z ON z.ch = q.ch AND z.ts >= a.ts - INTERVAL 12 HOUR AND z.ts <= a.ts + INTERVAL 12 HOUR GROUP BY 1, 2, 3"""))
def _(b):
    dim = b.channels().select(F.col("id").alias("ch"), F.col("object_id").alias("oid"), F.col("sensor_type").alias("st"))
    f = _sfault(b).join(dim, "ch")
    out = carry.band_distinct_count(f, f.withColumnRenamed("ts", "mark"), ["oid", "st"], "ch", "ts", "mark", 12, "peers")
    return out.select("oid", "st", secs("ts"), "peers")


@query("j08_point_in_window", sql("ev outages", """SELECT event_id, EXISTS (SELECT 1 FROM outages WHERE ts >= o_start AND ts < o_end) AS dark FROM ev"""))
def _(b):
    return intervals.flag_in_window(b.events().select("event_id", "ts"), b.clock(), "ts", "dark").select("event_id", "dark")


@query("j09_d13_recoveries", sql("faults geff", """SELECT f.ch, epoch(g.ts)::BIGINT AS ts, round((epoch(g.ts) - epoch(f.ts)) / 3600.0, 4) AS hours
  FROM faults f JOIN geff g ON g.ch = f.ch AND f.ts > g.prev_ts AND f.ts < g.ts_end
  WHERE f.kind = 'LINK_LOSS' AND NOT mass AND NOT grp AND NOT in_outage AND g.ts IS NOT NULL"""))
def _(b):
    return X.recoveries(b.faults(), b.gaps_eff(), b.spec).select("ch", secs("ts"), F.round("hours", 4).alias("hours"))


@query("j10_semi_adjacent_days", sql("norm", """SELECT a.ch, a.day::VARCHAR AS day FROM norm a WHERE a.n_ev = 0
  AND EXISTS (SELECT 1 FROM norm z WHERE z.ch IS NOT DISTINCT FROM a.ch AND z.n_ev = 0 AND abs(z.day - a.day) = 1)"""))
def _(b):
    z = b.norm().filter("n_ev = 0").select("ch", "day")
    near = z.select("ch", F.explode(F.array(F.date_sub("day", 1), F.date_add("day", 1))).alias("near"))
    return z.join(near, z["ch"].eqNullSafe(near["ch"]) & (z["day"] == near["near"]), "left_semi").select(
        "ch", F.col("day").cast("string").alias("day"))


@query("j11_anti_silent_channels", sql("chn ev", "SELECT id FROM chn WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.ch = chn.id)"))
def _(b):
    return b.channels().join(b.events().select(F.col("ch").alias("id")), "id", "left_anti").select("id")


@query("j13_j14_window_counters", sql("hourly norm", """SELECT s.ch, epoch(s.t)::BIGINT AS t,
    coalesce(sum(n_ev) FILTER (WHERE hour >= t - INTERVAL 6 HOUR), 0)::BIGINT AS ev_6h,
    coalesce(sum(n_ev) FILTER (WHERE hour >= t - INTERVAL 24 HOUR), 0)::BIGINT AS ev_24h,
    coalesce(sum(n_chg) FILTER (WHERE hour >= t - INTERVAL 24 HOUR), 0)::BIGINT AS chg_24h,
    coalesce(sum(n_ev), 0)::BIGINT AS ev_30d
  FROM (SELECT ch, day::TIMESTAMP AS t FROM norm WHERE n_ev_30d > 0) s
  LEFT JOIN hourly h ON h.ch = s.ch AND h.hour < s.t AND h.hour >= s.t - INTERVAL 168 HOUR GROUP BY 1, 2"""))
def _(b):
    sl = b.norm().filter("n_ev_30d > 0").select("ch", F.col("day").cast("timestamp").alias("T"))
    hours = b.hourly().select("ch", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"),
                              F.col("n_ev").alias("ev"), F.col("n_chg").alias("chg"))
    out = X.counters_at(sl, hours, "ch", ["ev", "chg"], {"6h": 6, "24h": 24, "30d": 168})
    return out.select("ch", secs("T", "t"), "ev_6h", "ev_24h", "chg_24h", "ev_30d")


# ---- windows


@query("w01_w02_previous_values", sql("evl", """SELECT event_id, epoch(prev_ts)::BIGINT AS prev_ts, prev_num, prev_txt FROM evl"""))
def _(b):
    e = b.events().select("event_id", "ch", "ts", "raw", "num", "txt")
    out = carry.neighbour_by(e, ["ch"], ["ts", "raw"], {
        "prev_ts": ("ts", None), "prev_num": ("num", F.col("num").isNotNull()), "prev_txt": ("txt", F.col("txt").isNotNull())})
    return out.select("event_id", secs("prev_ts"), "prev_num", "prev_txt")


@query("w03_running_sums_d14", sql("hourly", """SELECT ch, epoch(hour)::BIGINT AS hour, (sum(n_ev) OVER w)::BIGINT AS c_ev,
  (sum(n_fault) OVER w)::BIGINT AS c_fault, (sum(n_chg) OVER w)::BIGINT AS c_chg, round(sum(coalesce(s_v, 0)) OVER w, 3) AS c_sv
  FROM hourly WINDOW w AS (PARTITION BY ch ORDER BY hour ROWS UNBOUNDED PRECEDING)"""))
def _(b):
    return X.cumulate(b.hourly()).select("ch", secs("hour"), "c_ev", "c_fault", "c_chg", F.round("c_sv", 3).alias("c_sv"))


@query("w04_running_counts_range", sql("sfault place", """SELECT DISTINCT p.st, epoch(s.ts)::BIGINT AS ts,
  count(*) OVER w AS c_all, (sum((kind = 'FAULT')::INT) OVER w)::BIGINT AS c_flt FROM sfault s JOIN place p ON p.ch = s.ch
  WINDOW w AS (PARTITION BY p.st ORDER BY s.ts RANGE UNBOUNDED PRECEDING)"""))
def _(b):
    dim = b.channels().select(F.col("id").alias("ch"), F.col("sensor_type").alias("st"))
    out = carry.running_totals(_sfault(b).join(dim, "ch"), ["st"], "ts", {
        "c_all": F.lit(1), "c_flt": (F.col("kind") == "FAULT").cast("int")})
    return out.select("st", secs("ts"), "c_all", "c_flt")


@query("w05_w14_daily_pulse_d17", sql("pulse", """SELECT ch, day::VARCHAR AS day, max_gap_7d, max_gap_30d, zero_days_30d::BIGINT AS zero_days_30d,
  round(daily_cv_30d, 6) AS daily_cv_30d, history_days FROM pulse"""))
def _(b):
    return X.daily_pulse(b.norm()).select("ch", F.col("day").cast("string").alias("day"), "max_gap_7d", "max_gap_30d",
                                          "zero_days_30d", F.round("daily_cv_30d", 6).alias("daily_cv_30d"), "history_days")


@query("w06_trailing_median", sql("hourly", """SELECT epoch(hour)::BIGINT AS hour, n, median(n) OVER (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS med
  FROM (SELECT hour, sum(n_ev)::BIGINT AS n FROM hourly GROUP BY 1)"""))
def _(b):
    h = b.hourly().groupBy("hour").agg(F.sum("n_ev").alias("n"))
    return W.trailing_median(h, "hour", "n", 168, "med").select(secs("hour"), "n", "med")


@query("w07_sliding_list", sql("geff", """SELECT ch, day::VARCHAR AS day, array_to_string(list_sort(flatten(list(gl) OVER (PARTITION BY ch ORDER BY day
   ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), 'DESC'), ',') AS past FROM (
   SELECT ch, ts::DATE AS day, list(gap_eff_s) AS gl FROM geff WHERE ts IS NOT NULL GROUP BY 1, 2)""".replace(
    "array_to_string(list_sort(flatten(", "array_to_string(list_sort(flatten(coalesce(").replace("1 PRECEDING)), 'DESC')", "1 PRECEDING), [])), 'DESC')")))
def _(b):
    d = b.gaps_eff().filter(F.col("ts").isNotNull()).groupBy("ch", F.to_date("ts").alias("day")).agg(F.collect_list("gap_eff_s").alias("gl"))
    past = W.sliding_list("gl", W.preceding(["ch"], "day", 7))
    return d.select("ch", F.col("day").cast("string").alias("day"), F.array_join(past.cast("array<string>"), ",").alias("past"))


@query("w09_day_islands", sql("norm", """SELECT ch, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS days FROM (
   SELECT ch, day, day - (row_number() OVER (PARTITION BY ch ORDER BY day))::INT AS island FROM norm WHERE n_ev = 0) GROUP BY ch, island"""))
def _(b):
    z = W.day_islands(b.norm().filter("n_ev = 0"), ["ch"], "day")
    return z.groupBy("ch", "island").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
                                         F.count(F.lit(1)).alias("days")).drop("island")


@query("w10_clusters", sql("chn", """SELECT object_id, min(x) AS x_from, max(x) AS x_to, count(*) AS size FROM (
   SELECT *, sum(brk) OVER (PARTITION BY object_id ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS grp FROM (
     SELECT object_id, id, (id % 500) * 10.0 AS x,
       ((id % 500) * 10.0 - lag((id % 500) * 10.0) OVER (PARTITION BY object_id ORDER BY (id % 500) * 10.0, id) > 50)::INT AS brk FROM chn))
   GROUP BY object_id, coalesce(grp, 0) HAVING count(*) >= 2""".replace("min(x) AS", "min(x)::DOUBLE AS").replace("max(x) AS", "max(x)::DOUBLE AS")))
def _(b):
    p = b.channels().select("object_id", "id", (F.pmod("id", F.lit(500)) * 10.0).alias("x"))
    return W.clusters(p, ["object_id"], "x", 50.0, 2, []).drop("cluster")


@query("w11_rank_within_day", sql("hourly", """SELECT ch, day::VARCHAR AS day, n, rank::INT AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, ch) AS rank FROM (
     SELECT ch, hour::DATE AS day, sum(n_ev)::BIGINT AS n FROM hourly GROUP BY 1, 2)) WHERE rank <= 5"""))
def _(b):
    d = b.hourly().groupBy("ch", F.to_date("hour").alias("day")).agg(F.sum("n_ev").alias("n"))
    return ranking.top_rank(d, ["day"], [F.desc("n"), F.col("ch")], 5).select("ch", F.col("day").cast("string").alias("day"), "n", "rank")


@query("w12_row_ids", sql("hourly", "SELECT ch, epoch(hour)::BIGINT AS hour, 1000 + row_number() OVER (ORDER BY hour, ch) AS id FROM hourly"))
def _(b):
    return W.row_ids(b.hourly().select("ch", "hour"), ["hour", "ch"], "id", 1000, W.id_band("ch", 16)).select("ch", secs("hour"), "id")


@query("w13_change_counts", sql("hourly", "SELECT ch, sum(n_chg)::BIGINT AS changes, sum(n_same)::BIGINT AS stuck FROM hourly GROUP BY ch"))
def _(b):
    return b.hourly().groupBy("ch").agg(F.sum("n_chg").alias("changes"), F.sum("n_same").alias("stuck"))


# ---- sets and top-k


@query("u01_union_padded", sql("vfail link", """SELECT ch, epoch(ts)::BIGINT AS ts, sub, NULL::BIGINT AS norm_s FROM vfail
  UNION ALL SELECT ch, epoch(ts)::BIGINT, NULL, norm_s FROM link"""))
def _(b):
    return sets.union_padded(b.failures().select("ch", secs("ts"), "sub"), b.link().select("ch", secs("ts"), "norm_s"))


@query("u02_union_distinct", sql("norm hourly", """SELECT ch, day::VARCHAR AS day FROM norm WHERE n_ev_30d > 0 UNION SELECT ch, hour::DATE::VARCHAR FROM hourly"""))
def _(b):
    return sets.union_distinct([b.norm().filter("n_ev_30d > 0"), b.hourly().withColumn("day", F.to_date("hour"))], ["ch", "day"]).select(
        "ch", F.col("day").cast("string").alias("day"))


@query("u04_preserved_set", sql("faults", """SELECT (SELECT count(*) FROM faults WHERE mass)::BIGINT AS lost, 0::BIGINT AS added,
  (SELECT count(*) FROM faults WHERE mass) = 0 AS same"""))
def _(b):
    f = b.faults().select("ch", "ts", "kind", "sub", "mass")
    return sets.set_difference_counts(f, f.filter("NOT mass"))


@query("k02_top_sentinel_codes", sql("ev", """SELECT st, x, n, channels FROM (SELECT coalesce(st, '') AS st, x, count(*) AS n, count(DISTINCT ch) AS channels
  FROM ev WHERE kind = 'sentinel' GROUP BY 1, 2) ORDER BY n DESC, st, x LIMIT 25"""))
def _(b):
    s = b.events().filter("kind = 'sentinel'").join(b.channels().select(F.col("id").alias("ch"), F.col("sensor_type").alias("st")), "ch", "left")
    s = s.withColumns({"st": F.coalesce("st", F.lit("")), "x": F.col("raw").cast("double")})
    return ranking.top_counts(s, ["st", "x"], 25, [F.countDistinct("ch").alias("channels")])


@query("f04_calendar", sql("ev", """SELECT day::DATE::VARCHAR AS day, (SELECT count(*) FROM ev WHERE ts::DATE = day::DATE) AS n FROM (
   SELECT unnest(range((SELECT min(ts)::DATE::TIMESTAMP FROM ev), TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day)"""))
def _(b):
    per = b.events().groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = per.agg(F.min("day").alias("d")).select(F.explode(F.sequence("d", F.to_date(F.lit("2024-02-04")))).alias("day"))
    return days.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))
