"""Checks of value functions, cleaning, quality profiles and the linear scheme."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullwatch.functions import risk, text, values
from lullwatch.functions.pickets import parse_pickets
from lullwatch.operators.segments import interpolate_by
from lullwatch.plans import journal as J
from lullwatch.plans import quality as Q
from lullwatch.plans import scheme as G
from lullwatch.sources import imports
from lullwatch.spec import RiskBounds
from lullwatch.testbed.oracle import cte, sql
from lullwatch.testbed.registry import query, secs

# ---- cleaning

# an all-string journal: two header lines per day of the month, mixed flag spellings
cte("strj", "rawj", """SELECT event_id::VARCHAR AS event_id, ch::VARCHAR AS channel_id, strftime(ts, '%Y-%m-%d') AS date, ' ' || strftime(ts, '%H:%M:%S') AS time,
  CASE WHEN alarm_raw = 't' THEN ' TRUE' ELSE 'f' END AS alarm, ' ' || raw AS value FROM rawj
  UNION ALL SELECT 'event_id', 'channel_id', 'date', 'time', 'alarm', 'value' FROM region""")


def _strings(b):
    r = b.raw_journal()
    rows = r.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ch").cast("string").alias("channel_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit(" "), F.date_format("ts", "HH:mm:ss")).alias("time"),
        F.when(F.col("alarm_raw") == "t", " TRUE").otherwise("f").alias("alarm"), F.concat(F.lit(" "), "raw").alias("value"))
    header = b.table("region").select(*[F.lit(c).alias(c) for c in rows.columns])
    return rows.unionByName(header)


@query("p01_f05_parse_journal", sql("strj", """SELECT try_cast(event_id AS BIGINT) AS event_id, try_cast(channel_id AS BIGINT) AS ch,
  epoch(try_strptime(date || ' ' || trim(time), '%Y-%m-%d %H:%M:%S'))::BIGINT AS ts, lower(trim(alarm)) AS alarm_raw, trim(value) AS raw FROM strj"""))
def _(b):
    return J.parse_journal(_strings(b)).withColumn("ts", F.unix_timestamp("ts"))


@query("p02_p03_p09_classify_values", sql("ev", "SELECT event_id, kind, num, txt FROM ev"))
def _(b):
    return b.journal().select("event_id", "kind", "num", "txt")


@query("a01_dedup_events", """SELECT ch, epoch(ts)::BIGINT AS ts, raw, min(event_id) AS event_id, bool_or(a) AS is_alarm, count(*) AS dup_n FROM (
   SELECT event_id, user_id AS ch, date_trunc('hour', ts) AS ts, event_type AS raw, event_type = 'error' AS a FROM events) GROUP BY 1, 2, 3""")
def _(b):
    e = b.table("events").select("event_id", F.col("user_id").alias("ch"), F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("raw"),
                                 F.when(F.col("event_type") == "error", "t").otherwise("f").alias("alarm_raw"))
    return J.dedup_events(e).withColumn("ts", F.unix_timestamp("ts"))


_FLAG = """CASE event_type WHEN 'error' THEN ' Да' WHEN 'click' THEN 'NO' WHEN 'view' THEN '' WHEN 'signup' THEN 'T' ELSE 'maybe' END"""


def _flag():
    t = F.col("event_type")
    return (F.when(t == "error", " Да").when(t == "click", "NO").when(t == "view", "").when(t == "signup", "T").otherwise("maybe"))


@query("p04_parse_bool", f"""SELECT event_id, CASE WHEN lower(trim({_FLAG})) IN ('t', 'true', '1', 'да', 'yes', 'y') THEN true
  WHEN lower(trim({_FLAG})) IN ('f', 'false', '0', 'нет', 'no', 'n', '') THEN false END AS flag FROM events""")
def _(b):
    return b.table("events").select("event_id", values.parse_bool(_flag()).alias("flag"))


@query("p05_parse_ts", """SELECT event_id, epoch(CASE event_type WHEN 'signup' THEN date_trunc('minute', ts) WHEN 'view' THEN NULL ELSE date_trunc('second', ts) END
   + CASE WHEN event_type = 'click' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END)::BIGINT AS ts FROM events""")
def _(b):
    t, ts = F.col("event_type"), F.col("ts")
    raw = (F.when(t == "error", F.date_format(ts, "dd.MM.yyyy HH:mm:ss")).when(t == "click", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
           .when(t == "signup", F.date_format(ts, "dd.MM.yyyy HH:mm")).when(t == "view", F.lit("yesterday"))
           .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")))
    return b.table("events").select("event_id", F.unix_timestamp(values.parse_ts(raw)).alias("ts"))


@query("p05_parse_date_time", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS ts FROM events")
def _(b):
    day = F.when(F.col("event_type") == "error", F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return b.table("events").select("event_id", F.unix_timestamp(values.parse_date_time(day, F.date_format("ts", "HH:mm:ss"))).alias("ts"))


@query("p06_clean_events", sql("rawj", r"""SELECT event_id, CASE WHEN raw IN ('FAULT','DISCONNECTED','POWER_OFF','UNCERTAIN','OK','GAS') THEN NULL ELSE raw::DOUBLE END AS value_num,
   CASE WHEN raw IN ('FAULT','DISCONNECTED','POWER_OFF','UNCERTAIN','OK','GAS') THEN raw END AS value_text, alarm_raw = 't' AS is_alarm FROM rawj WHERE raw <> '01.01.1970 03:00:00'"""))
def _(b):
    c = imports.clean_events(b.raw_journal().withColumnsRenamed({"ch": "channel_id", "alarm_raw": "is_alarm", "raw": "value"}).withColumn("ts", F.col("ts").cast("string")))
    return c.filter(F.col("error").isNull()).select("event_id", "value_num", "value_text", "is_alarm")


@query("p07_import_counts", sql("rawj chn", """SELECT count(*) AS rows_total, count(*) FILTER (WHERE raw <> '01.01.1970 03:00:00' AND c.id IS NOT NULL) AS rows_valid,
   count(*) FILTER (WHERE raw = '01.01.1970 03:00:00' OR c.id IS NULL) AS rows_skipped FROM rawj LEFT JOIN chn c ON c.id = rawj.ch"""))
def _(b):
    c = imports.clean_events(b.raw_journal().withColumnsRenamed({"ch": "channel_id", "alarm_raw": "is_alarm", "raw": "value"}).withColumn("ts", F.col("ts").cast("string")))
    return imports.import_counts(imports.known_channels(c, b.channels()))


@query("p08_f20_clean_predictions", """SELECT o_orderkey AS id, CASE WHEN p > 1 THEN 'prob out of range' END AS error, h AS health,
   CASE WHEN h >= 80 THEN 'normal' WHEN h >= 50 THEN 'attention' WHEN h >= 20 THEN 'risk' WHEN h IS NOT NULL THEN 'critical' END AS risk_level
  FROM (SELECT *, CASE WHEN p <= 1 THEN round_even(100 * (1 - p), 0)::INT END AS h FROM (SELECT o_orderkey, round(o_totalprice / 450000, 3) AS p FROM orders))""")
def _(b):
    raw = b.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("channel_id"), F.lit("2024-01-10 00:00:00").alias("at"), F.lit("24").alias("horizon_h"),
        F.round(F.col("o_totalprice") / 450000, 3).cast("string").alias("prob"), F.lit("").alias("health"), F.lit("").alias("risk_level"), F.lit("v3").alias("model_version"))
    c = imports.clean_predictions(raw)
    ok = F.col("error").isNull()
    return c.select("id", "error", F.when(ok, F.col("health")).alias("health"), F.when(ok, F.col("risk_level")).alias("risk_level"))


@query("p10_f01_calendar_parts", """SELECT event_id, epoch(date_trunc('hour', ts))::BIGINT AS hour_s, ts::DATE::VARCHAR AS day, hour(ts)::INT AS h, isodow(ts)::INT AS dow, month(ts)::INT AS m, year(ts)::INT AS y,
  (isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 13) AS work FROM events""")
def _(b):
    ts = F.col("ts")
    return b.table("events").select(
        "event_id", F.unix_timestamp(F.date_trunc("hour", ts)).alias("hour_s"), F.to_date(ts).cast("string").alias("day"), F.hour(ts).alias("h"),
        (F.weekday(ts) + 1).alias("dow"), F.month(ts).alias("m"), F.year(ts).alias("y"), values.in_work_hours(ts, b.spec).alias("work"))


@query("p13_risk_level", """SELECT o_orderkey AS id, CASE WHEN h >= 80 THEN 'normal' WHEN h >= 50 THEN 'attention' WHEN h >= 20 THEN 'risk' ELSE 'critical' END AS lvl
  FROM (SELECT o_orderkey, o_orderkey % 101 AS h FROM orders)""")
def _(b):
    return b.table("orders").select(F.col("o_orderkey").alias("id"), risk.risk_level(F.col("o_orderkey") % 101).alias("lvl"))


@query("p14_levels_from_prob", sql("preds", """SELECT id, CASE WHEN prob >= 0.7 THEN 'critical' WHEN prob >= 0.45 THEN 'risk' WHEN prob >= 0.1 THEN 'attention' ELSE 'normal' END AS lvl,
  prob >= 0.45 AS alert FROM preds"""))
def _(b):
    bounds = RiskBounds(0.1, 0.45, 0.7)
    return b.predictions().select("id", risk.risk_level_from_prob(F.col("prob"), bounds).alias("lvl"),
                                  risk.level_in(F.col("prob"), ["risk", "critical"], bounds).alias("alert"))


@query("p15_thin_predictions", sql("preds", """SELECT id FROM preds WHERE "at" >= TIMESTAMP '2024-01-20' OR hour("at") % 12 = 0"""))
def _(b):
    from lullwatch.sources.publish import thin_predictions
    return thin_predictions(b.predictions(), "2024-01-20", 12).select("id")


@query("p16_split_tag", sql("chn", """SELECT id, lv[1] AS l1, lv[2] AS l2, lv[3] AS l3, lv[4] AS l4, lv[5] AS l5, len(lv)::INT AS depth FROM (
  SELECT id, list_concat(string_split(parts[1], '-'), parts[2:]) AS lv FROM (SELECT id, string_split(regexp_replace(trim(tag), '\\.$', ''), '.') AS parts FROM chn))""".replace("\\\\", "\\")))
def _(b):
    tag = F.col("tag")
    return b.channels().select("id", *[text.tag_level(tag, n).alias(f"l{n}") for n in range(1, 6)], text.tag_depth(tag).alias("depth"))


@query("p17_name_flags", sql("chn", r"SELECT id, regexp_matches(name, 'ПК\s*\d') AS has_pk, regexp_matches(name, 'АНС') AS has_ans, regexp_matches(lower(name), 'щит|шкаф|щ\.|щр') AS has_shield, regexp_matches(name, 'ВШ') AS has_vsh FROM chn"))
def _(b):
    return b.channels().select("id", *[c.alias(n) for n, c in text.name_flags(F.col("name")).items()])


# ---- scalar functions


@query("f02_f03_intervals", """SELECT event_id, epoch(date_trunc('second', ts) + to_hours(event_id % 50) - to_days(1) + to_seconds(event_id % 100))::BIGINT AS t,
  (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts)))::BIGINT AS left_s FROM events""")
def _(b):
    from lullwatch.operators.intervals import seconds_between
    n = F.col("event_id")
    ts = F.date_trunc("second", "ts")
    moved = ts + F.make_dt_interval(hours=(n % 50).cast("int")) - F.make_dt_interval(days=F.lit(1)) + F.make_dt_interval(secs=(n % 100).cast("decimal(18,6)"))
    return b.table("events").select("event_id", F.unix_timestamp(moved).alias("t"),
                                    seconds_between(ts, F.lit("2024-02-01").cast("timestamp")).cast("long").alias("left_s"))


@query("f06_f07_null_skipping_math", """SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, 'O'), 'none') AS s, least(o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 100000.0 END)::DOUBLE AS lo,
  greatest(o_custkey, CASE WHEN o_orderstatus = 'F' THEN 500 END)::BIGINT AS hi, floor(o_totalprice / 1000)::BIGINT AS fl, round(sqrt(o_totalprice), 4) AS sq, abs(o_custkey - 700)::BIGINT AS ab FROM orders""")
def _(b):
    f = F.col("o_orderstatus") == "F"
    return b.table("orders").select(
        F.col("o_orderkey").alias("id"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("none")).alias("s"),
        F.least("o_totalprice", F.when(f, 100000.0)).alias("lo"), F.greatest("o_custkey", F.when(f, 500)).cast("long").alias("hi"),
        F.floor(F.col("o_totalprice") / 1000).alias("fl"), F.round(F.sqrt("o_totalprice"), 4).alias("sq"), F.abs(F.col("o_custkey") - 700).alias("ab"))


@query("f08_list_functions", """SELECT o_custkey AS id, array_to_string(list_sort(list(o_orderkey), 'DESC')[1:3], ',') AS top3, len(list(o_orderkey))::INT AS n, list_sort(list(o_orderkey))[2] AS second FROM orders GROUP BY 1""")
def _(b):
    g = b.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return g.select("id", F.array_join(F.slice(F.reverse("l"), 1, 3).cast("array<string>"), ",").alias("top3"), F.size("l").alias("n"), F.get("l", F.lit(1)).alias("second"))


@query("f09_string_functions", """SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS w1, replace(p_brand, '#', '-') AS br, lower(trim(p_type)) AS ty, p_name LIKE '%ring%' AS ring,
  regexp_replace(p_name, '[aeiou]', '_') AS masked, left(p_name, 4) AS l4 FROM part""")
def _(b):
    return b.table("part").select(
        F.col("p_partkey").alias("id"), F.get(F.split("p_name", " "), F.lit(0)).alias("w1"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("br"),
        F.lower(F.trim("p_type")).alias("ty"), F.col("p_name").like("%ring%").alias("ring"),
        F.regexp_replace("p_name", "^([^aeiou]*)[aeiou]", "$1_").alias("masked"), F.left("p_name", F.lit(4)).alias("l4"))


@query("f10_json_factors")
def _(b):
    s = F.to_json(F.struct(F.col("prob"), F.col("risk_level")))
    back = F.from_json(s, "prob double, risk_level string")
    return b.predictions().select("id", s.alias("json"), back["prob"].alias("prob"))


@query("f11_interpolate", """SELECT o_orderkey AS id, round(CASE WHEN x <= 0.1 THEN 0.0 WHEN x <= 0.4 THEN (x - 0.1) * (0.2 / 0.3) WHEN x <= 0.9 THEN 0.2 + (x - 0.4) * (0.7 / 0.5) ELSE 0.9 END::DOUBLE, 9) AS y
  FROM (SELECT o_orderkey, o_totalprice / 500000 AS x FROM orders)""")
def _(b):
    y = risk.interpolate(F.col("o_totalprice") / 500000, [0.1, 0.4, 0.9], [0.0, 0.2, 0.9])
    return b.table("orders").select(F.col("o_orderkey").alias("id"), F.round(y, 9).alias("y"))


@query("f11_interpolate_points", """WITH pts AS (SELECT o_custkey::DOUBLE AS x, min(o_totalprice)::DOUBLE AS y FROM orders GROUP BY 1)
 SELECT id, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y ELSE lo.y + (q.x - lo.x) * ((hi.y - lo.y) / (hi.x - lo.x)) END, 7) AS y
 FROM (SELECT o_orderkey AS id, (o_totalprice / 100.0)::DOUBLE AS x FROM orders) q ASOF LEFT JOIN pts lo ON q.x > lo.x ASOF LEFT JOIN pts hi ON q.x <= hi.x""")
def _(b):
    o = b.table("orders")
    points = o.groupBy(F.col("o_custkey").cast("double").alias("x")).agg(F.min("o_totalprice").cast("double").alias("y")).withColumn("pos", F.lit(0))
    asked = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100.0).alias("x"))
    return interpolate_by(asked, "x", points, "y").select("id", F.round("y", 7).alias("y"))


@query("f12_likely_kind", sql("preds", """SELECT id, CASE greatest(p_link, p_fault, p_disconnected, p_value) WHEN p_disconnected THEN 'disconnected' WHEN p_fault THEN 'fault' WHEN p_link THEN 'link' ELSE 'value' END AS code,
  round_even(round(100 * greatest(p_link, p_fault, p_disconnected, p_value) / (p_link + p_fault + p_disconnected + p_value), 9), 0)::INT AS share FROM preds"""))
def _(b):
    names = ("link", "fault", "disconnected", "value")
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.col(f"p_{k}") for k in names]))
    best = risk.likely_kind(m, names)
    return b.predictions().select("id", best["code"].alias("code"), best["share"].alias("share"))


@query("f14_feature_group", """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'silence' WHEN 1 THEN 'fault_msgs' WHEN 2 THEN 'activity' WHEN 3 THEN 'static' WHEN 4 THEN 'faults' ELSE 'other:' || p_name END AS grp FROM part""")
def _(b):
    n = F.col("p_size") % 6
    name = (F.when(n == 0, "gap_to_norm").when(n == 1, "fault_msgs_7d").when(n == 2, "ev_ratio_24h").when(n == 3, "sensor_type").when(n == 4, "days_since_fault")
            .otherwise(F.col("p_name")))
    return b.table("part").select(F.col("p_partkey").alias("id"), text.feature_group(name).alias("grp"))


@query("f16_factor_values", """SELECT o_orderkey AS id, replace(format('{:,}', round_even(v, 0)::BIGINT), ',', ' ') AS "int", replace(printf('%.1f', v), '.', ',') AS float1,
 replace(printf('%.2f', v), '.', ',') AS float2, replace(printf('%.1f', v), '.', ',') || '×' AS x, printf('%.0f', v * 100) || ' %' AS pct,
 replace(printf('%+.1f', v), '.', ',') AS signed, printf('%+.0f', v * 100) || ' п.п.' AS signed_pct FROM (SELECT o_orderkey, o_totalprice / 1000 AS v FROM orders)""")
def _(b):
    v = F.col("o_totalprice") / 1000
    return b.table("orders").select(F.col("o_orderkey").alias("id"), *[text.factor_value(v, k).alias(k) for k in ("int", "float1", "float2", "x", "pct", "signed", "signed_pct")])


@query("f19_formula_safe", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '''=' || o_orderpriority ELSE o_orderpriority END AS safe FROM orders")
def _(b):
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("="), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return b.table("orders").select(F.col("o_orderkey").alias("id"), text.formula_safe(raw).alias("safe"))


# ---- quality


@query("q01_load_stats", sql("strj", r"""SELECT count(*) AS rows_raw, count(*) FILTER (WHERE ts IS NULL) AS bad_ts, count(*) FILTER (WHERE try_cast(channel_id AS BIGINT) IS NULL) AS bad_channel,
  count(*) FILTER (WHERE ts IS NOT NULL AND regexp_matches(value, '^\s*\d{2}\.\d{2}\.\d{4}')) AS date_values, 0::BIGINT AS empty_values, count(*) FILTER (WHERE a IN ('t', 'f')) AS alarm_tf,
  count(*) FILTER (WHERE a IN ('true', 'false')) AS alarm_truefalse, count(*) FILTER (WHERE a NOT IN ('t', 'f', 'true', 'false')) AS alarm_other, epoch(min(ts))::BIGINT AS ts_min, epoch(max(ts))::BIGINT AS ts_max
  FROM (SELECT *, lower(trim(alarm)) AS a, try_strptime(date || ' ' || trim(time), '%Y-%m-%d %H:%M:%S') AS ts FROM strj)"""))
def _(b):
    s = Q.load_stats(J.parse_journal(_strings(b)), b.spec)
    return s.withColumns({c: F.unix_timestamp(c) for c in ("ts_min", "ts_max")})


@query("q02_kind_stats", sql("ev", "SELECT kind, count(*) AS rows_kept, sum(dup_n - 1)::BIGINT AS dup_removed FROM ev GROUP BY 1"))
def _(b):
    return Q.kind_stats(b.events())


@query("q02_sentinel_codes", sql("ev", """SELECT coalesce(st, '(not in the dictionary)') AS sensor_type, x AS code, count(*) AS n, count(DISTINCT ch) AS channels, count(*) FILTER (WHERE is_alarm) AS alarm
  FROM ev WHERE kind = 'sentinel' GROUP BY 1, 2 ORDER BY n DESC, sensor_type, code LIMIT 25"""))
def _(b):
    return Q.sentinel_codes(b.events(), b.channels())


@query("q02_date_values", sql("ev", """SELECT coalesce(st, '(not in the dictionary)') AS sensor_type, starts_with(raw, '01.01.1970') AS epoch_1970, count(*) AS n, count(DISTINCT ch) AS channels, count(*) FILTER (WHERE is_alarm) AS alarm
  FROM ev WHERE kind = 'date_value' GROUP BY 1, 2"""))
def _(b):
    return Q.date_values(b.events(), b.channels(), b.spec)


@query("q03_a16_year_stats", sql("ev", """SELECT year(ts)::INT AS year, count(*) AS events, count(DISTINCT ch) AS channels, round(100.0 * count(*) FILTER (WHERE st IS NULL) / count(*), 2) AS orphan_pct,
  count(DISTINCT ch) FILTER (WHERE st IS NULL) AS orphan_channels, round(100.0 * count(num) / count(*), 1) AS numeric_pct FROM ev GROUP BY 1"""))
def _(b):
    return Q.year_stats(b.events(), b.channels())


@query("q04_type_rate", sql("ev", """SELECT year(e.ts)::INT AS year, count(DISTINCT ch) AS type_channels, count(*) AS type_events, (SELECT count(*) FROM ev z WHERE year(z.ts) = 2024) AS events,
  round(count(*) / count(DISTINCT ch) / 30, 1) AS per_channel_day FROM ev e WHERE st = 'MACHINERY' GROUP BY 1"""))
def _(b):
    return Q.type_rate(b.events(), b.channels(), "MACHINERY", F.lit(30))


@query("q05_status_stats", sql("ev", "SELECT txt AS status, count(*) AS events, count(DISTINCT ch) AS channels, round(avg(is_alarm::INT), 3) AS alarm_share FROM ev WHERE txt IS NOT NULL GROUP BY 1"))
def _(b):
    return Q.status_stats(b.events())


@query("q05_type_stats", sql("chn ev", "SELECT system_type, sensor_type, count(*) AS channels, count(*) FILTER (WHERE id IN (SELECT ch FROM ev)) AS active FROM chn GROUP BY 1, 2"))
def _(b):
    return Q.type_stats(b.channels(), b.events())


@query("q06_a13_sample_check", sql("rawj", """SELECT count(*) AS n, count(DISTINCT ch) AS channels, count(*) FILTER (WHERE raw = 'FAULT') AS faulty, count(DISTINCT ch) FILTER (WHERE raw = 'FAULT') AS faulty_channels,
  string_agg(DISTINCT alarm_raw, '/' ORDER BY alarm_raw) AS flags FROM rawj"""))
def _(b):
    return Q.sample_check(b.raw_journal(), b.spec)


@query("a04_grouping_sets", sql("norm place", """SELECT n.day::VARCHAR AS day, q.oid, q.pid, q.st, count(*) AS n_act FROM norm n JOIN place q ON q.ch = n.ch WHERE n.n_ev_30d > 0
  GROUP BY GROUPING SETS ((n.day, q.oid, q.pid, q.st), (n.day, q.pid, q.st))"""))
def _(b):
    t = J.placed(b.norm().filter("n_ev_30d > 0").select("ch", F.col("day").cast("string").alias("day")), b.channels(), b.objects())
    return t.groupingSets([["day", "oid", "pid", "st"], ["day", "pid", "st"]], "day", "oid", "pid", "st").agg(F.count(F.lit(1)).alias("n_act"))


@query("a05_mass_hours", sql("link", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hr FROM link GROUP BY 1 HAVING count(DISTINCT ch) >= 3"))
def _(b):
    return J.mass_hours(b.link(), b.spec).select(secs("hr"))


@query("a08_bounded_sorted_list", sql("geff", "SELECT ch, ts::DATE::VARCHAR AS day, array_to_string(list_sort(list(gap_eff_s), 'DESC'), ',') AS gl FROM geff WHERE ts IS NOT NULL GROUP BY 1, 2"))
def _(b):
    g = b.gaps_eff().filter(F.col("ts").isNotNull()).groupBy("ch", F.to_date("ts").cast("string").alias("day"))
    return g.agg(F.array_join(F.sort_array(F.collect_list("gap_eff_s"), asc=False).cast("array<string>"), ",").alias("gl"))


@query("a12_latest_by", sql("ev", "SELECT ch, epoch(max(ts))::BIGINT AS ts, arg_max(event_id, {'t': ts, 'r': raw}) AS event_id FROM ev GROUP BY 1"))
def _(b):
    from lullwatch.operators.ranking import latest_by
    return latest_by(b.events(), ["ch"], ["ts", "raw"], ["ts", "event_id"]).select("ch", secs("ts"), "event_id")


@query("s03_read_events", sql("ev", "SELECT event_id, raw FROM ev WHERE year(ts) >= 2024"))
def _(b):
    from lullwatch.sources.parquet import read_events, write_events
    from lullwatch.session import shared_dir
    path = f"{shared_dir(b.spark)}/journal-{b.dir.strip('/').replace('/', '_')}"
    write_events(b.events().select("event_id", "ch", "ts", "is_alarm", "raw", "kind", "num", "txt"), path)
    return read_events(b.spark, path, 2024).select("event_id", "raw")


@query("s05_union_by_name", sql("preds", """SELECT id, CASE WHEN "at" >= TIMESTAMP '2024-01-15' THEN p_link END AS p_link FROM preds"""))
def _(b):
    from lullwatch.sources.parquet import read_predictions
    from lullwatch.session import shared_dir
    base = f"{shared_dir(b.spark)}/preds-{b.dir.strip('/').replace('/', '_')}"
    p = b.predictions()
    p.filter(F.col("at") < "2024-01-15").select("id", "prob").write.mode("overwrite").parquet(f"{base}/old")
    p.filter(F.col("at") >= "2024-01-15").select("id", "p_link").write.mode("overwrite").parquet(f"{base}/new")
    return read_predictions(b.spark, [f"{base}/old", f"{base}/new"]).select("id", "p_link")


@query("s12_slice_counts", sql("preds faults chn", """SELECT 'predictions' AS table_name, count(*) AS rows FROM preds WHERE "at" >= TIMESTAMP '2024-01-12' AND "at" < TIMESTAMP '2024-01-16'
  UNION ALL SELECT 'faults', count(*) FROM faults WHERE ts >= TIMESTAMP '2024-01-12' - INTERVAL 3 DAY AND ts < TIMESTAMP '2024-01-16' UNION ALL SELECT 'channels', count(*) FROM chn"""))
def _(b):
    from lullwatch.sources.slices import manifest, slice_tables
    t = slice_tables({"predictions": (b.predictions(), "at", 0), "faults": (b.faults(), "ts", 3), "channels": (b.channels(), None, 0)}, "2024-01-12", "2024-01-15")
    return manifest(t).select("table_name", "rows")


# ---- linear scheme


@query("g01_f13_pickets", sql("chn", r"""SELECT id, CASE WHEN sensor_type IN ('BUILDING', 'HOUSEHOLD') THEN (id % 500) * 10.0 + id % 10 WHEN sensor_type = 'MACHINERY' THEN (id % 300) * 10.0 END::DOUBLE AS main_m,
  CASE WHEN sensor_type = 'MACHINERY' THEN (id % 4)::VARCHAR END AS gallery, CASE WHEN sensor_type = 'MACHINERY' THEN (id % 40) * 10.0 END::DOUBLE AS gallery_m FROM chn"""))
def _(b):
    return parse_pickets(b.channels()).select("id", "main_m", "gallery", "gallery_m")


cte("loc", "chn clo obj", r"""SELECT c.*, l.ancestor_id AS complex_id, CASE WHEN sensor_type IN ('BUILDING', 'HOUSEHOLD') THEN (c.id % 500) * 10.0 + c.id % 10 WHEN sensor_type = 'MACHINERY' THEN (c.id % 300) * 10.0 END::DOUBLE AS main_m,
  CASE WHEN sensor_type = 'MACHINERY' THEN (c.id % 4)::VARCHAR END AS gallery, CASE WHEN sensor_type = 'MACHINERY' THEN (c.id % 40) * 10.0 END::DOUBLE AS gallery_m
  FROM chn c JOIN clo l ON l.id = c.object_id JOIN obj o ON o.id = l.ancestor_id AND o.level = 2""")
cte("gal", "loc", "SELECT complex_id, gallery, main_m AS anchor_m, gallery::INT % 2 = 1 AS up, greatest(max(gallery_m) + 10, 30) AS length_m FROM loc WHERE gallery IS NOT NULL GROUP BY ALL")
cte("lane", "loc gal", """SELECT complex_id, length_m, -(coalesce(sum(u + d) OVER (ORDER BY complex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + u) AS y0 FROM (
  SELECT l.complex_id, greatest(coalesce(max(main_m), 0) + 20, 100) AS length_m,
    coalesce((SELECT max(length_m) FROM gal g WHERE g.complex_id = l.complex_id AND up), 0) + 150 AS u, coalesce((SELECT max(length_m) FROM gal g WHERE g.complex_id = l.complex_id AND NOT up), 0) + 150 AS d
  FROM loc l GROUP BY 1)""")
cte("placed", "loc lane", """SELECT id, complex_id, placed_by, px + (k % 4) * 1.5 AS x, py + floor(k / 4) * 1.5 * CASE WHEN py >= y0 THEN 1 ELSE -1 END AS y FROM (
   SELECT *, row_number() OVER (PARTITION BY complex_id, round(px, 1), round(py, 1) ORDER BY id) - 1 AS k FROM (
     SELECT l.id, l.complex_id, n.y0, main_m AS px, CASE WHEN gallery IS NULL THEN 'picket' ELSE 'gallery' END AS placed_by,
       CASE WHEN gallery IS NULL THEN n.y0 ELSE n.y0 + CASE WHEN gallery::INT % 2 = 1 THEN 1 ELSE -1 END * greatest(gallery_m, 2) END AS py FROM loc l JOIN lane n ON n.complex_id = l.complex_id WHERE main_m IS NOT NULL))
  UNION ALL SELECT id, complex_id, 'node', -60 - (j % 6) * 4.0, y0 - i * 25 - floor(j / 6) * 4.0 FROM (
   SELECT l.id, l.complex_id, n.y0, dense_rank() OVER (PARTITION BY l.complex_id ORDER BY l.object_id) - 1 AS i, row_number() OVER (PARTITION BY l.object_id ORDER BY l.id) - 1 AS j
   FROM loc l JOIN lane n ON n.complex_id = l.complex_id WHERE main_m IS NULL)""")


def _loc(b):
    return G.located(b.channels(), b.objects())


@query("g03_galleries", sql("gal", "SELECT complex_id, gallery, anchor_m, up, length_m::DOUBLE AS length_m FROM gal"))
def _(b):
    return G.galleries(_loc(b))


@query("g04_lanes", sql("lane", "SELECT complex_id, length_m::DOUBLE AS length_m, y0::DOUBLE AS y0 FROM lane"))
def _(b):
    return G.lanes(_loc(b))


@query("g05_places", sql("placed", "SELECT id, complex_id, placed_by, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y FROM placed"))
def _(b):
    return G.place(_loc(b)).select("id", "complex_id", "placed_by", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("g06_sections", sql("loc", "SELECT complex_id, object_id, min(main_m) AS x0, max(main_m) AS x1 FROM loc WHERE main_m IS NOT NULL GROUP BY 1, 2"))
def _(b):
    return G.sections(_loc(b))


@query("g06_stats", sql("loc gal chn", """SELECT count(*) FILTER (WHERE main_m IS NOT NULL AND gallery IS NULL) AS on_axis, count(gallery) AS in_gallery, count(*) FILTER (WHERE main_m IS NULL) AS in_node,
  (SELECT count(*) FROM chn) AS channels, count(main_m) AS with_picket, (SELECT count(*) FROM chn) - count(*) AS without_complex, (SELECT count(*) FROM gal) AS galleries FROM loc"""))
def _(b):
    return G.stats(b.channels(), _loc(b))


@query("g07_problem_zones", sql("placed preds", """SELECT complex_id, min(x)::DOUBLE AS x_from, max(x)::DOUBLE AS x_to, count(*) AS size, count(*) FILTER (WHERE risk_level = 'critical') AS critical, round(max(prob), 4) AS max_prob FROM (
   SELECT *, sum(brk) OVER (PARTITION BY complex_id ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS z FROM (
     SELECT p.*, r.risk_level, r.prob, coalesce((x - lag(x) OVER (PARTITION BY complex_id ORDER BY x, p.id) > 50)::INT, 0) AS brk FROM placed p
     JOIN (SELECT channel_id, arg_max(risk_level, prob * 1000 + epoch("at") / 1e12) AS risk_level, max(prob) AS prob FROM preds WHERE risk_level IN ('risk', 'critical') GROUP BY 1) r ON r.channel_id = p.id
     WHERE placed_by = 'picket')) GROUP BY complex_id, z HAVING count(*) >= 2"""))
def _(b):
    r = b.predictions().filter(F.col("risk_level").isin("risk", "critical")).groupBy(F.col("channel_id").alias("id")).agg(
        F.max("prob").alias("prob"), F.max_by("risk_level", F.col("prob") * 1000 + F.unix_timestamp("at") / 1e12).alias("risk_level"))
    return G.problem_zones(G.place(_loc(b)), r)


@query("g08_f17_channel_features", sql("placed", """SELECT id, 'POINT (' || regexp_replace(round(x, 1)::DOUBLE::VARCHAR, '\\.0$', '') || ' ' || regexp_replace(round(y, 1)::DOUBLE::VARCHAR, '\\.0$', '') || ')' AS wkt FROM placed""".replace("\\\\", "\\")))
def _(b):
    return G.channel_features(G.place(_loc(b))).select("id", "wkt")


@query("g08_line_features")
def _(b):
    return G.line_features(_loc(b))


_NUM = "regexp_replace(round({}, 1)::DOUBLE::VARCHAR, '\\.0$', '')"
_WORST = """(SELECT channel_id, arg_max(risk_level, prob * 1000 + epoch("at") / 1e12) AS risk_level, max(prob) AS prob FROM preds WHERE risk_level IN ('risk', 'critical') GROUP BY 1)"""


def _worst(b):
    return b.predictions().filter(F.col("risk_level").isin("risk", "critical")).groupBy(F.col("channel_id").alias("id")).agg(
        F.max("prob").alias("prob"), F.max_by("risk_level", F.col("prob") * 1000 + F.unix_timestamp("at") / 1e12).alias("risk_level"))


@query("g08_node_features", sql("loc lane", f"""SELECT 'node' AS kind, complex_id, object_id::VARCHAR AS key, 'POINT (-60 ' || {_NUM.format("y0 - i * 25")} || ')' AS wkt FROM (
  SELECT DISTINCT l.complex_id, l.object_id, n.y0, dense_rank() OVER (PARTITION BY l.complex_id ORDER BY l.object_id) - 1 AS i FROM loc l JOIN lane n ON n.complex_id = l.complex_id WHERE main_m IS NULL)"""))
def _(b):
    return G.node_features(_loc(b)).select("kind", "complex_id", "key", "wkt")


@query("g08_zone_features", sql("placed preds lane obj", f"""SELECT z.complex_id, o.name || ': ПК' || floor(x_from / 10)::INT || '–ПК' || floor(x_to / 10)::INT AS key,
  'LINESTRING (' || {_NUM.format("x_from - 10")} || ' ' || {_NUM.format("y0")} || ', ' || {_NUM.format("x_to + 10")} || ' ' || {_NUM.format("y0")} || ')' AS wkt, channels, critical, max_prob FROM (
  SELECT complex_id, min(x)::DOUBLE AS x_from, max(x)::DOUBLE AS x_to, count(*) AS channels, count(*) FILTER (WHERE risk_level = 'critical') AS critical, round(max(prob), 4) AS max_prob FROM (
   SELECT *, sum(brk) OVER (PARTITION BY complex_id ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS z FROM (
     SELECT p.*, r.risk_level, r.prob, coalesce((x - lag(x) OVER (PARTITION BY complex_id ORDER BY x, p.id) > 50)::INT, 0) AS brk FROM placed p JOIN {_WORST} r ON r.channel_id = p.id
     WHERE placed_by = 'picket')) GROUP BY complex_id, z HAVING count(*) >= 2) z JOIN lane n ON n.complex_id = z.complex_id LEFT JOIN obj o ON o.id = z.complex_id"""))
def _(b):
    loc = _loc(b)
    return G.zone_features(loc, G.place(loc), _worst(b), b.objects()).select("complex_id", "key", "wkt", "channels", "critical", "max_prob")


@query("g08_collector_facts", sql("placed preds lane gal obj", f"""SELECT n.complex_id, round(n.length_m, 1)::DOUBLE AS length_m, floor(n.length_m / 10)::INT AS pk_max, o.name, coalesce(g.n, 0) AS galleries, coalesce(c.channels, 0) AS channels,
  coalesce(c.risk, 0) AS risk, coalesce(c.critical, 0) AS critical, CASE WHEN c.critical > 0 THEN 'critical' WHEN c.risk > 0 THEN 'risk' END AS max_risk_level FROM lane n LEFT JOIN obj o ON o.id = n.complex_id
  LEFT JOIN (SELECT complex_id, count(*) AS n FROM gal GROUP BY 1) g ON g.complex_id = n.complex_id
  LEFT JOIN (SELECT p.complex_id, count(*) AS channels, count(*) FILTER (WHERE r.risk_level = 'risk') AS risk, count(*) FILTER (WHERE r.risk_level = 'critical') AS critical FROM placed p LEFT JOIN {_WORST} r ON r.channel_id = p.id GROUP BY 1) c
  ON c.complex_id = n.complex_id"""))
def _(b):
    loc = _loc(b)
    return G.collector_facts(loc, G.place(loc), _worst(b), b.objects()).select("complex_id", "length_m", "pk_max", "name", "galleries", "channels", "risk", "critical", "max_risk_level")


@query("g08_scheme_features")
def _(b):
    loc = _loc(b)
    return G.scheme_features(loc, G.place(loc), _worst(b), b.objects())
