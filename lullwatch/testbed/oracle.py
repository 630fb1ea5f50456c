"""The same journal as named DuckDB sub-queries; a check lists the ones it needs."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTE[name] = (tuple(needs.split()), text)


def sql(needs: str, body: str) -> str:
    """``WITH`` the needed sub-queries (in dependency order) and the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTE[name][0]:
                visit(dep)
            order.append(name)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order) + "\n" + body


cte("chn", "", """
 SELECT c_custkey AS id, c_nationkey::BIGINT AS object_id, c_mktsegment AS sensor_type,
   CASE c_mktsegment WHEN 'MACHINERY' THEN 'GAS_GUARD' WHEN 'BUILDING' THEN 'FIRE_GUARD' WHEN 'AUTOMOBILE' THEN 'SECURITY'
        ELSE 'OTHER' END AS system_type,
   CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'ДД ПК' || (c_custkey % 500) || '+' || (c_custkey % 10)
        WHEN c_mktsegment = 'MACHINERY' THEN 'КД ПК' || (c_custkey % 300) || ' Г' || (c_custkey % 4) || ' ПК' || (c_custkey % 40)
        ELSE c_name END AS name,
   c_nationkey || '-' || (c_custkey % 7) || '.' || (c_custkey % 100) || '.' || c_custkey || '.' AS tag
 FROM customer""")
cte("obj", "", """
 SELECT 100000::BIGINT AS id, 1 AS level, NULL::BIGINT AS parent_id, 'ROOT' AS name
 UNION ALL SELECT (r_regionkey + 1000)::BIGINT, 2, 100000, r_name FROM region
 UNION ALL SELECT n_nationkey::BIGINT, 3, n_regionkey + 1000, n_name FROM nation""")
cte("clo", "obj", """
 SELECT id AS ancestor_id, id, 0 AS distance FROM obj
 UNION ALL SELECT parent_id, id, 1 FROM obj WHERE parent_id IS NOT NULL
 UNION ALL SELECT p.parent_id, o.id, 2 FROM obj o JOIN obj p ON p.id = o.parent_id WHERE p.parent_id IS NOT NULL""")
cte("rawj", "", """
 SELECT event_id, user_id AS ch, date_trunc('second', ts) AS ts,
   CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND value >= 150) THEN 't' ELSE 'f' END AS alarm_raw,
   CASE WHEN event_type = 'error' THEN CASE WHEN value < 40 THEN 'FAULT' WHEN value < 100 THEN 'DISCONNECTED'
                                            ELSE '01.01.1970 03:00:00' END
        WHEN event_type = 'signup' THEN CASE WHEN value < 30 THEN 'POWER_OFF' WHEN value < 60 THEN 'UNCERTAIN'
                                             WHEN value < 120 THEN 'OK' ELSE 'GAS' END
        ELSE value::VARCHAR END AS raw
 FROM events""")
cte("ev", "rawj chn", r"""
 SELECT d.*, CASE WHEN kind = 'number' THEN x END AS num, CASE WHEN kind = 'status' THEN raw END AS txt FROM (
   SELECT j.*, c.sensor_type AS st, try_cast(replace(raw, ',', '.') AS DOUBLE) AS x,
     CASE WHEN regexp_matches(raw, '^\s*\d{2}\.\d{2}\.\d{4}( \d{1,2}:\d{2}(:\d{2})?)?\s*$') THEN 'date_value'
          WHEN try_cast(replace(raw, ',', '.') AS DOUBLE) IS NULL THEN 'status'
          WHEN try_cast(replace(raw, ',', '.') AS DOUBLE) IN (-127, -100, 255, 327.68, -3276.8, -3276, 3276.7, 32767, -32768, 65535)
            OR abs(try_cast(replace(raw, ',', '.') AS DOUBLE)) >= 1000
            OR (c.id IS NOT NULL AND (try_cast(replace(raw, ',', '.') AS DOUBLE) < 0 OR try_cast(replace(raw, ',', '.') AS DOUBLE) > 200))
          THEN 'sentinel' ELSE 'number' END AS kind
   FROM (SELECT ch, ts, raw, min(event_id) AS event_id, bool_or(alarm_raw IN ('t','true')) AS is_alarm, count(*) AS dup_n
         FROM rawj WHERE raw <> '' GROUP BY 1, 2, 3) j LEFT JOIN chn c ON c.id = j.ch) d""")
cte("evl", "ev", """
 SELECT e.*, coalesce(st = 'MACHINERY', false) AS is_gas, (isodow(ts) < 6 AND hour(ts) >= 9 AND hour(ts) <= 13) AS work,
   lag(ts) OVER o AS prev_ts,
   last_value(num IGNORE NULLS) OVER p AS prev_num, last_value(txt IGNORE NULLS) OVER p AS prev_txt
 FROM ev e WINDOW o AS (PARTITION BY ch ORDER BY ts, raw),
   p AS (PARTITION BY ch ORDER BY ts, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("hourly", "evl", """
 SELECT ch, date_trunc('hour', ts) AS hour, count(*)::INT AS n_ev,
   count(*) FILTER (WHERE txt = 'FAULT')::INT AS n_fault, count(*) FILTER (WHERE txt = 'DISCONNECTED')::INT AS n_disc,
   count(*) FILTER (WHERE txt = 'UNCERTAIN')::INT AS n_unc, count(*) FILTER (WHERE txt = 'POWER_OFF')::INT AS n_off,
   count(*) FILTER (WHERE is_alarm)::INT AS n_alarm, count(txt)::INT AS n_txt,
   count(*) FILTER (WHERE txt <> prev_txt)::INT AS n_chg, count(num)::INT AS n_num, sum(num) AS s_v, sum(num * num) AS s_v2,
   count(*) FILTER (WHERE num = prev_num)::INT AS n_same, min(num) AS v_min, max(num) AS v_max,
   count(*) FILTER (WHERE kind = 'sentinel')::INT AS n_sent, count(*) FILTER (WHERE kind = 'date_value')::INT AS n_date,
   count(*) FILTER (WHERE kind = 'date_value' AND starts_with(raw, '01.01.1970'))::INT AS n_date1970,
   count(*) FILTER (WHERE is_gas AND num >= 50 AND work)::INT AS n_gas1_wk, count(*) FILTER (WHERE is_gas AND num >= 50 AND NOT work)::INT AS n_gas1_off,
   count(*) FILTER (WHERE is_gas AND num >= 100)::INT AS n_gas5, count(*) FILTER (WHERE txt = 'GAS')::INT AS n_gasdet,
   max(ts) AS last_ts, max(epoch(ts) - epoch(prev_ts))::INT AS max_gap_s
 FROM evl GROUP BY 1, 2""")
cte("gaps", "evl", """
 SELECT ch, prev_ts, ts, (epoch(ts) - epoch(prev_ts))::BIGINT AS gap_s FROM evl WHERE epoch(ts) - epoch(prev_ts) >= 3600
 UNION ALL SELECT ch, max(ts), NULL, NULL FROM evl GROUP BY ch""")
cte("outages", "hourly", """
 SELECT min(hour) AS o_start, max(hour) + INTERVAL 1 HOUR AS o_end, count(*) AS hours, sum(n)::BIGINT AS events FROM (
   SELECT hour, n, epoch(hour) / 3600 - row_number() OVER (ORDER BY hour) AS island FROM (
     SELECT c.hour, coalesce(t.n, 0) AS n,
       median(coalesce(t.n, 0)) OVER (ORDER BY c.hour ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS med
     FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS hour) c
     LEFT JOIN (SELECT hour, sum(n_ev) AS n FROM hourly GROUP BY 1) t ON t.hour = c.hour)
   WHERE n < 0.5 * med) GROUP BY island""")
cte("geff", "gaps outages", """
 SELECT g.ch, g.prev_ts, g.ts, g.ts_end, coalesce(x.s, 0)::BIGINT AS outage_s,
   (epoch(g.ts_end) - epoch(g.prev_ts))::BIGINT - coalesce(x.s, 0)::BIGINT AS gap_eff_s
 FROM (SELECT *, coalesce(ts, TIMESTAMP '2024-01-31') AS ts_end FROM gaps) g
 LEFT JOIN (SELECT g2.ch, g2.prev_ts, sum(epoch(least(coalesce(g2.ts, TIMESTAMP '2024-01-31'), o_end))
                                          - epoch(greatest(g2.prev_ts, o_start))) AS s
            FROM gaps g2 JOIN outages o ON o_start < coalesce(g2.ts, TIMESTAMP '2024-01-31') AND o_end > g2.prev_ts
            GROUP BY 1, 2) x ON x.ch = g.ch AND x.prev_ts = g.prev_ts""")
cte("norm", "hourly geff", """
 SELECT ch, day, n_ev, max_gap_s, n_ev_30d,
   greatest(21600, coalesce(list_sort(flatten(past), 'DESC')[floor(0.01 * n_ev_30d)::INT + 1], 0))::BIGINT AS norm_s FROM (
   SELECT *, coalesce(sum(n_ev) OVER w, 0)::INT AS n_ev_30d, list(gl) OVER w AS past FROM (
     SELECT g.ch, g.day, coalesce(e.n_ev, 0)::INT AS n_ev, e.max_gap_s, coalesce(p.gl, []) AS gl
     FROM (SELECT ch, unnest(generate_series(min(hour)::DATE::TIMESTAMP, TIMESTAMP '2024-01-30', INTERVAL 1 DAY))::DATE AS day
           FROM hourly GROUP BY ch) g
     LEFT JOIN (SELECT ch, hour::DATE AS day, sum(n_ev) AS n_ev, max(max_gap_s) AS max_gap_s FROM hourly GROUP BY 1, 2) e
       ON e.ch = g.ch AND e.day = g.day
     LEFT JOIN (SELECT ch, ts::DATE AS day, list(gap_eff_s) AS gl FROM geff WHERE ts IS NOT NULL AND gap_eff_s >= 21600
                GROUP BY 1, 2) p ON p.ch = g.ch AND p.day = g.day)
   WINDOW w AS (PARTITION BY ch ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""")
cte("link", "geff norm outages", """
 SELECT ch, prev_ts, ts_end, gap_eff_s, norm_s, ts FROM (
   SELECT l.ch, l.prev_ts, l.ts_end, l.gap_eff_s, l.norm_s, l.onset + to_seconds(coalesce(sum(
       CASE WHEN o_start < l.onset THEN epoch(least(o_end, l.ts_end)) - epoch(greatest(o_start, l.prev_ts)) END), 0)::BIGINT) AS ts
   FROM (SELECT g.*, n.norm_s, g.prev_ts + to_seconds(n.norm_s) AS onset FROM geff g
         JOIN norm n ON n.ch = g.ch AND n.day = g.prev_ts::DATE AND n.n_ev_30d > 0 AND g.gap_eff_s > n.norm_s) l
   LEFT JOIN outages o ON o_start < l.ts_end AND o_end > l.prev_ts
   GROUP BY l.ch, l.prev_ts, l.ts_end, l.gap_eff_s, l.norm_s, l.onset) WHERE ts < TIMESTAMP '2024-01-31'""")
cte("vfail", "evl", """
 SELECT ch, ts, is_alarm, raw,
   CASE WHEN kind = 'date_value' THEN CASE WHEN starts_with(raw, '01.01.1970') THEN 'date_1970' ELSE 'date_current' END
        WHEN is_gas AND (kind = 'sentinel' OR (num >= 100 AND NOT is_alarm)) THEN 'gas_anomaly'
        WHEN is_alarm THEN 'sentinel_alarm' ELSE 'sentinel' END AS sub
 FROM evl WHERE kind IN ('sentinel', 'date_value') OR (is_gas AND num >= 100 AND NOT is_alarm)""")
cte("cand", "ev link vfail", """
 SELECT row_number() OVER () AS fid, * FROM (
   SELECT ch, ts, txt AS kind, NULL::VARCHAR AS sub, is_alarm, false AS mass, ts AS silent_from FROM ev
   WHERE txt IN ('FAULT', 'DISCONNECTED')
   UNION ALL SELECT ch, ts, 'LINK_LOSS', NULL, NULL, date_trunc('hour', ts) IN (
     SELECT date_trunc('hour', ts) FROM link GROUP BY 1 HAVING count(DISTINCT ch) >= 3), prev_ts FROM link
   UNION ALL SELECT ch, ts, 'VALUE_FAILURE', sub, is_alarm, false, ts FROM vfail
   WHERE sub IN ('date_1970', 'gas_anomaly', 'sentinel_alarm'))""")
cte("place", "chn obj", "SELECT c.id AS ch, o.id AS oid, o.parent_id AS pid, c.sensor_type AS st FROM chn c JOIN obj o ON o.id = c.object_id")
cte("fgrp", "cand place link norm", """
 SELECT f.*, p.oid, p.pid, p.st,
   (SELECT count(DISTINCT l.ch) FROM link l JOIN place q ON q.ch = l.ch WHERE l.gap_eff_s >= 86400 AND q.oid = p.oid AND q.st = p.st
     AND l.prev_ts >= f.silent_from - INTERVAL 12 HOUR AND l.prev_ts <= f.silent_from + INTERVAL 12 HOUR) AS n_sil_obj,
   (SELECT count(DISTINCT l.ch) FROM link l JOIN place q ON q.ch = l.ch WHERE l.gap_eff_s >= 86400 AND q.pid = p.pid AND q.st = p.st
     AND l.prev_ts >= f.silent_from - INTERVAL 12 HOUR AND l.prev_ts <= f.silent_from + INTERVAL 12 HOUR) AS n_sil_par,
   ao.n AS n_act_obj, ap.n AS n_act_par
 FROM cand f JOIN place p ON p.ch = f.ch
 LEFT JOIN (SELECT n.day, q.oid, q.st, count(*) AS n FROM norm n JOIN place q ON q.ch = n.ch WHERE n.n_ev_30d > 0 GROUP BY 1, 2, 3) ao
   ON ao.day = f.silent_from::DATE AND ao.oid = p.oid AND ao.st = p.st
 LEFT JOIN (SELECT n.day, q.pid, q.st, count(*) AS n FROM norm n JOIN place q ON q.ch = n.ch WHERE n.n_ev_30d > 0 GROUP BY 1, 2, 3) ap
   ON ap.day = f.silent_from::DATE AND ap.pid = p.pid AND ap.st = p.st""")
cte("zall", "norm place outages", """
 SELECT n.day, q.oid, q.pid, q.st, n.n_ev FROM norm n JOIN place q ON q.ch = n.ch
 WHERE n.n_ev_30d >= 7 AND n.day NOT IN (SELECT unnest(generate_series(o_start::DATE::TIMESTAMP, o_end::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE
                                         FROM outages WHERE epoch(o_end) - epoch(o_start) >= 3600)""")
cte("zo", "zall", """
 SELECT day, oid, st, lag(day) OVER w AS d0, lead(day) OVER w AS d1 FROM (
   SELECT day, oid, st FROM zall GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE n_ev = 0) >= 3 AND count(*) FILTER (WHERE n_ev = 0) >= 0.3 * count(*))
 WINDOW w AS (PARTITION BY oid, st ORDER BY day)""")
cte("zp", "zall", """
 SELECT day, pid, st, lag(day) OVER w AS d0, lead(day) OVER w AS d1 FROM (
   SELECT day, pid, st FROM zall GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE n_ev = 0) >= 3 AND count(*) FILTER (WHERE n_ev = 0) >= 0.3 * count(*))
 WINDOW w AS (PARTITION BY pid, st ORDER BY day)""")
cte("faults", "fgrp zo zp outages", """
 SELECT ch, ts, kind, sub, is_alarm, mass, silent_from, n_sil_obj, n_act_obj, n_sil_par, n_act_par, grp_onset, grp_day,
   grp_onset OR grp_day AS grp, EXISTS (SELECT 1 FROM outages WHERE ts >= o_start AND ts < o_end) AS in_outage
 FROM (SELECT f.*, coalesce((n_sil_obj >= 3 AND n_sil_obj >= 0.3 * n_act_obj) OR (n_sil_par >= 3 AND n_sil_par >= 0.3 * n_act_par), false) AS grp_onset,
   EXISTS (SELECT 1 FROM zo z WHERE (z.day - z.d0 = 1 OR z.d1 - z.day = 1) AND z.oid = f.oid AND z.st = f.st
           AND (z.day = f.ts::DATE OR z.day = f.ts::DATE + 1))
   OR EXISTS (SELECT 1 FROM zp z WHERE (z.day - z.d0 = 1 OR z.d1 - z.day = 1) AND z.pid = f.pid AND z.st = f.st
           AND (z.day = f.ts::DATE OR z.day = f.ts::DATE + 1)) AS grp_day
   FROM fgrp f)""")
cte("pulse", "norm", """SELECT ch, day, norm_s, n_ev_30d, max(max_gap_s) OVER a AS max_gap_7d, max(max_gap_s) OVER b AS max_gap_30d,
  sum((n_ev = 0)::INT) OVER b AS zero_days_30d, stddev_pop(n_ev) OVER b / nullif(avg(n_ev) OVER b, 0) AS daily_cv_30d,
  least(row_number() OVER (PARTITION BY ch ORDER BY day) - 1, 365) AS history_days FROM norm
  WINDOW a AS (PARTITION BY ch ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY ch ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")

# ---- predictions, decisions, orders
cte("pmoment", "norm", """SELECT ch, unnest(generate_series(day::TIMESTAMP, day::TIMESTAMP + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS t FROM norm
 WHERE n_ev_30d > 0 AND day >= DATE '2024-01-08' AND day < DATE '2024-01-30'""")
cte("pclean", "faults", """SELECT ch, ts, kind FROM faults WHERE NOT mass AND NOT grp AND NOT in_outage
  AND (kind <> 'VALUE_FAILURE' OR sub IN ('date_1970', 'gas_anomaly'))""")
cte("pfault", "pmoment pclean", """SELECT m.ch, m.t, min(f.ts) FILTER (WHERE f.ts > t) AS nx, min({'ts': f.ts, 'kind': f.kind}) FILTER (WHERE f.ts > t).kind AS nk,
 count(*) FILTER (WHERE f.ts <= t AND f.ts > t - INTERVAL 24 HOUR) AS fall_24h, count(*) FILTER (WHERE f.ts <= t AND f.ts > t - INTERVAL 48 HOUR) AS fall_7d,
 count(*) FILTER (WHERE f.kind = 'LINK_LOSS' AND f.ts <= t AND f.ts > t - INTERVAL 168 HOUR) AS k_link,
 count(*) FILTER (WHERE f.kind = 'FAULT' AND f.ts <= t AND f.ts > t - INTERVAL 168 HOUR) AS k_fault,
 count(*) FILTER (WHERE f.kind = 'DISCONNECTED' AND f.ts <= t AND f.ts > t - INTERVAL 168 HOUR) AS k_disc,
 count(*) FILTER (WHERE f.kind = 'VALUE_FAILURE' AND f.ts <= t AND f.ts > t - INTERVAL 168 HOUR) AS k_value
 FROM pmoment m LEFT JOIN pclean f ON f.ch = m.ch GROUP BY 1, 2""")
cte("pev", "pmoment hourly", """SELECT m.ch, m.t, coalesce(sum(n_ev) FILTER (WHERE h.hour >= t - INTERVAL 48 HOUR), 0)::BIGINT AS ev_7d,
 coalesce(sum(n_chg) FILTER (WHERE h.hour >= t - INTERVAL 24 HOUR), 0)::BIGINT AS chg_24h, coalesce(sum(n_fault), 0)::BIGINT AS fault_30d
 FROM pmoment m LEFT JOIN hourly h ON h.ch = m.ch AND h.hour < m.t AND h.hour >= m.t - INTERVAL 168 HOUR GROUP BY 1, 2""")
cte("preds", "pfault pev", """SELECT *, CASE WHEN health >= 80 THEN 'normal' WHEN health >= 50 THEN 'attention' WHEN health >= 20 THEN 'risk' ELSE 'critical' END AS risk_level
 FROM (SELECT *, round_even(100 * (1 - prob), 0)::INT AS health FROM (
  SELECT (epoch(f.t) / 3600)::BIGINT * 1000000000 + f.ch AS id, f.ch AS channel_id, f.t AS "at", 24 AS horizon_h, 'v3' AS model_version,
  least(9900, 200 + 2500 * least(fall_24h, 2) + 900 * fall_7d + 60 * ev_7d + 400 * fault_30d) / 10000.0::DOUBLE AS prob,
  fall_24h, fall_7d, ev_7d, chg_24h, fault_30d,
  (k_link + 1) / (k_link + k_fault + k_disc + k_value + 4) AS p_link, (k_fault + 1) / (k_link + k_fault + k_disc + k_value + 4) AS p_fault,
  (k_disc + 1) / (k_link + k_fault + k_disc + k_value + 4) AS p_disconnected, (k_value + 1) / (k_link + k_fault + k_disc + k_value + 4) AS p_value,
  CASE WHEN f.t + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31' THEN coalesce(nx <= f.t + INTERVAL 24 HOUR, false) END AS happened,
  CASE WHEN f.t + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31' AND nx <= f.t + INTERVAL 24 HOUR THEN nx END AS fault_at,
  CASE WHEN f.t + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31' AND nx <= f.t + INTERVAL 24 HOUR THEN nk END AS fault_kind
  FROM pfault f JOIN pev e ON e.ch = f.ch AND e.t = f.t))""")
cte("scored", "preds chn", """SELECT p."at" AS t, p.channel_id AS ch, p.prob AS p, p.happened::INT AS y, p.fault_at, p.fault_kind, c.sensor_type, c.system_type,
 p.fall_7d AS faults_7d, p.ev_7d, p.chg_24h, p.fault_30d, p.fall_24h FROM preds p JOIN chn c ON c.id = p.channel_id WHERE p.happened IS NOT NULL""")
cte("ord", "", """SELECT *, floor(epoch(created_at) / 21600)::BIGINT * 6 * 1000000000 + o_custkey AS pred, o_orderpriority[1]::INT AS pri
 FROM (SELECT *, TIMESTAMP '2024-01-08' + to_minutes((o_orderkey * 7919) % 31680) AS created_at FROM orders)""")
cte("decisions", "ord preds", """SELECT o_orderkey AS id, pred AS prediction_id,
 CASE o_orderstatus WHEN 'F' THEN 'dispatch' WHEN 'O' THEN 'monitor' ELSE 'false_alarm' END AS decision_type, pri AS reason_id, created_at,
 '=' || o_orderpriority AS comment FROM ord WHERE pred IN (SELECT id FROM preds)""")
cte("reasons", "ord", """SELECT DISTINCT pri AS id, o_orderpriority AS name, CASE WHEN pri <= 2 THEN 'dispatch' WHEN pri = 3 THEN 'monitor' ELSE 'false_alarm' END AS decision_type,
 pri < 5 AS is_active FROM ord""")
cte("wo", "ord chn", """SELECT o.o_orderkey AS id, 'WO-' || o.o_orderkey AS number, o.o_custkey AS channel_id, o.pred AS prediction_id,
 CASE pri WHEN 1 THEN 'done' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'submitted' WHEN 4 THEN 'draft' ELSE 'cancelled' END AS status, o.created_at,
 CASE WHEN pri IN (1, 5) THEN o.created_at + to_hours(floor(o_totalprice)::BIGINT % 100 + 1) END AS closed_at,
 CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS priority, c.object_id FROM ord o JOIN chn c ON c.id = o.o_custkey""")
