"""Golden cases of the journal domain."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lullwatch.functions import risk, text, values
from lullwatch.functions.pickets import parse_pickets
from lullwatch.plans import advice as A
from lullwatch.plans import features as X
from lullwatch.plans import journal as J
from lullwatch.plans import model as M
from lullwatch.plans import rules as R
from lullwatch.plans import scheme as G
from lullwatch.plans import serving as S
from lullwatch.sources import exports, imports, journal_csv, slices
from lullwatch.sources.parquet import read_events, write_events
from lullwatch.spec import JournalSpec, RiskBounds
from lullwatch.streaming import alerts, ingest

SPEC = JournalSpec()


def ts(text_):
    return datetime.fromisoformat(text_)


# ---- pickets and scheme

PICKETS = [
    ("Дым ПК447+5", 4475.0, None, None, None, None, None, None),
    ("ГАЗ Д34 пк2", 20.0, None, None, None, None, None, None),
    ("ДД ПК176+6,5(лев.)", 1766.5, None, None, None, None, "left", None),
    ("ГРО12 ПК113(ПК113-ПК126 прав.)", 1130.0, None, None, 1130.0, 1260.0, "right", None),
    ("ДД ПК187 - 184", 1870.0, None, None, 1840.0, 1870.0, None, None),
    ("Управление ОЗК В5 ПК44 Г1 ПК14", 440.0, "1", 140.0, None, None, None, None),
    ("КД дверь склад ПК396Г3ПК0", 3960.0, "3", 0.0, None, None, None, None),
    ("Управление В12 ПК305Гал.ПК2", 3050.0, "?", 20.0, None, None, None, None),
    ("В3 ПК53 Г.АТС ПК9 (26БК)", 530.0, "АТС", 90.0, None, None, None, None),
    ("КД АВ1 3 этаж ПК18 Гал.172", 1720.0, "?", 180.0, None, None, None, None),
    ("ДД Г1 ПК2+6", None, "1", 26.0, None, None, None, None),
    ("Н1 ПК863 Гал.1 ПК7", 8630.0, "1", 70.0, None, None, None, None),
    ("ОД развилка в Г1 ПК200", 2000.0, None, None, None, None, None, None),
    ("ОД ВШ ПК57", 570.0, None, None, None, None, None, "ВШ"),
    ("Управление ФАНС3", None, None, None, None, None, None, "АНС"),
    ("КД шкаф ОПС ДП Никулино", None, None, None, None, None, None, None),
]


def test_pickets(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PICKETS)], "i int, name string")
    got = {r.i: r for r in parse_pickets(df).collect()}
    for i, (name, main, gal, gal_m, a, b, side, feature) in enumerate(PICKETS):
        r = got[i]
        assert (r.main_m, r.gallery, r.gallery_m, r.range_from, r.range_to, r.side, r.feature) == (main, gal, gal_m, a, b, side, feature), name


def test_layout(spark):
    objects = spark.createDataFrame([(1, 1, None, "d"), (2, 2, 1, "c"), (3, 2, 1, "c2"), (4, 3, 2, "s")], "id long, level int, parent_id long, name string")
    ch = spark.createDataFrame([(1, 4, "ДД ПК10"), (2, 4, "ДД ПК10"), (3, 2, "В1 ПК44 Г1 ПК14"), (4, 4, "ДД Г1 ПК2"), (5, 4, "шкаф"),
                                (6, 3, "ГРО ПК300"), (7, 3, "ДД ПК250-ПК300 Г2 ПК1"), (8, 2, "ДД ПК5+5")], "id long, object_id long, name string")
    loc = G.located(ch, objects)
    pl = {r.id: (r.x, r.placed_by) for r in G.place(loc).collect()}
    assert pl[1] == (100.0, "picket") and pl[2] == (101.5, "picket")
    assert pl[4][0] == 440.0 and pl[5] == (-60.0, "node")
    st = G.stats(ch, loc).first()
    assert (st.channels, st.with_picket, st.on_axis, st.in_gallery, st.in_node, st.galleries) == (8, 7, 4, 3, 1, 2)
    lanes = {r.complex_id: r.length_m for r in G.lanes(loc).collect()}
    assert lanes[3] == 3020.0


# ---- events and context

GAS = replace(SPEC, gas_type="Газовый датчик")


def test_event_tags(spark):
    tue, sat = "2026-06-23 10:58:00", "2026-06-27 10:58:00"
    data = [(1, 1, ts(tue), "Обнаружен газ"), (2, 1, ts(tue), "1.4"), (3, 1, ts(tue), "0.4"), (4, 1, ts(sat), "1.4"),
            (5, 1, ts("2026-06-23 14:10:00"), "1.4"), (6, 2, ts(tue), "-127"), (7, 2, ts(tue), "01.01.1970 03:00:00"),
            (8, 1, ts(tue), "327.68"), (9, 1, ts(tue), "-0.5"), (10, 2, ts(tue), "21.5")]
    ch = spark.createDataFrame([(1, "Газовый датчик"), (2, "Датчик температуры")], "id long, sensor_type string")
    got = {r.event_id: r.tags for r in S.tag_events(spark.createDataFrame(data, "event_id int, ch long, ts timestamp, raw string"), ch, GAS).collect()}
    fail, check = ["value_failure"], ["planned_check"]
    assert got == {1: check, 2: check, 3: [], 4: [], 5: [], 6: fail, 7: fail, 8: fail, 9: fail, 10: []}


@pytest.mark.parametrize("losses,tagged", [(4, True), (1, False)])
def test_group_off(spark, losses, tagged):
    t0 = ts("2026-06-23 10:00:00")
    objects = spark.createDataFrame([(1, 1, None), (2, 2, 1), (3, 3, 2)], "id long, level int, parent_id long")
    ch = spark.createDataFrame([(i, 3, "дым") for i in range(1, 6)], "id long, object_id long, sensor_type string")
    ev = spark.createDataFrame([(1, 1, t0, "Отключено устройство")], "event_id int, ch long, ts timestamp, raw string")
    f = spark.createDataFrame([(i + 2, t0 + timedelta(hours=i + 1)) for i in range(losses)], "ch long, ts timestamp")
    got = S.tag_group_off(ev, f, ch, objects, SPEC).collect()
    assert [(r.off, r.peers) for r in got] == ([(5, 5)] if tagged else [])


def test_value_kinds(spark):
    data = [("12,5", "number"), ("Норма", "status"), ("-127", "sentinel"), ("130", "sentinel"), ("2000", "sentinel"), ("01.02.2024", "date_value"),
            ("01.01.1970 03:00:00", "date_value")]
    df = spark.createDataFrame([(raw, "Датчик температуры", k) for raw, k in data], "raw string, st string, want string")
    assert df.filter(values.value_kind(F.col("raw"), F.col("st"), SPEC) != F.col("want")).count() == 0


def test_tags_and_safe_text(spark):
    df = spark.createDataFrame([("847-1.1.131.2.", "=cmd"), ("847-1.2.140.7.", "ok")], "tag string, s string")
    r = df.select(*[text.import_tag_level(F.col("tag"), n).alias(f"l{n}") for n in range(1, 6)], text.tag_depth(F.col("tag")).alias("d"),
                  text.formula_safe(F.col("s")).alias("safe")).collect()
    assert [tuple(x) for x in r] == [("847", "1", "1", "131", "2", 5, "'=cmd"), ("847", "1", "2", "140", "7", 5, "ok")]


def test_likely_kind_breaks_ties_by_code(spark):
    df = spark.sql("SELECT map('value', 0.2D, 'link', 0.2D, 'other', 0.9D) AS m")
    r = df.select(risk.likely_kind(F.col("m"), ["link", "fault", "value"]).alias("k")).first().k
    assert (r.code, r.share) == ("link", 50)


# ---- files


def test_import_csv_cleaning(spark, tmp_path):
    f = tmp_path / "events.csv"
    f.write_text("﻿ид _события;ид_канала _данных;дата;время;тревожное;значение _датчика\n101;7;2026-08-03;10:00:00;f;Норма\n"
                 "102;7;2026-08-03;10:00:01;t;Неисправен\n103;7;2026-08-03;10:00:01;true;Неисправен\n104;7;2026-08-03;10:00:02;false;01.01.1970 03:00:00\n"
                 "105;1;2026-08-03;10:00:03;f;Норма\n106;7;03.08.2026;10:00:04;false;0,015\n", encoding="utf-8")
    channels = spark.createDataFrame([(7,)], "id long")
    rows = imports.known_channels(imports.clean_events(imports.numbered(imports.import_csv(spark, str(f), "events"))), channels)
    empty = spark.createDataFrame([], ingest.LANDING)
    new = imports.new_events(rows, empty)
    got = {r.value_raw: r.value_num for r in new.collect()}
    assert got == {"Норма": None, "Неисправен": None, "0,015": 0.015}
    assert {(r.row, r.error) for r in imports.import_report(rows).collect()} == {(5, "a date instead of a value"), (6, "channel is not in the dictionary")}
    assert imports.new_events(rows, new).count() == 0


def test_import_needs_columns(spark, tmp_path):
    f = tmp_path / "bad.csv"
    f.write_text("id,name\n1,x\n")
    with pytest.raises(ValueError, match="missing"):
        imports.import_csv(spark, str(f), "objects")


def test_import_predictions(spark):
    df = spark.createDataFrame([(2, "7", "2026-08-03T10:00:00", "0.9", "v"), (3, "7", "2026-08-03T10:00:00", "1.5", "v")],
                               "row int, channel_id string, at string, prob string, model_version string")
    r = {x.row: x for x in imports.clean_predictions(df).collect()}
    assert (r[2].health, r[2].risk_level, r[2].horizon_h, r[2].error) == (10, "critical", 24, None) and r[3].error == "prob out of range"


def test_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ts("2026-01-01 10:00:00")), (2, "", ts("2026-01-02 10:00:00"))], "id long, name string, at timestamp")
    exports.export_xml(df, str(tmp_path / "x"))
    back = spark.read.format("xml").option("rowTag", "prediction").load(str(tmp_path / "x"))
    assert {(r._id, r.name) for r in back.collect()} == {(1, "a"), (2, None)}
    f = tmp_path / "e.xml"
    f.write_text("<events><event><channel_id>7</channel_id><ts>2026-08-03T10:00:00</ts><is_alarm>true</is_alarm><value>1.5</value></event></events>")
    r = imports.clean_events(imports.import_xml(spark, str(f), "events", "event")).first()
    assert (r.channel_id, r.value_num, r.is_alarm, r.error) == (7, 1.5, True, None)


def test_journal_csv_drops_repeated_header(spark, tmp_path):
    f = tmp_path / "j.csv"
    f.write_text("ид_события,ид_канала_данных,дата,время,тревожное,значение_датчика\n1,7,2025-01-01,00:00:01,t,\"Норма\"\n"
                 "ид_события,ид_канала_данных,дата,время,тревожное,значение_датчика\n2,7,2025-01-01,00:00:01,f,Норма\n3,7,2025-01-01,00:00:05\n", encoding="utf-8")
    parsed = J.parse_journal(journal_csv.read_journal_csv(spark, str(f)))
    kept = J.dedup_events(parsed).collect()
    assert [(r.event_id, r.is_alarm, r.dup_n) for r in kept] == [(1, True, 2)]


def test_events_partitions_are_replaced_by_month(spark, tmp_path):
    e = lambda rows: spark.createDataFrame(rows, "event_id int, ch long, ts timestamp")
    path = str(tmp_path / "ev")
    write_events(e([(1, 1, ts("2024-01-05 00:00:00")), (2, 1, ts("2024-02-05 00:00:00")), (0, 1, ts("2020-01-01 00:00:00"))]), path)
    write_events(e([(3, 1, ts("2024-02-06 00:00:00"))]), path)
    assert {r.event_id for r in read_events(spark, path, 2024).collect()} == {1, 3}


def test_slice_manifest(spark):
    t = {"a": spark.createDataFrame([(1, ts("2024-01-01 00:00:00")), (2, ts("2024-02-01 00:00:00"))], "id int, at timestamp")}
    cut = slices.slice_tables({"a": (t["a"], "at", 0)}, "2024-01-01", "2024-01-31")
    want = slices.manifest(cut)
    assert want.first()["rows"] == 1 and slices.validate_slice(want, cut).count() == 0
    assert slices.validate_slice(want, t).first().problem == "row count differs"
    assert slices.validate_slice(want, {"b": t["a"]}).count() == 2


def test_publish_serving_tables(spark, tmp_path):
    from lullwatch.sources.publish import publish_serving
    from lullwatch.testbed.adapter import Bed
    b = Bed(spark, "/root/testdata/sf0.001")
    publish_serving(str(tmp_path), b.hourly(), b.events(), b.faults(), b.predictions(), b.channels(), "2024-01-31", "2024-01-10", "2024-01-20", 12)
    p = spark.read.parquet(str(tmp_path / "predictions"))
    want = b.predictions().filter((F.col("at") >= "2024-01-20") | (F.hour("at") % 12 == 0)).count()
    ids = p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("m")).first()
    assert (ids.n, ids.d, ids.m) == (want, want, want)
    o = spark.read.parquet(str(tmp_path / "prediction_outcomes"))
    assert o.join(p, o.prediction_id == p.id, "left_anti").count() == 0
    assert spark.read.parquet(str(tmp_path / "channel_daily")).agg(F.min("day")).first()[0].isoformat() >= "2024-01-10"
    faults = spark.read.parquet(str(tmp_path / "channel_faults"))
    assert faults.count() == faults.distinct().count() > 0


# ---- serving


def _preds(spark, rows):
    return spark.createDataFrame(rows, "id long, channel_id long, at timestamp, horizon_h int, prob double, health int, risk_level string, model_version string")


def test_time_machine(spark):
    p = _preds(spark, [(1, 1, ts("2024-01-01 06:00:00"), 24, 0.9, 10, "critical", "v"), (2, 1, ts("2024-01-01 12:00:00"), 24, 0.1, 90, "normal", "v")])
    assert [r.id for r in S.snapshot(p, "2024-01-01 11:59:00").collect()] == [1]
    assert S.snapshot(p, "2023-12-31 00:00:00").count() == 0
    out = spark.createDataFrame([(1, True, ts("2024-01-01 08:00:00"))], "prediction_id long, happened boolean, fault_at timestamp")
    none = spark.createDataFrame([], "prediction_id long, id long, decision_type string, reason_id int, created_at timestamp, number string, status string")
    seen = lambda at: {r.id: r.happened for r in S.enrich(p, none, none, out, at).collect()}
    assert seen("2024-01-01 20:00:00")[1] is None and seen("2024-01-02 06:00:00")[1] is True


def test_dense_history_has_720_hours(spark):
    ev = spark.createDataFrame([(1, ts("2024-01-15 10:05:00"), "x", False, None, "Норма")], "ch long, ts timestamp, raw string, is_alarm boolean, num double, txt string")
    h = S.hourly_history(ev, spark.createDataFrame([(1,)], "ch long"), "2024-01-01 10:30:00", "2024-01-31 10:30:00", SPEC)
    assert h.count() == 720 and h.agg(F.sum("events_count")).first()[0] == 1


def test_custom_bounds(spark):
    df = spark.createDataFrame([(0.05,), (0.2,), (0.5,), (0.8,), (None,)], "prob double")
    got = [r[0] for r in df.select(risk.risk_level_from_prob(F.col("prob"), RiskBounds())).collect()]
    assert got == ["normal", "attention", "risk", "critical", None]


# ---- model


def test_replacement_keeps_referenced_rows(spark):
    old = _preds(spark, [(1, 1, ts("2024-01-01 00:00:00"), 24, 0.5, 50, "attention", "v2"), (2, 1, ts("2024-01-01 06:00:00"), 24, 0.5, 50, "attention", "v2"),
                         (3, 2, ts("2024-01-01 00:00:00"), 24, 0.5, 50, "attention", "v2")])
    new = old.drop("id").withColumn("model_version", F.lit("v3"))
    refs = spark.createDataFrame([(1,)], "id long")
    out = M.replace_predictions(old, new, refs)
    assert sorted((r.id, r.model_version) for r in out.collect()) == [(1, "v2"), (2, "v3"), (3, "v3")]
    again = M.replace_predictions(out, new, refs)
    assert sorted((r.id, r.channel_id, r.at) for r in again.collect()) == sorted((r.id, r.channel_id, r.at) for r in out.collect())


def test_threshold_fallback_is_most_precise(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.7, 0), (0.6, 0)], "p double, y int")
    r = M.pick_threshold(df, 0.72).first()
    assert (r.threshold, r.reached) == (0.8, False)


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    assert M.average_precision(df).first().pr_auc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_features_never_use_events_of_the_future(spark):
    hours = spark.createDataFrame([(1, ts("2024-01-01 05:00:00"), 1), (1, ts("2024-01-01 06:00:00"), 10)], "ch long, hour timestamp, n int")
    known = hours.withColumn("hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    probes = spark.createDataFrame([(1, ts("2024-01-01 06:00:00"))], "ch long, T timestamp")
    assert X.counters_at(probes, known, "ch", ["n"], {"6h": 6}).first().n_6h == 1


# ---- rules


def _signal(spark, **kw):
    base = dict(id=1, channel_id=1, prob=0.6, risk_level="risk", sensor_type="дым", object_id=1, top_factors=[], kind_probs=None, fault_msgs_24h=0,
                power_off_24h=0, object_power_off=0, neighbors_silent=0, same_type_silent=0, object_channels=10, same_type_channels=3, f_link_90d=0,
                f_fault_90d=0, f_disc_90d=0, f_value_90d=0, faults_30d=0, faults_90d=0, faults_since_repair=None, type_precision=None,
                has_open_order=False, at=ts("2024-01-01 00:00:00"))
    base.update(kw)
    schema = ("id long, channel_id long, prob double, risk_level string, sensor_type string, object_id long, top_factors array<struct<feature:string,value:double,norm:double>>, "
              "kind_probs map<string,double>, fault_msgs_24h long, power_off_24h long, object_power_off long, neighbors_silent long, same_type_silent long, "
              "object_channels long, same_type_channels long, f_link_90d long, f_fault_90d long, f_disc_90d long, f_value_90d long, faults_30d long, faults_90d long, "
              "faults_since_repair long, type_precision double, has_open_order boolean, at timestamp")
    df = spark.createDataFrame([tuple(base.values())], schema)
    return df.join(A.type_groups(df, R.DEFAULT_RULES), "sensor_type")


SILENT = [("hours_since_event", 30.0, 2.0)]
CASES = {
    "group_planned_works": dict(top_factors=[("nb_silent_share", 0.8, 0.1)]),
    "power_object": dict(top_factors=SILENT, object_power_off=2),
    "mass_link_loss": dict(top_factors=SILENT, neighbors_silent=5, object_channels=20),
    "repeat_after_repair": dict(faults_since_repair=1),
    "value_failure": dict(kind_probs={"value": 0.4, "link": 0.1}),
    "chronic_fault": dict(fault_msgs_24h=2, f_fault_90d=3, faults_90d=3),
    "chronic_link": dict(top_factors=SILENT, f_link_90d=4, faults_90d=4),
    "verify_remote_first": dict(top_factors=SILENT, type_precision=0.3),
    "fault_diagnostics": dict(fault_msgs_24h=1),
    "gas_calibration": dict(sensor_type="Газовый датчик", top_factors=[("v_mean_24h", 3.0, 1.0)]),
    "temperature_check": dict(sensor_type="Датчик температуры", top_factors=[("stuck_share_24h", 0.95, 0.1)]),
    "drift_check": dict(top_factors=[("nb_dev_v_mean_24h", 3.0, 0.0)]),
    "pump_unit": dict(sensor_type="Состояние насоса"),
    "fan_unit": dict(sensor_type="Состояние вентилятора"),
    "ups_check": dict(sensor_type="ИБП"),
    "single_link": dict(top_factors=SILENT),
    "watch": dict(),
    "routine": dict(risk_level="normal", prob=0.05),
}


def test_every_rule_is_reachable(spark):
    assert set(CASES) == {r.id for r in R.RULES}
    out = {}
    frames = [_signal(spark, **{**c, "id": i}) for i, c in enumerate(CASES.values())]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    for r in A.advise(df, R.DEFAULT_RULES).collect():
        out[r.id] = r
    assert [out[i].rule_id for i in range(len(CASES))] == list(CASES)
    by = {name: out[i] for i, name in enumerate(CASES)}
    assert (by["gas_calibration"].priority, by["gas_calibration"].due_hours) == ("high", 24.0)
    assert (by["power_object"].priority, by["power_object"].due_hours) == ("high", 24.0)
    assert (by["chronic_fault"].priority, by["chronic_fault"].due_hours) == ("critical", 4.0)
    assert (by["pump_unit"].due_hours, by["watch"].due_hours, by["routine"].due_hours) == (24.0, 24.0, 168.0)


@pytest.mark.parametrize("change", [
    lambda r: r + (R.Rule("late", {"kind": ["link"]}, "x"),), lambda r: r[:-1], lambda r: (R.Rule("bad", {"nope": 1}, "x"),) + r,
    lambda r: (R.Rule("bad", {"kind": ["nope"]}, "x"),) + r, lambda r: (R.Rule("bad", {}, "x", priority="urgent"),) + r,
    lambda r: (R.Rule("bad", {}, "x", due_limit="nope"),) + r, lambda r: (r[0],) + r,
])
def test_broken_rules_are_loud(change):
    with pytest.raises(ValueError):
        replace(R.DEFAULT_RULES, rules=change(R.RULES))


def test_rules_load_from_mapping():
    m = {"params": {**R.PARAMS, "due_hours": R.DUE_HOURS, "min_priority_by_group": {}}, "sensor_groups": {"gas": ["gas"]},
         "regulation": {"norms": {"n": {"hours": 5}}}, "due_limits": {"d": [{"group": ["gas"], "norm": "n", "direct": True}]},
         "rules": [{"id": "a", "when": {"group": ["gas"]}, "action": "x", "facts": ["current"], "due_limit": "d", "title": "t"}, {"id": "z", "when": {}, "action": "y"}]}
    rs = R.RuleSet.from_mapping(m)
    assert rs.due_limits["d"] == (({"group": ["gas"]}, "n"),) and rs.norms == {"n": 5}


# ---- streams


def test_stream_batch_counts_and_repeat(spark, tmp_path):
    channels = spark.createDataFrame([(7,)], "id long")
    rows = [("1", "7", "2026-08-03 10:00:00", "true", "1.5"), ("2", "7", "2026-08-03 10:00:00", "true", "1.5"),
            ("3", "7", "2026-08-03 10:00:01", "f", "01.01.1970"), ("4", "9", "2026-08-03 10:00:02", "f", "2")]
    batch = spark.createDataFrame(rows, "event_id string, channel_id string, ts string, is_alarm string, value string")
    landing, counters = str(tmp_path / "l"), str(tmp_path / "c")
    ingest.ensure_table(spark, landing, ingest.LANDING, "day")
    ingest.ingest_batch(batch, 0, channels, landing, counters)
    c = spark.read.parquet(f"{counters}/batch=0").first()
    assert (c.received, c.accepted, c.duplicates, c.unknown, c.invalid) == (4, 1, 1, 1, 1)
    ingest.ingest_batch(batch, 1, channels, landing, counters)
    assert ingest.read_landing(spark, landing).count() == 1
    assert ingest.recent_days(ingest.read_landing(spark, landing), "2026-08-10", 5).count() == 0


def test_alert_state_spans_batches(spark, tmp_path):
    hours = [0, 6, 30, 40, 70]
    rows = [(i, 1, ts("2024-01-01 00:00:00") + timedelta(hours=h), 24, 0.9, 5, "critical", "v") for i, h in enumerate(hours)]
    src = str(tmp_path / "src")
    for r in rows:
        _preds(spark, [r]).coalesce(1).write.mode("append").parquet(src)
    whole = _preds(spark, rows)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = str(tmp_path / "out")
    alerts.alert_stream(stream, out, str(tmp_path / "ck")).awaitTermination()
    got = {r.id for r in alerts.read_alerts(spark, out).collect()}
    want = {r.id for r in S.critical_transitions(whole, "2024-01-01 00:00:00", "2024-02-01 00:00:00").collect()}
    assert got == want == {0, 4}


def test_alert_moments_of_silent_channels_expire(spark, tmp_path):
    path, start = str(tmp_path / "a"), ts("2024-01-01 00:00:00")
    batch = lambda k, rows: alerts.alert_batch(_preds(spark, [(i, ch, start + timedelta(hours=h), 24, 0.9, 5, "critical", "v") for i, ch, h in rows]), k, path, 24, 24, None, 5)
    batch(0, [(1, 1, 0), (2, 2, 0)])
    for _ in range(2):  # a repeated batch changes nothing
        batch(1, [(3, 1, 100), (4, 1, 90), (5, 3, 60)])
    kept = spark.read.schema(alerts.STATE).parquet(f"{path}/state/slot=1").collect()
    assert {(r.channel_id, r["last"]) for r in kept} == {(1, start + timedelta(hours=100)), (3, start + timedelta(hours=60))}
    batch(2, [(6, 3, 80), (7, 1, 95)])  # 80 lies within the cooldown of 60, 95 before the stored 100
    assert {r.id for r in alerts.read_alerts(spark, path).collect()} == {1, 2, 4, 5}


def test_tree_of_four_levels(spark):
    from lullwatch.operators import tree

    objects = spark.createDataFrame([(1, None, 1, "d"), (2, 1, 2, "c"), (3, 2, 3, "s"), (4, 3, 4, "room")], "id long, parent_id long, level int, name string")
    assert {r.id for r in tree.subtree_ids(objects, [1]).collect()} == {1, 2, 3, 4}
    assert {r.id: r.path for r in tree.paths(objects).collect()}[4] == "d → c → s → room"
    direct = spark.createDataFrame([(4, 7)], "oid long, n long")
    assert {r.id: r.n for r in tree.tree_rollup(direct, objects, "oid", [F.sum("n").alias("n")]).collect()} == {1: 7, 2: 7, 3: 7, 4: 7}
    assert tree.closure(objects.limit(0)).count() == 0


def test_parents_in_a_cycle(spark):
    from lullwatch.operators import tree

    with pytest.raises(ValueError, match="cycle"):
        tree.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"))


def test_long_values_with_one_beginning(spark):
    rows = spark.createDataFrame([("1", "2026-08-03 10:00:00", "f", "x" * 200 + end) for end in "ab"], "channel_id string, ts string, is_alarm string, value string")
    assert imports.new_events(imports.clean_events(rows), spark.createDataFrame([], ingest.LANDING)).count() == 2


def test_row_numbers_over_splits(spark, tmp_path):
    f = tmp_path / "many.csv"
    f.write_text("id,level,kind,name\n" + "".join(f"{i},1,k,{'n' * 20}\n" for i in range(2, 20002)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = imports.numbered(imports.import_csv(spark, str(f), "objects"))
        assert rows.filter(F.col("row") != F.col("id").cast("long")).count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_factor_values_round_half_to_even(spark):
    from lullwatch.functions.text import factor_value

    values = [0.25, 0.35, 0.15, 0.125, -0.04, 12345.5, 12346.5, 0.999, 2.675, 1e-9, 0.0]
    cols = {"float1": ".1f", "float2": ".2f", "signed": "+.1f"}
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[factor_value(F.col("v"), k).alias(k) for k in ("int", *cols)]).collect()
    for r in got:
        assert [r[k] for k in cols] == [format(r.v, p).replace(".", ",") for p in cols.values()], r.v
        assert r["int"] == f"{round(r.v):,}".replace(",", " ")


def test_long_period_is_refused():
    from lullwatch.plans.serving import check_period

    check_period("2024-01-01", "2024-01-31", 31)
    for period in (("2024-01-01", "2024-02-20"), ("2024-02-01", "2024-01-01")):
        with pytest.raises(ValueError, match="at most 31 days"):
            check_period(*period, 31)


def test_journal_period_only_runs_forward():
    from lullwatch.plans.serving import check_period

    check_period("2020-01-01", "2024-01-31")
    with pytest.raises(ValueError):
        check_period("2024-02-01", "2024-01-31")


def test_entry_imports_without_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "lullwatch", tmp_path / "lullwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout) > 200
