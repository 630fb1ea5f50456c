"""Plans of the advice programs: what the driver holds must grow neither with the tables nor with the texts of a rule."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lullwatch.operators.intervals import newest_open_at
from lullwatch.plans import advice as A
from lullwatch.plans import rules as R
from lullwatch.plans.serving import snapshot
from lullwatch.spec import JournalSpec
from lullwatch.testbed import adapter, checks_advice

AT = datetime(2024, 1, 10)
FACTORS = "array<struct<feature:string,value:double,norm:double>>"


def test_factor_texts_are_worked_out_once(spark):
    columns = {
        "id": "bigint", "at": "timestamp", "prob": "double", "rule_id": "string", "fault_kind": "string", "top_factors": FACTORS, "object_channels": "bigint", "neighbors_silent": "bigint",
        "object_power_off": "bigint", "power_off_24h": "bigint", "fault_msgs_24h": "bigint", "faults_30d": "bigint", "faults_90d": "bigint", "repair_number": "string", "repaired_at": "timestamp",
        "faults_since_repair": "bigint", "type_precision": "double", "due_limit_hours": "double", "conclusion": "string", "open_order": "string", "work_order": "boolean",
        "sensor_groups": "array<string>", "recent_visit": "string"}
    base = dict.fromkeys(columns) | {"at": AT, "prob": 0.5, "object_channels": 1, "conclusion": "x", "work_order": True, "sensor_groups": []}
    cases = [("single_link", None), ("mass_link_loss", [(None, 1.0, 1.0), ("gap_to_norm", 3.0, 1.0), ("hours_to_norm", 2.0, None)]), ("mass_link_loss", None),
             ("mass_link_loss", [("link_losses_7d", 4.0, 0.5)]), ("mass_link_loss", [("link_losses_7d", None, 0.5), None])]
    rows = [tuple((base | {"id": k, "rule_id": rule, "top_factors": factors}).values()) for k, (rule, factors) in enumerate(cases)]
    df = A.advice_text(spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in columns.items())), R.DEFAULT_RULES)
    got = {r.id: r.facts for r in df.collect()}
    assert got == {0: ["за 90 дней отказов не было"], 1: ["пауза против личной нормы — 3 при норме 1"], 2: [], 3: ["потери связи — 4 при норме 0.5"], 4: ["потери связи"]}
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 1 <= plan.count("other:") < 20


def signal_tables(spark):
    preds = spark.createDataFrame([(k, k % 3, AT, 0.5, "risk", [("gap_to_norm", 3.0, 1.0)], None) for k in range(3)] + [(3, None, AT, 0.5, "risk", None, None), (4, 9, None, 0.5, "risk", None, None)],
                                  f"id long, channel_id long, at timestamp, prob double, risk_level string, top_factors {FACTORS}, kind_probs map<string,double>")
    faults = spark.createDataFrame([(0, datetime(2024, 1, 9, 12), "LINK_LOSS"), (1, datetime(2024, 1, 2), "FAULT")], "ch long, ts timestamp, kind string")
    events = spark.createDataFrame([(1, datetime(2024, 1, 9, 20), "POWER_OFF")], "ch long, ts timestamp, txt string")
    orders = spark.createDataFrame([(7, "WO-7", 2, "draft", datetime(2024, 1, 1), None)], "id long, number string, channel_id long, status string, created_at timestamp, closed_at timestamp")
    channels = spark.createDataFrame([(k, 5, "фаза" if k == 1 else "дым", "S", f"n{k}", "t") for k in range(3)], "id long, object_id long, sensor_type string, system_type string, name string, tag string")
    metrics = spark.createDataFrame([], "scope string, key string, model_version string, precision double")
    return preds, faults, events, orders, channels, metrics, F.lit("v"), JournalSpec(link_loss="LINK_LOSS", fault="FAULT", power_off="POWER_OFF"), R.DEFAULT_RULES


def test_signals_broadcast_no_side_with_a_row_a_prediction_or_channel(spark):
    preds = spark.createDataFrame([(k, k % 3, AT, 0.5, "risk", [("gap_to_norm", 3.0, 1.0)], None) for k in range(3)] + [(3, None, AT, 0.5, "risk", None, None), (4, 9, None, 0.5, "risk", None, None)],
                                  f"id long, channel_id long, at timestamp, prob double, risk_level string, top_factors {FACTORS}, kind_probs map<string,double>")
    faults = spark.createDataFrame([(0, datetime(2024, 1, 9, 12), "LINK_LOSS"), (1, datetime(2024, 1, 2), "FAULT")], "ch long, ts timestamp, kind string")
    events = spark.createDataFrame([(1, datetime(2024, 1, 9, 20), "POWER_OFF")], "ch long, ts timestamp, txt string")
    orders = spark.createDataFrame([(7, "WO-7", 2, "draft", datetime(2024, 1, 1), None)], "id long, number string, channel_id long, status string, created_at timestamp, closed_at timestamp")
    channels = spark.createDataFrame([(k, 5, "фаза" if k == 1 else "дым", "S", f"n{k}", "t") for k in range(3)], "id long, object_id long, sensor_type string, system_type string, name string, tag string")
    metrics = spark.createDataFrame([], "scope string, key string, model_version string, precision double")
    spec = JournalSpec(link_loss="LINK_LOSS", fault="FAULT", power_off="POWER_OFF")
    df = A.signals(preds, faults, events, orders, channels, metrics, F.lit("v"), spec, R.DEFAULT_RULES)
    rows = {r.id: (r.faults_90d, r.neighbors_silent, r.open_order) for r in df.collect()}
    assert rows == {0: (1, 2, None), 1: (1, 2, None), 2: (0, 2, "WO-7")}
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin [channel_id" in line or "HashJoin [id#" in line]
    assert not joins, joins


def test_parts_of_signals_are_written_one_by_one(spark, tmp_path):
    names = []

    def keep(name, build):
        names.append(name)
        build().write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    tables = signal_tables(spark)
    df = A.signals(*tables, keep=keep)
    assert len(names) == len(set(names)) == 8
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, df.collect())) == sorted(map(str, A.signals(*tables).collect()))


def test_checks_write_the_parts_of_faults_and_signals(spark):
    class Bed(adapter.Bed):
        def stage(self, name, build):
            if not name.startswith(("faults", "signals")):
                return super().stage(name, build)
            parts.append(name)
            return build()

    parts = []
    bed = Bed(spark, "/root/testdata/sf0.001")
    bed.faults()
    assert parts == ["faults", "faults_objects", "faults_parents", "faults_silent_days"]
    bed.predictions()
    parts.clear()
    checks_advice.signals(bed)
    assert {"signals_faults", "signals_power", "signals_silent", "signals_lost_of_type", "signals_lost_of_object", "signals_orders", "signals_open_orders", "signals_precision"} <= set(parts)


def test_tables_read_several_times_are_planned_once(spark, tmp_path):
    def keep(name, build):
        df = build()
        df.write.parquet(f"{tmp_path}/{name}")
        sizes[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Window ")
        return spark.read.parquet(f"{tmp_path}/{name}")

    sizes = {}
    tables = signal_tables(spark)
    preds, faults, _, orders, channels, _, _, spec, _ = tables
    plain = sorted(map(str, A.signals(*tables).collect()))
    lost = keep("lost", lambda: A.last_losses(preds, faults, channels, spec))
    totals = keep("totals", lambda: A.fault_totals(faults))
    done = keep("done", lambda: A.repairs(orders, totals))
    df = A.signals(*tables, keep=keep, lost=lost, totals=totals, done=done)
    assert sorted(map(str, df.collect())) == plain
    # without the written tables: 6 and 18
    assert sizes["signals_silent"] == 0 and sizes["signals_orders"] <= 2, sizes


def test_checks_write_the_tables_that_parts_share(spark):
    preds, faults, events, orders, channels, *_ = signal_tables(spark)

    class Bed:
        spec = adapter.SPEC

        def __getattr__(self, name):
            return lambda: {"advised": preds, "faults": faults, "events": events, "work_orders": orders, "channels": channels}[name]

        def scored(self):
            return spark.createDataFrame([], "p double, y int, sensor_type string")

        def stage(self, name, build):
            parts.append(name)
            return build()

    parts = []
    checks_advice.signals(Bed())
    assert {"advised", "last_losses", "fault_totals", "repairs"} <= set(parts)


def rows_made(df, node):
    """Rows that operators of this name put out when the rows of ``df`` were collected."""
    def walk(plan):
        if plan.nodeName().endswith("QueryStage"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == node else 0
        return own + sum(walk(plan.children().apply(k)) for k in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan().executedPlan())


def test_probes_of_a_lasting_span_ask_no_tree(spark):
    probes = [(k, AT + timedelta(hours=h)) for k in range(3) for h in range(40)]
    # channel 0: open for good; 1: a short span over it; 2: a span that holds all moments and ends
    spans = [(0, AT, None, 1), (1, AT - timedelta(days=900), None, 2), (1, AT + timedelta(hours=5.5), AT + timedelta(hours=8), 3), (2, AT - timedelta(days=1), AT + timedelta(days=5), 4)]
    got = newest_open_at(spark.createDataFrame(probes, "k long, at timestamp"), spark.createDataFrame(spans, "k long, s timestamp, e timestamp, id long"), ["k"], "at", "s", "e", ["id"], ["id"])
    rows = {(r.k, (r.at - AT).total_seconds() / 3600): r.id for r in got.collect()}
    assert rows == {(k, h): (1, 3 if k == 1 and h in (6, 7) else 2, 4)[k] for k in range(3) for h in range(40)}
    # a row a probe, eight levels for the 32 probes after the short span, the nodes of two spans; before: 21 rows a probe and some 20 nodes a lasting span
    assert rows_made(got, "Generate") <= 120 + 32 * 8 + 30


def test_older_spans_that_end_are_found_again(spark):
    rng = random.Random(3)
    hour = lambda h: AT + timedelta(hours=h)
    spans = [(rng.randrange(4), hour(s), rng.choice([None, *[hour(s + rng.choice([0, 0.4, 1, 2, 30, 700]))] * 8]), k % 50) for k, s in enumerate(rng.uniform(0, 500) for _ in range(400))]
    spans += [(k, None, None, 7) for k in range(4)] + [(None, AT, None, 8)]
    probes = [(k, hour(h)) for k in [None, *range(5)] for h in range(-3, 900, 11)] * 2
    df = spark.createDataFrame(spans, "k long, s timestamp, e timestamp, id long")
    got = newest_open_at(spark.createDataFrame(probes, "k long, at timestamp"), df, ["k"], "at", "s", "e", ["id"], ["id"]).collect()
    want = {(k, t): max(inside)[1] for k, t in probes if k is not None and (inside := [(s, i) for kk, s, e, i in spans if kk == k and s is not None and s <= t and (e is None or t < e)])}
    assert len(got) == len(want) and {(r.k, r.at): r.id for r in got} == want
    none = newest_open_at(spark.createDataFrame(probes, "k long, at timestamp"), df.limit(0), ["k"], "at", "s", "e", ["id"], ["id"])
    assert none.count() == 0


def test_phase_sensors_are_asked_only_near_their_own_messages(spark):
    channels = spark.createDataFrame([(k, 5, "фаза" if k else "дым") for k in range(41)], "id long, object_id long, sensor_type string")
    preds = spark.createDataFrame([(0, AT + timedelta(hours=6 * h)) for h in range(60)], "channel_id long, at timestamp")
    events = spark.createDataFrame([(3, AT + timedelta(hours=100.5), "POWER_OFF"), (4, AT + timedelta(hours=100.5), "POWER_OFF"), (4, AT + timedelta(hours=60), "POWER_OFF")], "ch long, ts timestamp, txt string")
    got = A.new_power_off(preds, events, channels, JournalSpec(power_off="POWER_OFF"), R.DEFAULT_RULES)
    rows = {(r.at - AT).total_seconds() / 3600: r.object_power_off for r in got.collect()}
    # channel 3 is new at 102 to 120 hours, channel 4 is not new then but was at 60 to 78
    assert {h: n for h, n in rows.items() if n} == {h: 1 for h in (60, 66, 72, 78, 102, 108, 114, 120)} and len(rows) == 60
    # before: three rows for each of 40 sensors at 60 moments
    assert rows_made(got, "Generate") < 400


def test_the_plan_asks_signals_of_its_snapshot_only(spark):
    class Bed(adapter.Bed):
        def stage(self, name, build):
            parts.append(name)
            return super().stage(name, build)

    parts = []
    bed = Bed(spark, "/root/testdata/sf0.001")
    got = sorted(map(str, checks_advice.snapshot_signals(bed).collect()))
    assert "signals" not in parts and "snapshot_signals" in parts
    assert got and got == sorted(map(str, snapshot(checks_advice.signals(bed), checks_advice.AT).collect()))


def test_orders_of_channels_without_predictions_are_left_out(spark):
    preds, faults, _, orders, channels, *_ = signal_tables(spark)
    more = orders.union(orders.selectExpr("id + 1", "number", "channel_id + 77", "status", "created_at", "closed_at"))
    assert A.orders_asked(preds, more).select(more.columns).collect() == orders.collect()
    state = lambda o: sorted(map(str, A.order_state(preds, o, faults, R.DEFAULT_RULES).collect()))
    assert state(A.orders_asked(preds, more)) == state(more)
