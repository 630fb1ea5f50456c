"""Day-partitioned tables: merging, late events, pruning; spans of a key at moments."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lullwatch.operators.carry import lasting_distinct_count
from lullwatch.operators.intervals import newest_open_at
from lullwatch.plans import serving as S
from lullwatch.sources import merge
from lullwatch.streaming import hourly, ingest
from lullwatch.testbed.adapter import Bed

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


SCHEMA = "id long, at timestamp, prob double, note string, version long, day date"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, at(h), p, n, v, at(h).date()) for i, h, p, n, v in rows], SCHEMA)


def stored(spark, path):
    return {(r.id, r.at): (r.prob, r.note, r.version) for r in spark.read.schema(SCHEMA).parquet(path).collect()}


def test_upsert_inserts_updates_and_can_be_repeated(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["id", "at"]
    merge.ensure_table(spark, path, SCHEMA, "day")
    assert merge.upsert(rows_of(spark, [(1, 1, 0.1, "a", 1), (1, 30, 0.2, "b", 1), (2, 1, 0.3, "c", 1), (2, 1, 0.35, "c2", 0)]), path, key, ["prob"], ["version"]) == {
        "inserted": 3, "updated": 0, "unchanged": 0}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "day=2024-01-02").iterdir()}
    batch = rows_of(spark, [(1, 1, 0.9, "not taken", 2), (3, 2, 0.4, "d", 2), (2, 1, 0.0, "old", 0)])
    assert merge.upsert(batch, path, key, ["prob"], ["version"]) == {"inserted": 1, "updated": 1, "unchanged": 1}
    want = {(1, at(1)): (0.9, "a", 2), (1, at(30)): (0.2, "b", 1), (2, at(1)): (0.3, "c", 1), (3, at(2)): (0.4, "d", 2)}
    assert stored(spark, path) == want
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "day=2024-01-02").iterdir()} == before  # an untouched day
    merge.upsert(batch, path, key, ["prob"], ["version"])
    assert stored(spark, path) == want


def test_insert_only_keeps_what_is_there(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["id", "at"]
    merge.ensure_table(spark, path, SCHEMA, "day")
    batch = rows_of(spark, [(1, 1, 0.1, "first", 1), (1, 1, 0.2, "second", 2)])
    assert merge.upsert(batch, path, key, order=["version"])["inserted"] == 1
    assert merge.upsert(batch, path, key, order=["version"]) == {"inserted": 0, "updated": 0, "unchanged": 1}
    assert merge.upsert(batch.limit(0), path, key)["inserted"] == 0
    assert stored(spark, path) == {(1, at(1)): (0.1, "first", 1)}


def test_dimension_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, tag string")
    new = spark.createDataFrame([(2, "b0", "z", 2), (2, "b1", "z", 3), (3, "c", None, 4)], "id long, name string, tag string, row long")
    got = {tuple(r) for r in merge.upsert_dimension(new, old, ["id"], ["name"]).collect()}
    assert got == {(1, "a", "x"), (2, "b1", "y"), (3, "c", None)}


def test_hours_take_events_of_any_lateness(spark, tmp_path):
    b = Bed(spark, "/root/testdata/sf0.001")
    rng = random.Random(4)
    rows = [(k, rng.randrange(4), at(rng.uniform(0, 200)), rng.random() < 0.3, rng.choice(["1.5", "2", "FAULT", "OK", "UNCERTAIN"])) for k in range(400)]
    rows = [(i, c, t.replace(microsecond=0), a, r, float(r) if r[0].isdigit() else None, None if r[0].isdigit() else r, t.date()) for i, c, t, a, r in rows]
    batches = [rows[k::4] for k in range(4)]
    batches.sort(key=lambda x: max(r[2] for r in x), reverse=True)
    hours, counters = str(tmp_path / "h"), str(tmp_path / "c")
    merge.ensure_table(spark, hours, hourly.CELLS, "day")
    merge.ensure_table(spark, counters, hourly.COUNTERS, "batch")
    frames = [ingest.as_journal(spark.createDataFrame(x, ingest.LANDING)) for x in batches]
    for k in (0, 1, 1, 2, 3, 3):  # repeated batches add nothing
        hourly.add_batch(frames[k], k, hours, counters, b.spec, timedelta(hours=2))
    whole = hourly.cells_of(ingest.as_journal(spark.createDataFrame(rows, ingest.LANDING)), b.spec, F.lit(False))
    cols = ["ch", "hour", "events_count", "alarm_count", "fault_count", "uncertain_count", "value_min", "value_max"]
    plain = lambda df: sorted(tuple(r) for r in df.select(*cols, F.round("value_avg", 9)).collect())
    want = plain(whole.withColumn("value_avg", F.try_divide(F.col("value_sum"), F.col("value_count"))))
    assert plain(hourly.read_hours(spark, hours)) == want
    late, seen = 0, None
    for x in batches:
        late += sum(seen is not None and r[2] < seen - timedelta(hours=2) for r in x)
        seen = max([r[2] for r in x] + ([seen] if seen else []))
    assert spark.read.schema(hourly.COUNTERS).parquet(counters).agg(F.sum("late_rows")).first()[0] == late > 100
    spark.createDataFrame(rows, ingest.LANDING).write.partitionBy("day").parquet(str(tmp_path / "l"))
    hourly.rebuild_days(spark, str(tmp_path / "l"), hours, [date(2024, 1, 2)], b.spec)
    assert plain(hourly.read_hours(spark, hours)) == want


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    from lullwatch.sources.publish import publish_serving

    b, path = Bed(spark, "/root/testdata/sf0.001"), str(tmp_path_factory.mktemp("serving"))
    publish_serving(path, b.hourly(), b.events(), b.faults(), b.predictions(), b.channels(), "2024-01-31", "2024-01-10", "2024-01-09", 6)
    return b, lambda name: spark.read.parquet(f"{path}/{name}")


def scans(df, column):
    """Partition filters of the scans that read ``column``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: [")[1].split("], PushedFilters")[0] for line in plan.splitlines() if "FileScan" in line and f"{column}#" in line.split("Batched")[0]]


def same(a, b, cols):
    pick = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    return pick(a) == pick(b)


MOMENT = "2024-01-20 15:20:00"


def test_questions_read_their_days_only(spark, published, tmp_path):
    b, table = published
    preds, moments, outcomes, faults = table("predictions"), table("prediction_moments"), table("prediction_outcomes"), table("channel_faults").withColumnRenamed("channel_id", "ch")
    events, day_last = b.events().withColumn("day", F.to_date("ts")), table("events_day_last")
    events.write.partitionBy("day").parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    plain = preds.drop("day")  # the same rows without their partitions
    asks = {
        "v01": lambda p, **k: S.snapshot(p, MOMENT, **k),
        "v02": lambda p, **k: S.predictions_at(p, b.channels(), b.objects(), MOMENT, **k),
        "v11": lambda p, **k: S.journal(p, b.channels(), b.objects(), b.decisions(), outcomes, MOMENT, date_from="2024-01-18", only_alerts=False, **k),
        "v18": lambda p, **k: S.critical_transitions(p, "2024-01-18 00:00:00", MOMENT),
        "v19": lambda p, **k: S.transition_feed(p, MOMENT, 48, **k),
    }
    for name, ask in asks.items():
        df = ask(preds, moments=moments)
        found = scans(df, "prob")
        assert found and all("day#" in f for f in found), name
        assert same(df, ask(plain), ["id", "at", "prob"]) and df.count(), name
    e = S.events_at(events, MOMENT, b.spec, day_last=day_last)
    assert all("day#" in f for f in scans(e, "raw")) and same(e, S.events_at(b.events(), MOMENT, b.spec), ["event_id"])
    labels = S.label_outcomes(preds, outcomes.limit(0), faults, events, MOMENT, b.spec, until=datetime(2024, 1, 20, 15, 20))
    assert any("day#" in f for f in scans(labels, "horizon_h"))
    cards = S.channel_cards(preds, events, b.decisions(), b.work_orders(), b.channels(), MOMENT, moments=moments, day_last=day_last)
    assert same(cards, S.channel_cards(plain, b.events(), b.decisions(), b.work_orders(), b.channels(), MOMENT), ["id", "prob", "last_ts", "last_value", "open_orders", "on_watch"])


def test_closed_days_are_labelled_once(spark, published, tmp_path):
    b, table = published
    out, until = str(tmp_path / "o"), datetime(2024, 1, 21, 3, 0)
    merge.ensure_table(spark, out, ingest.OUTCOMES, "day")
    landing, faults, preds, moments = (str(tmp_path / n) for n in ("landing", "faults", "preds", "moments"))
    b.events().select("event_id", F.col("ch").alias("channel_id"), "ts", "is_alarm", F.col("raw").alias("value_raw"), F.col("num").alias("value_num"), F.col("txt").alias("value_text"),
                      F.to_date("ts").alias("day")).write.partitionBy("day").parquet(landing)
    b.faults().select("ch", "ts", "kind").write.parquet(faults)
    table("predictions").write.partitionBy("day").parquet(preds)
    table("prediction_moments").write.parquet(moments)
    args = (landing, preds, moments, faults, out, "2024-01-21 03:00:00", b.spec)
    ingest.label_batch(spark, until, *args)
    closed = {r[0] for r in table("predictions").filter(F.col("at") <= F.lit(until - timedelta(hours=24))).select("id").collect()}
    assert {r[0] for r in spark.read.schema(ingest.OUTCOMES).parquet(out).select("prediction_id").collect()} == closed
    assert ingest.open_days(spark, moments, out, until) == []
    ingest.label_batch(spark, until, *args)
    assert spark.read.schema(ingest.OUTCOMES).parquet(out).count() == len(closed)
    assert ingest.open_days(spark, moments, out, until + timedelta(hours=6)) == [date(2024, 1, 20)]


def test_newest_open_span(spark):
    rng = random.Random(9)
    spans = [(rng.randrange(3), at(s), None if rng.random() < 0.1 else at(s + rng.choice([0, 0.5, 1, 3, 40, 900]) * rng.random()), k) for k, s in enumerate(rng.uniform(0, 1000) for _ in range(300))]
    spans += [(1, at(5), at(7), 1000), (1, at(5), at(7), 1001), (2, at(8), at(8), 1002)]
    probes = [(k, at(h)) for k in range(4) for h in range(0, 1100, 7)] + [(1, at(5)), (1, at(7)), (2, at(8))]
    got = newest_open_at(spark.createDataFrame(probes, "k long, at timestamp"), spark.createDataFrame(spans, "k long, s timestamp, e timestamp, id long"), ["k"], "at", "s", "e", ["id"], ["id"])
    want = {}
    for k, t in probes:
        inside = [(s, i) for kk, s, e, i in spans if kk == k and s <= t and (e is None or t < e)]
        if inside:
            want[k, t] = max(inside)[1]
    assert {(r.k, r.at): r.id for r in got.collect()} == want
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("level#" in j and "node#" in j for j in joins)


def test_lasting_marks_count_members_once(spark):
    rng = random.Random(1)
    marks = [(rng.randrange(2), rng.randrange(5), at(rng.randrange(0, 200))) for _ in range(80)]
    probes = [(k, at(h)) for k in range(2) for h in range(0, 230)]
    got = lasting_distinct_count(spark.createDataFrame(probes, "k long, at timestamp"), spark.createDataFrame(marks, "k long, m long, ts timestamp"), ["k"], "m", "at", "ts", 24, "n")
    assert {(r.k, r.at): r.n for r in got.collect()} == {(k, t): len({m for kk, m, x in marks if kk == k and t - timedelta(hours=24) < x <= t}) for k, t in probes}


def test_a_large_month_has_many_writers(spark, tmp_path):
    from lullwatch.sources import parquet

    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        rows = spark.range(0, 300_000, 1, 16).select((F.col("id") % 7).alias("ch"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 8).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("raw"))
        parquet.write_events(rows, str(tmp_path / "e"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert len(list((tmp_path / "e" / "year=2024" / "month=1").glob("*.parquet"))) > 8
    assert parquet.read_events(spark, str(tmp_path / "e"), 2024).count() == 300_000


def test_newest_open_span_broadcasts_no_exploded_side(spark):
    # tables small enough for Spark to broadcast them if it were free to
    probes = spark.createDataFrame([(1, at(5)), (1, at(7))], "k long, at timestamp")
    spans = spark.createDataFrame([(1, at(4), at(6), 10), (1, at(5), None, 11)], "k long, s timestamp, e timestamp, id long")
    got = newest_open_at(probes, spans, ["k"], "at", "s", "e", ["id"], ["id"])
    rows = {(r.k, r.at): r.id for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows == {(1, at(5)): 11, (1, at(7)): 11}
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_counter_pass_gets_partitions_by_its_rows(spark, monkeypatch):
    from lullwatch.operators import windows as W
    from lullwatch.plans import features as X
    from lullwatch.spec import JournalSpec

    hour = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 48 * 3600)
    hourly = spark.range(40 * 48).select((F.col("id") / 48).cast("long").alias("ch"), hour.alias("hour"), hour.alias("last_ts"),
                                         *[(F.col("id") % k).cast("double" if c.startswith("s_") else "int").alias(c) for k, c in enumerate(X.HOUR_MEASURES.values(), 2)])
    sl = hourly.filter(F.hour("hour") % 6 == 0).select("ch", F.col("hour").alias("T"))
    spec = JournalSpec()
    faults = spark.createDataFrame([(1, at(9.5), "LINK_LOSS", None, False, False, False)], "ch long, ts timestamp, kind string, sub string, mass boolean, grp boolean, in_outage boolean")
    rec = spark.createDataFrame([(1, at(11), 1.5)], "ch long, ts timestamp, hours double")
    run = lambda: X.channel_counters(sl, hourly, X.fault_hours(faults, spec), rec, spec)
    whole = sorted(run().collect(), key=lambda r: (r.ch, r["T"]))
    assert "REPARTITION_BY_NUM" not in run()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(W, "TASK_ROWS", 100, raising=False)
    rows = sl.count() * (len(spec.windows) + 1) + hourly.count()
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in run()._jdf.queryExecution().executedPlan().toString()
    assert sorted(run().collect(), key=lambda r: (r.ch, r["T"])) == whole


def test_slices_of_a_period_are_all_its_snapshots(spark):
    from lullwatch.testbed import load_checks
    from lullwatch.testbed.registry import ORACLES, QUERIES

    load_checks()
    folder = "/root/testdata/sf0.001"
    got = QUERIES["s06_read_slices"](spark, folder)
    all_of_it = Bed(spark, folder).predictions().filter(F.col("at").between("2024-01-12", "2024-01-15")).select("id", "prob")
    assert got.columns == ["id", "prob"] and sorted(got.collect()) == sorted(all_of_it.collect()) and all_of_it.count() > 0
    assert "FROM preds" in ORACLES["s06_read_slices"]
    assert {"s06_read_feature_slices"} <= set(QUERIES)
