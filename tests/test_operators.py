"""Order-dependent programs against brute force on random rows, with one key that holds most of them."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lullwatch.operators import carry, intervals, ranking, sets, tree, windows
from lullwatch.operators.asof import asof_join

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def rows(n, seed, span=6 * 1440):
    """(key, minute, value): two thirds of the rows belong to one key; moments repeat."""
    rnd = random.Random(seed)
    return [(1 if rnd.random() < 0.67 else rnd.randint(2, 5), rnd.randrange(0, span, 30), rnd.randint(0, 9)) for _ in range(n)]


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_equals_brute_force(spark, direction, strict):
    left = [(i, k, at(t)) for i, (k, t, _) in enumerate(rows(200, 1))]
    right = sorted({(k, at(t), v) for k, t, v in rows(120, 2)})
    got = asof_join(spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "k int, ts timestamp, v int"),
                    ["k"], "t", "ts", ["v"], direction, strict)
    want = {}
    for i, k, t in left:
        if direction == "backward":
            hits = [(ts, v) for kk, ts, v in right if kk == k and (ts < t if strict else ts <= t)]
            want[i] = max(hits, default=(None, None))
        else:
            hits = [(ts, v) for kk, ts, v in right if kk == k and (ts > t if strict else ts >= t)]
            want[i] = min(hits, default=(None, None))
    assert {r.id: (r.ts, r.v) for r in got.collect()} == want


def test_asof_null_keys_never_match(spark):
    left = spark.createDataFrame([(1, None, at(5)), (2, 1, None)], "id int, k int, t timestamp")
    right = spark.createDataFrame([(None, at(1)), (1, at(1))], "k int, ts timestamp")
    assert [r.ts for r in asof_join(left, right, ["k"], "t", "ts").collect()] == [None, None]


@pytest.mark.parametrize("direction", ["previous", "next"])
def test_neighbour_by(spark, direction):
    data = sorted({(k, at(t), i, v if v > 3 else None) for i, (k, t, v) in enumerate(rows(200, 3))}, key=lambda r: r[:3])
    df = spark.createDataFrame(data, "k int, ts timestamp, i int, v int")
    got = carry.neighbour_by(df, ["k"], ["ts", "i"], **{"earlier" if direction == "previous" else "later": {
        "n_ts": ("ts", None), "n_v": ("v", F.col("v").isNotNull())}})
    want = {}
    for k, ts, i, v in data:
        line = [r for r in data if r[0] == k]
        others = [r for r in line if r[1:3] < (ts, i)][::-1] if direction == "previous" else [r for r in line if r[1:3] > (ts, i)]
        want[i] = (others[0][1] if others else None, next((r[3] for r in others if r[3] is not None), None))
    assert {r.i: (r.n_ts, r.n_v) for r in got.collect()} == want


def test_running_totals_count_peers(spark):
    data = [(k, at(t), v) for k, t, v in rows(300, 4)]
    got = carry.running_totals(spark.createDataFrame(data, "k int, ts timestamp, v int"), ["k"], "ts", {"n": F.lit(1), "s": F.col("v")})
    want = {(k, ts): (sum(1 for r in data if r[0] == k and r[1] <= ts), sum(r[2] for r in data if r[0] == k and r[1] <= ts))
            for k, ts, _ in data}
    assert {(r.k, r.ts): (r.n, r.s) for r in got.collect()} == want


def test_band_distinct_count(spark):
    marks = [(k, m, at(t)) for (k, t, m) in rows(150, 5)]
    probes = [(k, at(t)) for k, t, _ in rows(60, 6)]
    got = carry.band_distinct_count(spark.createDataFrame(probes, "k int, t timestamp"), spark.createDataFrame(marks, "k int, m int, ts timestamp"),
                                    ["k"], "m", "t", "ts", 12, "n")
    tol = timedelta(hours=12)
    want = {(k, t): len({m for kk, m, ts in marks if kk == k and abs(ts - t) <= tol}) for k, t in probes}
    assert {(r.k, r.t): r.n for r in got.collect()} == want


def test_overlap_equals_direct_sum(spark):
    wins = [(at(60), at(180)), (at(1440), at(1500)), (at(2000), at(5000))]
    spans = [(i, at(a), at(a + b)) for i, (a, b) in enumerate([(0, 30), (0, 100), (100, 10), (170, 1300), (1400, 4000), (5000, 60), (2100, 50)])]
    clock = intervals.window_clock(spark.createDataFrame(wins, "start timestamp, end timestamp"), "2024-01-01", "2024-01-10")
    df = spark.createDataFrame(spans, "i int, a timestamp, b timestamp")
    got = {r.i: r.s for r in intervals.overlap_seconds(df, clock, F.col("a"), F.col("b"), "s").collect()}
    assert got == {i: sum(max(0, int((min(b, e) - max(a, s)).total_seconds())) for s, e in wins) for i, a, b in spans}
    inside = {r.i: r.x for r in intervals.flag_in_window(df, clock, "a", "x").collect()}
    assert inside == {i: any(s <= a < e for s, e in wins) for i, a, _ in spans}


def test_clusters_and_islands(spark):
    pts = spark.createDataFrame([(1, 100.0), (1, 130.0), (1, 400.0), (1, 420.0), (1, 900.0)], "k int, x double")
    got = windows.clusters(pts, ["k"], "x", 50.0, 2, []).orderBy("x_from").collect()
    assert [(r.x_from, r.x_to, r["size"]) for r in got] == [(100.0, 130.0, 2), (400.0, 420.0, 2)]


def test_row_ids_are_consecutive(spark):
    df = spark.createDataFrame([(t % 7, k) for t in range(50) for k in range(3)], "t int, k int").withColumn("u", F.monotonically_increasing_id())
    got = windows.row_ids(df, ["t", "k", "u"], "id", 10).orderBy("t", "k", "u").collect()
    assert [r.id for r in got] == list(range(11, 161))


def test_heads_and_rest(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(7)] + [(2, 100, 1.0)], "g int, id int, p double")
    got = {(r.g, r.id): (r.item, r["count"]) for r in ranking.heads_and_rest(df, "g", [F.desc("p")], 3, "id").collect()}
    assert got == {(1, 6): ("single", 1), (1, 5): ("single", 1), (1, 4): ("single", 1), (1, 3): ("summary", 4), (2, 100): ("single", 1)}


def test_set_difference_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    r = sets.set_difference_counts(a, b).first()
    assert (r.lost, r.added, r.same) == (1, 1, False)


def test_scope_keeps_ancestors_as_folders(spark):
    o = spark.createDataFrame([(1, None, "d", 1), (2, 1, "c1", 2), (3, 1, "c2", 2), (4, 2, "s1", 3), (5, 3, "s2", 3)],
                              "id int, parent_id int, name string, level int")
    assert {(r.id, r.own) for r in tree.scope_objects(o, [2]).collect()} == {(1, False), (2, True), (4, True)}
    assert {r.id: r.path for r in tree.paths(o).collect()}[4] == "d → c1 → s1"


def test_overlap_after_the_calendar_ends(spark):
    """A span that ends after the last calendar day still holds the windows it has passed."""
    outages = spark.createDataFrame([(datetime(2024, 1, 5), datetime(2024, 1, 5, 6))], "start timestamp, end timestamp")
    clock = intervals.window_clock(outages, "2024-01-01", "2024-01-10")
    spans = [(0, datetime(2024, 1, 4), datetime(2024, 1, 12)), (1, datetime(2024, 1, 6), datetime(2024, 1, 12)), (2, datetime(2024, 1, 5, 3), None)]
    df = spark.createDataFrame(spans, "i int, a timestamp, b timestamp")
    got = {r.i: r.s for r in intervals.overlap_seconds(df, clock, F.col("a"), F.col("b"), "s").collect()}
    assert got[0] == 21600 and got[1] == 0


def test_closure_of_deep_trees(spark):
    from lullwatch.operators import tree

    rng = random.Random(8)
    parents = {k: rng.choice([k - 1, k - 1, k // 2]) or None for k in range(1, 120)}
    parents |= {500: 499, 499: 500 + 1, 501: None, 600: 600, 700: 12345}
    want = set()
    for k in parents:
        up, d = k, 0
        while up is not None and d < 200:
            want.add((up, k, d))
            up, d = (parents.get(up) if parents.get(up) != up else None), d + 1
    objects = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    assert {tuple(r) for r in tree.closure(objects).collect()} == want and tree.closure(objects).count() == len(want)
    with pytest.raises(ValueError):
        tree.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long"))


def test_row_ids_have_no_window_over_all_groups(spark):
    from lullwatch.operators.windows import id_band, row_ids

    rng = random.Random(3)
    rows = sorted({(datetime(2024, 1, 1) + timedelta(hours=rng.randrange(3000)), rng.randrange(10**6)) for _ in range(3000)})
    df = spark.createDataFrame(rows, "at timestamp, ch long").repartition(7)
    out = row_ids(df, ["at", "ch"], "id", 10, id_band("ch"))
    assert [(r.at, r.ch) for r in out.orderBy("id").collect()] == rows and out.agg(F.min("id"), F.max("id")).first() == (11, 10 + len(rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"windowspecdefinition\((\w+)#\w+ ASC", plan) == ["_block"]  # the only window without a partition runs over blocks
    for values, kind in ((range(50), "long"), ([f"k{k:03}" for k in range(50)], "string")):
        got = row_ids(spark.createDataFrame([(v,) for v in values], f"x {kind}"), ["x"], "id").orderBy("id").collect()
        assert [r.x for r in got] == list(values) and [r.id for r in got] == list(range(1, 51))


@pytest.mark.parametrize("direction,strict", [("backward", False), ("forward", True)])
def test_hot_days_are_cut_and_nothing_changes(spark, direction, strict):
    rng = random.Random(6)
    # half of all rows belong to one key and day
    made = lambda n, seed: [(1, 1440 + rng.randrange(0, 1440, 5), k + seed) if rng.random() < 0.5 else (rng.choice([1, 2, 3, None]), rng.randrange(0, 6 * 1440, 30), k + seed) for k in range(n)]
    left = spark.createDataFrame([(k, at(m), v) for k, m, v in made(400, 0)], "k long, ts timestamp, x long")
    right = spark.createDataFrame([(k, at(m), v) for k, m, v in made(400, 1000)], "k long, rts timestamp, w long")
    plain = lambda df: sorted(map(repr, df.collect()))
    want = asof_join(left, right, ["k"], "ts", "rts", ["w"], direction, strict)
    got = asof_join(left, right, ["k"], "ts", "rts", ["w"], direction, strict, split_rows=40)
    assert plain(got) == plain(want)
    hot = carry.hot_days([(left, "ts")], ["k"], 40).collect()
    assert [(r.k, r._day) for r in hot] == [(1, at(1440))]
    assert carry.with_bucket(left, "ts", "day", carry.hot_days([(left, "ts")], ["k"], 40)).filter("k = 1").select(carry.BUCKET).distinct().count() > 20
    spans = {"prev": ("x", None), "prev_even": ("x", F.col("x") % 2 == 0)}
    later = {"next": ("x", None)}
    assert plain(carry.neighbour_by(left, ["k"], ["ts", "x"], spans, later, split_rows=40)) == plain(carry.neighbour_by(left, ["k"], ["ts", "x"], spans, later))


def test_hours_and_pauses_of_a_hot_day(spark):
    from lullwatch.plans import journal as J
    from lullwatch.testbed.adapter import Bed

    b = Bed(spark, "/root/testdata/sf0.001")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(J.hourly_aggregates(b.events(), b.channels(), b.spec, split_rows=1)) == plain(J.hourly_aggregates(b.events(), b.channels(), b.spec, split_rows=None))
    assert plain(J.extract_gaps(b.events(), b.spec, split_rows=1)) == plain(J.extract_gaps(b.events(), b.spec, split_rows=None))
