"""Scoring with reasons: trees walked row by row, calibration tables, kinds that training has not seen."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lullwatch.operators.segments import interpolate_by, points_table
from lullwatch.plans import model as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def slices(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        a, b, c = rng.random(), rng.choice([None, 0.0, 1.0, 5.0]), rng.randrange(9)
        rows.append((k % 40, a, b, float(c), int(a + 0.1 * c + rng.random() > 1.4), rng.choice(["x", "y"]), rng.choice(["link", "fault"])))
    df = spark.createDataFrame(rows, "ch long, a double, b double, c double, y int, sensor_type string, fault_kind string")
    return df.withColumn("T", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ch") * 3600))


@pytest.fixture(scope="module")
def fitted(slices):
    return M.fit_risk(slices, FEATURES, rounds=5, depth=3)


def test_contributions_add_up_to_the_margin(slices, fitted, tmp_path):
    raw = fitted.transform(M._assemble(slices, FEATURES)).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "probability", "rawPrediction", "prediction")
    rows = M.tree_contributions(raw, fitted, FEATURES, str(tmp_path / "m")).collect()
    assert len(rows) == 600 and len({tuple(r.contrib) for r in rows}) > 5
    for r in rows:
        assert math.isclose(r.base + sum(r.contrib), r.margin, abs_tol=1e-9)
    assert len({r.base for r in rows}) == 1


def test_top_factors_are_the_largest_contributions(slices, fitted, tmp_path):
    scored = M.raw_score(slices, fitted, FEATURES).withColumn("p", F.col("raw_p"))
    norms = M.feature_norms(slices, FEATURES)
    out = M.explain(scored, fitted, FEATURES, norms, k=2, path=str(tmp_path / "m"))
    contrib = {tuple(r[c] for c in ("ch", "a", "b", "c", "y")): r.contrib for r in M.tree_contributions(scored, fitted, FEATURES, str(tmp_path / "n")).collect()}
    norm_of = {r.sensor_type: r for r in norms.collect()}
    rows = out.collect()
    assert len(rows) == 600 and any(r.top_factors is None for r in rows)
    for r in rows:
        assert (r.top_factors is None) == (r.p < M.FACTOR_MIN_PROB)
        if r.top_factors:
            c = contrib[tuple(r[x] for x in ("ch", "a", "b", "c", "y"))]
            want = sorted(range(3), key=lambda i: (c[i] <= 0, -abs(c[i]), FEATURES[i]))[:2]
            assert [f.feature for f in r.top_factors] == [FEATURES[i] for i in want]
            for f in r.top_factors:
                assert f.contrib == pytest.approx(c[FEATURES.index(f.feature)], abs=1e-4) and f.norm == pytest.approx(norm_of[r.sensor_type][f.feature], abs=1e-4)
                assert f.value == (None if r[f.feature] is None else pytest.approx(r[f.feature], abs=1e-4))
    assert M.predictions(out, "v").filter("top_factors is not null").count() == sum(r.top_factors is not None for r in rows)


def test_calibration_is_monotone(slices, fitted):
    raw = M.raw_score(slices, fitted, FEATURES)
    rows = M.calibrate(raw, M.fit_calibration(raw)).select("raw_p", "p").orderBy("raw_p").collect()
    assert all(0 <= r.p <= 1 for r in rows) and all(x.p <= y.p + 1e-12 for x, y in zip(rows, rows[1:]))


def test_kinds_after_the_last_seen_get_no_share(slices, fitted):
    kinds = ["link", "fault", "disconnected", "value"]
    model = M.fit_kind(slices, FEATURES, kinds, trees=3, depth=2)
    rows = M.kind_probs(M.raw_score(slices, fitted, FEATURES).withColumn("p", F.lit(0.5)), model, FEATURES, kinds).select("kind_probs").collect()
    assert all(r.kind_probs["value"] == 0 and sum(r.kind_probs.values()) == pytest.approx(0.5, abs=2e-4) for r in rows)


def test_many_breakpoints(spark):
    rng = np.random.default_rng(2)
    xs, ys = np.sort(rng.random(100_000)), rng.random(100_000)
    x = np.concatenate((rng.random(2000) * 1.2 - 0.1, xs[:50], xs[-50:]))
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(9999, None)], "id long, x double")
    got = {r.id: r.y for r in interpolate_by(df, "x", points_table(spark, xs, ys), "y").collect()}
    assert got.pop(9999) is None and max(abs(got[k] - v) for k, v in enumerate(np.interp(x, xs, ys))) < 1e-9


def test_steps_and_single_points(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0)], "x double")
    got = [r.y for r in interpolate_by(df, "x", points_table(spark, [0, 1, 1, 1, 2], [0, 1, 7, 5, 6]), "y").orderBy("x").collect()]
    assert got == [0, 0, 0.5, 1, 5.5, 6, 6]
    assert {r.y for r in interpolate_by(df, "x", points_table(spark, [1], [4]), "y").collect()} == {4}
    with pytest.raises(ValueError):
        interpolate_by(df, "x", points_table(spark, [], []), "y")
