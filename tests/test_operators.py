"""Literal cases whose values follow from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from percepta.operators import kalman, learning, motion, spatial


def track(spark, points):
    return spark.createDataFrame([(1, i + 1, float(x), float(y)) for i, (x, y) in enumerate(points)], "track_id long, frame_id long, x double, y double")


def test_kalman_values(spark):
    rows = kalman.filter_tracks(track(spark, [(100, 0), (110, 0), (120, 0), (130, 0)])).orderBy("frame_id").collect()
    got = [(r.x, r.vx, r.x_pp, r.x_pv, r.x_vv) for r in rows[1:]]
    want = [(106.363636, 3.636364, 0.636364, 0.363636, 1.636364), (117.647059, 8.342246, 0.764706, 0.470588, 1.695187), (129.137683, 10.20983, 0.784996, 0.465651, 1.686692)]
    assert all(g == pytest.approx(w, abs=1e-5) for g, w in zip(got, want, strict=True))


def test_constant_velocity(spark):
    rows = motion.forecast(track(spark, [(0, 0), (1, 0)]), "cv", 5).orderBy("step").collect()
    assert [r.x for r in rows] == [2, 3, 4, 5, 6]
    assert [r.x for r in motion.forecast(track(spark, [(3, 4)]), "ca", 2).collect()] == [3, 3]
    with pytest.raises(ValueError):
        motion.forecast(track(spark, [(0, 0)]), "other")


def test_iou(spark):
    def box(*v):
        return {c: F.lit(float(x)) for c, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)}

    cases = [box(0, 0, 10, 10), box(20, 20, 30, 30), box(5, 5, 15, 15), box(10, 0, 20, 10)]
    row = spark.range(1).select(*[spatial.iou(cases[0], c).alias(f"i{k}") for k, c in enumerate(cases)]).first()
    assert list(row) == pytest.approx([1.0, 0.0, 1 / 7, 0.0])


def test_clusters(spark):
    points = [(0, 0, 0), (0.1, 0, 0), (0, 0.1, 0), (10, 10, 0), (10.1, 10, 0), (10, 10.1, 0), (50, 0, 0)]
    df = spark.createDataFrame([(1, i, float(x), float(y), float(z), 0.0) for i, (x, y, z) in enumerate(points)], "cloud_id long, pt_idx long, x double, y double, z double, intensity double")
    assert {(r.pt_idx, r.cluster) for r in spatial.clusters(df, 0.5, 2).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)}


def test_advantages(spark):
    df = spark.createDataFrame([(1, i, r, v) for i, (r, v) in enumerate([(1.0, 1.0), (1.0, 1.5), (1.0, 1.0), (0.0, 0.0)])], "episode_id long, step long, reward double, value double")
    got = [r.advantage for r in learning.advantages(df, "value").orderBy("step").collect()]
    assert got == pytest.approx([1.945845, 0.49, 0.0, 0.0], abs=1e-6)


def test_morphology_offsets():
    assert spatial.offsets(3) == [-2, -1, 0, 1]
    assert spatial.offsets(5) == [-3, -2, -1, 0, 1, 2]


def test_intent_of_one_frame(spark):
    row = motion.intent(track(spark, [(1, 2)])).first()
    assert (row.intent, row.confidence, row.px, row.py) == ("unknown", 0.0, 1.0, 2.0)
    assert math.isclose(motion.position_uncertainty(track(spark, [(1, 2)])).first().sigma_v, 0.0)
