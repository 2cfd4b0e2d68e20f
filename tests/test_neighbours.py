"""Nearest points equal brute force, whatever the density, and no leaf is too full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from percepta.operators import neighbours

SCHEMA = "cloud_id long, pt_idx long, x double, y double, z double"


def _frame(spark, clouds):
    return spark.createDataFrame([(c, i, *map(float, p)) for c, pts in clouds.items() for i, p in enumerate(pts)], SCHEMA).repartition(6)


def _brute(clouds, k):
    out = {}
    for c, pts in clouds.items():
        pts = np.asarray(pts, float)
        for i, p in enumerate(pts):
            d = np.sqrt(((p - pts) ** 2).sum(1))
            order = sorted(range(len(pts)), key=lambda j: (d[j], j != i, j))
            out[c, i] = order[:k]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r.cloud_id, r.pt_idx), []).append(r.nb)
    return out


@pytest.mark.parametrize(("k", "most"), [(1, 8), (4, 8), (7, 16), (5, None)])
def test_equals_brute_force(spark, k, most):
    rng = np.random.default_rng(k)
    dense = rng.normal(size=(250, 3)) * 1e-4  # half the points of a cloud in one spot of it
    clouds = {
        1: np.concatenate([dense, rng.uniform(-50, 50, (200, 3)), [[1e6, 0, 0], [1e6 + 1, 0, 0]]]),
        2: rng.integers(0, 4, (300, 3)),  # coinciding points and ties everywhere
        3: np.zeros((40, 3)),
        4: rng.normal(size=(3, 3)),
        5: np.stack([np.arange(120) ** 3.0, np.zeros(120), np.zeros(120)], 1),
        6: [[1.0, 2.0, 3.0]],
    }
    assert _got(neighbours.nearest(_frame(spark, clouds), k, most)) == _brute(clouds, k)


def test_no_leaf_is_too_full(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(size=(3000, 3)) * 1e-6, rng.uniform(-10, 10, (3000, 3))])
    df = _frame(spark, {1: pts}).withColumns({f"lo_{a}": F.lit(-10.0) for a in "xyz"}).withColumn("unit", F.lit(2.0**50 / 20))
    df = df.withColumns({f"i{a}": neighbours._place(F.col(a), a) for a in "xyz"})
    inside, _ = neighbours.leaves(df, 40)
    sizes = [r["count"] for r in inside.groupBy("level", "cx", "cy", "cz").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 40


def test_nulls_other_columns_and_empty(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, "a"), (1, 1, 1.0, 0.0, -0.0, None), (1, 2, None, 0.0, 0.0, "b"), (1, 3, float("nan"), 0.0, 0.0, "c"), (1, 4, float("inf"), 0.0, 0.0, "d"), (1, 5, -0.0, 0.0, 0.0, "e")]
    df = spark.createDataFrame(rows, SCHEMA + ", level string")
    assert _got(neighbours.nearest(df, 2)) == {(1, 0): [0, 5], (1, 1): [1, 0], (1, 5): [5, 0]}
    assert neighbours.nearest(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, 0)
