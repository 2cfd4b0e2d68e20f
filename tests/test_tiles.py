"""Stencils by tiles equal the same over whole images, whatever the side of a tile."""

import numpy as np
import pytest

from percepta.operators import rasters, tiles


def _images():
    rng = np.random.default_rng(2)
    return {"a": rng.integers(0, 9, (23, 31)).astype(float), "b": rng.integers(0, 9, (1, 40)).astype(float), "c": rng.integers(0, 9, (8, 8)).astype(float), "d": np.array([[5.0]])}


def _frame(spark, images):
    return spark.createDataFrame([(k, y, x, float(v), "other") for k, a in images.items() for (y, x), v in np.ndenumerate(a)], "image_id string, y int, x int, grey double, h_ string").repartition(5)


def _windows(a, r):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, "edge"), (2 * r + 1, 2 * r + 1))


def _sobel(a):
    w = _windows(a, 1)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return np.sqrt((w * k).sum((2, 3)) ** 2 + (w * k.T).sum((2, 3)) ** 2)


def _got(df, column):
    return {(r.image_id, r.y, r.x): r[column] for r in df.collect()}


@pytest.mark.parametrize("side", [4, 8, 64])
def test_tiles_equal_whole_images(spark, side):
    images = _images()
    df = _frame(spark, images)
    edge = _got(tiles.edges(df, side=side), "edge")
    sigma = _got(tiles.local_deviation(df, "grey", side), "sigma")
    most = _got(tiles.majorities(df.selectExpr("image_id", "y", "x", "if(grey > 4, 1, 0) as v"), "v", 2, side), "v")
    for k, a in images.items():
        mag = _sobel(a)
        for at in np.ndindex(a.shape):
            assert edge[(k, *at)] == (mag[at] > np.median(mag))
            assert sigma[(k, *at)] == pytest.approx(_windows(a, 1)[at].std(), abs=1e-6)
            assert most[(k, *at)] == (np.median(_windows((a > 4).astype(float), 2)[at]))
    assert len(edge) == len(sigma) == len(most) == sum(a.size for a in images.values())


def test_depth_from_edges_over_tiles(spark):
    a = _images()["a"]
    got = _got(rasters.depth_from_edges(_frame(spark, {"a": a})), "depth")
    mag = _sobel(a)
    marks = (mag > np.median(mag)).astype(float)
    assert got == {("a", *at): 3.5 if np.median(_windows(marks, 2)[at]) else 6.5 for at in np.ndindex(a.shape)}


def test_missing_repeated_and_empty(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, None), ("a", 9, 9, 3.0), ("a", 9, 9, 2.0), (None, 0, 0, 1.0), ("a", None, 0, 1.0), ("b", 0, 0, None)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, depth double")
    got = _got(tiles.local_deviation(df, side=4), "sigma")
    assert got == {("a", 0, 0): 0.0, ("a", 0, 1): 0.0, ("a", 9, 9): 0.0, ("b", 0, 0): None}
    assert tiles.local_deviation(df, side=4).count() == 4 and tiles.edges(df.limit(0), "depth").count() == 0
    with pytest.raises(ValueError):
        tiles.stencilled(df, "depth", 5, lambda w: w, "v", side=4)
