"""Groups that are one key or one cell: gate components, boxes of mixed sizes, long buffers."""

import numpy as np
import pytest

from percepta.operators import boxes, imitation, tracking

DETECTIONS = "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, confidence double"


def crowd(seed, frames=40, objects=30, width=400.0):
    """Boxes of several sizes that cross, vanish for some frames and overlap their neighbours: the gate is not one-to-one."""
    rng = np.random.default_rng(seed)
    at, v, size = rng.uniform(0, width, (objects, 2)), rng.normal(0, 3, (objects, 2)), rng.choice([20.0, 45.0, 130.0], objects)
    rows = []
    for f in range(frames):
        seen = np.flatnonzero(rng.random(objects) < 0.85)
        for d, k in enumerate(seen):
            x, y = at[k] + v[k] * f + rng.normal(0, 1, 2)
            rows.append((1 + int(k) % 2, f, d, float(x), float(y), float(x + size[k]), float(y + size[k] * 1.5), float(rng.random())))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {"max_age": 5}), (2, {"max_age": 2}), (3, {"max_age": 5, "high": 0.5, "low": 0.1})])
def test_gate_components_give_the_same_tracks(spark, seed, options):
    df = spark.createDataFrame(crowd(seed), DETECTIONS).repartition(5)
    whole = tracking.identified(df, **options)
    parts = tracking.identified(df, components=True, **options)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    found = tracking.gate_components(df, options["max_age"])
    sizes = [r["count"] for r in found.groupBy("group_id").count().collect()]
    assert len(sizes) > 10 and max(sizes) > 30 and sum(sizes) == df.count()


def test_components_of_odd_input(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 0.0, 9.0, None), (1, 1, 1, None, 0.0, 9.0, 9.0, 0.5), (1, 2, 0, 0.0, 0.0, 0.0, 9.0, 0.5), (None, 1, 0, 0.0, 0.0, 9.0, 9.0, 0.5)]
    df = spark.createDataFrame(rows, DETECTIONS)
    assert sorted(map(tuple, tracking.identified(df, components=True).collect())) == sorted(map(tuple, tracking.identified(df).collect()))
    assert tracking.identified(df.limit(0), components=True).count() == 0
    with pytest.raises(ValueError, match="reset"):
        tracking.identified(df, reset="x", components=True)


BOXES = "scene long, box_id long, cx double, cy double, cz double, dx double, dy double, dz double"


def test_near_boxes_of_mixed_sizes_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    n = 150
    at, size = rng.uniform(-30, 30, (n, 3)), np.exp(rng.normal(0, 1.5, (n, 3)))
    df = spark.createDataFrame([(k % 2, k, *map(float, (*at[k], *size[k]))) for k in range(n)], BOXES)
    want = {}
    for a in range(n):
        for b in range(a + 1, n):
            if a % 2 == b % 2:
                dist, most = np.linalg.norm(at[a] - at[b]), np.linalg.norm(size[a]) + np.linalg.norm(size[b])
                va, vb = size[a].prod(), size[b].prod()
                shared = (1 - dist / most) * min(va, vb)
                if dist < most and shared / (va + vb - shared) > 0:
                    want[a, b] = shared / (va + vb - shared)
    got = {(r.a, r.b): r.iou for r in boxes.near_boxes(df, "scene").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_giant_among_small_boxes_widens_no_cells(spark):
    """100,000 boxes and one as large as the scene: the join's pairs stay near the result."""
    from test_encounters import _join_rows

    rng = np.random.default_rng(6)
    n = 100_000
    at = rng.uniform(0, 3000, (n, 3)) * [1, 1, 0.01]
    rows = [(1, k, *map(float, at[k]), 4.0, 2.0, 1.5) for k in range(n)] + [(1, n, 1500.0, 1500.0, 15.0, 4000.0, 4000.0, 100.0)]
    out = boxes.near_boxes(spark.createDataFrame(rows, BOXES), "scene")
    found = out.count()
    assert found >= n and max(_join_rows(out._jdf.queryExecution().executedPlan())) <= 2 * found


@pytest.mark.parametrize("block", [40, 500_000])
def test_recorded_buffers_equal_the_loop(spark, block):
    rng = np.random.default_rng(7)
    rows = [(b, s, float(s), bool(rng.random() < 0.07) if s % 10 else None) for b, n in ((1, 700), (2, 90), (3, 1)) for s in range(n)]
    df = spark.createDataFrame(rows, "buffer_id long, seq long, reward double, done boolean").repartition(4)
    want = []
    for b in (1, 2, 3):
        episode, step, own = 0, 0, []
        for _, s, r, done in (x for x in rows if x[0] == b):
            step += 1
            own.append((b, s, r, done, episode, step))
            if done:
                episode, step = episode + 1, 0
        want += own[-150:]
    got = imitation.recorded(df, most=150, block=block)
    assert got.columns == [*df.columns, "episode", "step"] and sorted(map(tuple, got.collect())) == sorted(want)
