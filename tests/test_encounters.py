"""Pairs of tracks by reach: equal to all pairs, and of far fewer candidates."""

import numpy as np
import pytest

from percepta.operators import boxes, encounters

SCHEMA = "track_id long, x double, y double, vx double, vy double"


def tracks(spark, n, width, seed=1, fast=0):
    rng = np.random.default_rng(seed)
    at, v = rng.uniform(-width, width, (n, 2)), rng.normal(0, 1, (n, 2)) * np.exp(rng.normal(0, 1, (n, 1)))
    v[:fast] *= 300
    return at, v, spark.createDataFrame([(i, *map(float, (*at[i], *v[i]))) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("width", [20.0, 400.0])
def test_meeting_pairs_equal_all_pairs(spark, width):
    at, v, df = tracks(spark, 250, width, fast=3)
    v[10:14] = 0.0
    odd = [(1000, None, 1.0, 1.0, 1.0), (1001, 0.0, 0.0, None, 0.0), (None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *map(float, (*at[i], *v[i]))) for i in range(250)] + odd, SCHEMA)
    want = set()
    for a in range(250):
        for b in range(a + 1, 250):
            rel = np.hypot(*(v[b] - v[a]))
            if rel >= 0.1 and np.hypot(*(at[b] - at[a])) / (rel + 1e-6) < 3:
                want.add((a, b))
    got = encounters.meeting_pairs(df).collect()
    assert {(r.track_id_a, r.track_id_b) for r in got} == want and len(got) == len(want) > 50
    r = got[0]
    assert (r.dx, r.dvy) == (pytest.approx(at[r.track_id_b][0] - at[r.track_id_a][0]), pytest.approx(v[r.track_id_b][1] - v[r.track_id_a][1]))


def test_near_pairs_equal_all_pairs(spark):
    at, _, df = tracks(spark, 300, 30.0)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if np.hypot(*(at[b] - at[a])) <= 2.5}
    got = encounters.near_pairs(df, 2.5, ("vx",)).collect()
    assert {(r.track_id_a, r.track_id_b) for r in got} == want and len(got) == len(want) > 20
    assert encounters.near_pairs(df.limit(0), 2.5).count() == 0


def test_many_tracks_form_few_pairs(spark):
    """100,000 slow tracks and a few fast ones on a wide plane: the joins give less than a hundred pairs a track, not 5 · 10⁹."""
    _, _, df = tracks(spark, 100_000, 20_000.0, fast=5)
    out = encounters.meeting_pairs(df)
    n = out.count()
    plan = out._jdf.queryExecution().executedPlan()
    rows = [int(x) for x in _join_rows(plan)]
    assert 0 < n and rows and max(rows) < 10_000_000


def _join_rows(plan):
    """Rows that each join has put out."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if "Adaptive" in name:
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().get("numOutputRows").get().value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_crowded_cell_is_dealt_over_tasks(spark):
    rng = np.random.default_rng(12)
    p = rng.uniform(0, 1, (2600, 4))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "track_id long, x double, y double, vx double, vy double")
    apart, relative = (np.sqrt(((p[:, None, c] - p[None, :, c]) ** 2).sum(2)) for c in ([0, 1], [2, 3]))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((relative >= 0.1) & (apart / (relative + 1e-6) < 0.25)), strict=True) if a < b}
    made = encounters.meeting_pairs(df, 0.25)
    got = [(r.track_id_a, r.track_id_b) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    flat = spark.createDataFrame([(1, i, *map(float, v[:3]), 2.0, 2.0, 2.0) for i, v in enumerate(p)], "scene long, box_id long, cx double, cy double, cz double, dx double, dy double, dz double")
    boxed = boxes.near_boxes(flat, "scene")
    assert boxed.count() == boxed.select("a", "b").distinct().count() == 2600 * 2599 // 2
    for plan in (made, boxed):
        assert "share_" in plan._jdf.queryExecution().optimizedPlan().toString()
