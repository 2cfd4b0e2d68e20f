"""Literal and brute-force cases of folds, fusion, boxes, grids, networks, adapters and odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from percepta.operators import adapters, boxes, fusion, grids, imitation, kalman, learning, motion, neighbours, networks, rasters, spatial, tracking


def test_kalman_goes_on_after_a_missing_measurement(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 2.0, None), (1, 3, 4.0, 4.0), (2, 1, None, 1.0), (2, 2, 5.0, 1.0), (None, 1, 1.0, 1.0)]
    got = {(r.track_id, r.frame_id): r for r in kalman.filter_tracks(spark.createDataFrame(rows, "track_id long, frame_id long, x double, y double")).collect()}
    assert len(got) == 5 and got[1, 2].y == 0.0 and got[1, 2].y_pp == pytest.approx(0.5 + 1.0 + 0.25) and 0 < got[1, 3].y < 4
    assert got[2, 1].x is None and got[2, 2].x == 5.0


def test_a_fold_of_one_long_key_is_linear(spark):
    df = spark.range(200_000).selectExpr("1 AS stream_id", "id AS seq", "20.0 + id % 30 AS latency_ms")
    assert learning.frame_control(df).count() == 200_000


def test_frame_control_rules(spark):
    def run(values, **options):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "stream_id long, seq long, latency_ms double")
        return learning.frame_control(df, **options).orderBy("seq").collect()

    one = run([200.0], alpha=1.0)
    assert one[0].scale < 1 and one[0].skip > 0 and 1 <= run([1000.0], alpha=1.0)[0].skip <= 4
    assert run([None, 10.0])[0].ewma is None
    assert [r.processed for r in run([1000.0, 1.0, 1.0, 1.0, 1.0, 1.0], alpha=1.0, gated=True)] == [True, False, False, False, False, True]
    with pytest.raises(Exception, match="below 0"):
        run([-1.0])
    with pytest.raises(ValueError):
        run([1.0], target=0)


STATES = "id long, acceleration double, steering_angle double, min_distance_to_obstacle double, speed double"


def test_safety_names_messages_and_nulls(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 5.0, 10.0), (2, None, None, None, None), (3, -7.0, 50.0, 0.5, 31.0)], STATES)
    got = {(r.id, r.name): r.message for r in learning.violations(df, learning.default_constraints(max_acceleration=3.0)).collect()}
    assert got[1, "acceleration_limit"] == "Constraint 'acceleration_limit' violated: 10.0000 > 3.0000"
    assert {n for i, n in got if i == 3} == {"acceleration_limit", "steering_limit", "collision_risk", "speed_limit"} and not any(i == 2 for i, _ in got)
    fixed = {r.id: (r.acceleration, r.steering_angle) for r in learning.corrected(df, 3.0).collect()}
    assert fixed == {1: (3.0, 20.0), 2: (None, None), 3: (-3.0, 45.0)}


def test_behaviour_names_and_history(spark):
    rows = [("stopped", 0.0, []), ("moving_straight", 0.0, []), ("turning", 0.1, None), ("moving_straight", 0.9, None)]
    f = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(rows)], "track_id long, pattern string, direction_variance double")
    assert [r.behaviour for r in motion.behaviour_pattern(f).orderBy("track_id").collect()] == ["stationary", "linear_motion", "curved_motion", "curved_motion"]
    item = "array<struct<heading_change:double,acceleration:double,direction_variance:double>>"
    cases = [([], "unknown"), ([(0.5, 0.0, 0.0)] * 4, "lane_change"), ([(0.0, 0.9, 0.0)], "acceleration_event"), ([(0.0, -0.9, 0.0)], "braking_event"), ([(0.0, 0.0, 0.9)], "curved_motion"), ([(0.0, 0.0, 0.0)], "linear_motion")]
    df = spark.createDataFrame([(i, "moving_straight", h) for i, (h, _) in enumerate(cases)], f"track_id long, pattern string, h {item}")
    assert [r.behaviour for r in motion.behaviour_pattern(df, "h").orderBy("track_id").collect()] == [w for _, w in cases]


def test_a_slope_at_or_below_zero_fails(spark):
    raster = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0)], "image_id long, y long, x long, depth double")
    refs = spark.createDataFrame([(1, 0, 0, 9.0), (1, 0, 1, 3.0)], "image_id long, y long, x long, metres double")
    with pytest.raises(Exception, match="no positive scale"):
        spatial.calibrated(raster, refs).collect()


EVENTS = "vehicle_id long, seq long, kind string, t double, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double, alt double, speed double, heading double, accuracy double"


def test_fusion(spark):
    imu = [(1, i, "imu", 0.1 * i, 1.0, 0.0, 9.8, 0.0, 0.0, 0.0, None, None, None, None, None, None) for i in range(5)]
    gps = [(2, 0, "gps", 0.0, None, None, None, None, None, None, 0.0, 0.0, 10.0, 5.0, 90.0, 2.0)]
    df = spark.createDataFrame(imu + gps, EVENTS)
    got = {(r.vehicle_id, r.seq): r for r in fusion.fused(df).collect()}
    assert got[1, 4].vx == pytest.approx(0.4) and got[1, 0].vx == 0 and got[1, 4].position_variance == pytest.approx(0.14)
    assert got[2, 0].pz > 0 and got[2, 0].vx == pytest.approx(5.0)
    stats = {r.vehicle_id: r for r in fusion.fusion_statistics(df, fusion.fused(df)).collect()}
    assert stats[1].imu_updates == 5 and stats[2].gps_updates == 1


def test_rotation_of_a_body(spark):
    row = spark.range(1).select(*[F.array(*r).alias(f"r{i}") for i, r in enumerate(fusion.rotation(F.lit(0.3), F.lit(-0.4), F.lit(1.1)))]).first()
    m = np.array(list(row))
    assert m @ m.T == pytest.approx(np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    assert fusion._turned([0.0] * 6 + [0.3, -0.4, 1.1], (1.0, 2.0, 3.0)) == pytest.approx(list(m @ [1.0, 2.0, 3.0]))


def test_boxes(spark):
    b = spark.createDataFrame([(1, "s", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, "s", 0.5, 0.0, 0.0, 1.0, 1.0, 1.0), (3, "s", 99.0, 0.0, 0.0, 1.0, 1.0, 1.0), (4, "s", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "box_id long, scene string, cx double, cy double, cz double, dx double, dy double, dz double").withColumn("rotation", boxes.unit_rotation())
    assert [(r.a, r.b, pytest.approx(r.iou, abs=1e-6)) for r in boxes.near_boxes(b, "scene").collect()] == [(1, 2, 0.747736033)]
    corner = boxes.corners(b.filter("box_id = 1")).orderBy("corner").collect()
    assert [(r.x, r.y, r.z) for r in corner] == [tuple(0.5 * v for v in s) for s in boxes.CORNERS]
    moved = boxes.moved(b.filter("box_id = 1"), [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]).first()
    assert (moved.cx, moved.cy, moved.cz) == (1, 2, 3) and moved.rotation == boxes.UNIT


def test_normals_of_a_plane(spark):
    rows = [(1, i, float(i % 6), float(i // 6), 0.1 * (i % 6)) for i in range(36)] + [(2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0)]
    got = neighbours.normals(spark.createDataFrame(rows, "cloud_id long, pt_idx long, x double, y double, z double"), 5).collect()
    want = np.array([-0.1, 0.0, 1.0]) / math.sqrt(1.01)
    assert all(abs(np.dot([r.nx, r.ny, r.nz], want)) == pytest.approx(1, abs=1e-6) for r in got if r.cloud_id == 1)
    assert len(got) == 38 and all((r.nx, r.ny, r.nz) == (0, 0, 0) for r in got if r.cloud_id == 2)


WALL = grids.Grid(10.0, 0.1, key="grid")


def wall(spark):
    return spark.createDataFrame([(1, 50, g, 1.0) for g in range(40, 61)], "grid long, gx int, gy int, value double")


def test_rays_and_sight(spark):
    rays = [(1, 0, -3.0, 0.0, 1.0, 0.0), (1, 1, -3.0, 0.0, 0.0, 0.0), (1, 2, 0.05, 0.0, 0.0, 1.0), (1, 3, -3.0, 3.0, 1.0, 0.0), (1, 4, -99.0, 0.0, 1.0, 0.0), (1, 5, -3.0, 0.0, -1.0, 0.0)]
    df = spark.createDataFrame(rays, "grid long, ray_id long, x double, y double, rx double, ry double")
    got = {r.ray_id: r.distance for r in grids.rays_hit(df, wall(spark), WALL).collect()}
    assert got[0] == pytest.approx(3.0, abs=0.11) and got[2] == 0 and all(got[i] is None for i in (1, 3, 4, 5))
    assert {r.ray_id: r.distance for r in grids.rays_hit(df, wall(spark), WALL, max_range=1.0).collect()}[0] is None
    lines = spark.createDataFrame([(1, 0, -3.0, 0.0, 3.0, 0.0), (1, 1, -3.0, 3.0, 3.0, 3.0), (1, 2, 1.0, 1.0, 1.0, 1.0), (1, 3, -3.0, 0.0, -1.0, 0.0)], "grid long, ray_id long, x double, y double, tx double, ty double")
    assert {r.ray_id: r.visible for r in grids.in_sight(lines, wall(spark), WALL).collect()} == {0: False, 1: True, 2: True, 3: True}


def test_rays_equal_steps(spark):
    rng = np.random.default_rng(2)
    g = grids.Grid(8.0, 0.5, key="grid")
    taken = {(int(a), int(b)) for a, b in rng.integers(0, 16, (40, 2))}
    rays = [(1, i, *map(float, rng.uniform(-4, 4, 2)), *map(float, rng.normal(size=2) * [1, i % 5 > 0])) for i in range(300)]

    def step(x, y, rx, ry):
        n = math.hypot(rx, ry)
        for t in np.arange(0, 12, 0.0005):
            cell = (math.floor((x + rx / n * t + 4) / 0.5), math.floor((y + ry / n * t + 4) / 0.5))
            if cell in taken:
                return t
        return None

    cells = spark.createDataFrame([(1, a, b, 1.0) for a, b in taken], "grid long, gx int, gy int, value double")
    got = {r.ray_id: r.distance for r in grids.rays_hit(spark.createDataFrame(rays, "grid long, ray_id long, x double, y double, rx double, ry double"), cells, g).collect()}
    want = {r[1]: step(*r[2:]) for r in rays}
    # A stride of 0.0005 may step over the corner of a cell.
    off = [i for i in got if (got[i] is None) != (want[i] is None) or (got[i] is not None and abs(got[i] - want[i]) > 0.002)]
    assert len(off) <= 2 and sum(v is not None for v in got.values()) > 100


def test_cloning_equals_one_machine(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "observation array<double>, action array<double>").repartition(5)
    model = networks.clone_behaviour(df, hidden=(4,), steps=3, rate=0.1, seed=1)
    w = networks.layers([3, 4, 2], 1)
    for _ in range(3):
        g, _ = networks._cloning(w, x, y)
        w = [a - 0.1 * b / 50 for a, b in zip(w, g, strict=True)]
    assert all(a == pytest.approx(b) for a, b in zip(model.weights, w, strict=True)) and len(model.history) == 3
    again = networks.clone_behaviour(df, hidden=(4,), steps=30, rate=0.0, seed=1, validation=df, patience=2)
    assert len(again.history) == 3
    with pytest.raises(ValueError):
        networks.clone_behaviour(df.limit(0))


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(5)
    weights = [rng.normal(size=s) * 0.5 for s in ((2, 12), (4, 12), (12,), (4, 2), (2,))]
    x, y = rng.normal(size=(6, 3, 2)), rng.normal(size=(6, 2))
    g, _ = networks._forecasting(weights, x, y)
    for k, w in enumerate(weights):
        for at in list(np.ndindex(w.shape))[::5]:
            kept = w[at]
            w[at] = kept + 1e-6
            up = networks._forecasting(weights, x, y)[1][0]
            w[at] = kept - 1e-6
            down = networks._forecasting(weights, x, y)[1][0]
            w[at] = kept
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def circles(spark, radii):
    rows = [(int(r), t + 1, r * math.cos(0.2 * t), r * math.sin(0.2 * t)) for r in radii for t in range(30)]
    return spark.createDataFrame(rows, "track_id long, frame_id long, x double, y double")


def test_a_learned_forecast_beats_constant_velocity(spark):
    model = networks.fit_forecast(circles(spark, [8, 10, 12, 15]), 5, 16, 80, 3e-2)
    held = circles(spark, [11]).filter("frame_id <= 25")
    truth = circles(spark, [11]).filter("frame_id > 25").selectExpr("track_id", "frame_id - 25 AS step", "x", "y")
    ade = lambda m: motion.displacement_errors(networks.forecast(held, m, 5, fitted=model), truth).first().ade
    assert ade("learned") < ade("cv")
    with pytest.raises(RuntimeError):
        networks.forecast(held, "learned")
    with pytest.raises(ValueError):
        networks.forecast(held, "other")
    with pytest.raises(ValueError):
        networks.fit_forecast(held.limit(3), 5, 4, 1)


def test_settings_round_trip(spark, tmp_path):
    networks.save_settings(spark, {"batch_size": 32, "hidden_sizes": [8, 8]}, str(tmp_path / "settings"))
    assert networks.load_settings(spark, str(tmp_path / "settings")) == {"batch_size": 32, "hidden_sizes": [8, 8]}


def test_demonstrations(spark):
    df = spark.range(20).selectExpr("id DIV 5 AS episode_id", "id % 5 AS step", "1.0 AS reward", "id % 5 = 4 AS done", "double(id) AS obs", "double(id + 1) AS nxt", "double(id) AS act")
    parts = {r.train: r.n for r in learning.train_part(df).groupBy("train").agg(F.count("*").alias("n")).collect()}
    assert parts == {True: 15, False: 5} and learning.train_part(df.limit(0)).count() == 0
    assert imitation.sample_trajectory(df, 7, 3).count() == 7 and imitation.sample_batch(df, 50).count() == 20
    with pytest.raises(ValueError):
        imitation.sample_trajectory(df, 21)
    noisy = imitation.with_noise(df, [("obs", "nxt")], ["act"], 0.1, 1).collect()
    assert all(r.nxt - r.obs == pytest.approx(1) for r in noisy) and any(abs(r.obs - r.act) > 1e-6 for r in noisy)
    zero = imitation.buffer_statistics(df.withColumn("done", F.lit(False))).first()
    assert (zero.num_episodes, zero.num_transitions, zero.avg_reward) == (0, 0, 0.0)


def test_forecast_samples(spark):
    two = [[[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [3.0, 0.0, 0.0]], [[0.0] * 3] * 3]
    kinds = {2: two[1], 3: two, 4: [two], 5: [[[two[0]], [two[1]]]]}
    for depth, value in kinds.items():
        kind = "array<" * depth + "double" + ">" * depth
        df = spark.createDataFrame([(7, value, [["why", None], ["because"]])], f"clip_id long, pred_xyz {kind}, cot array<array<string>>")
        points = adapters.waypoints(df)
        assert points.count() == (3 if depth == 2 else 6)
        if depth > 2:
            truth = points.filter("sample = 1").drop("sample")
            best = adapters.best_samples(adapters.sample_errors(points, truth)).first()
            assert (best.best_sample, best.min_ade) == (1, 0.0)
            assert {r.sample: r.ade for r in adapters.sample_errors(points, truth).collect()}[0] == 2.0
            assert {r.sample: r.reasoning for r in adapters.parsed(df, horizon=3).collect()} == {0: "why", 1: "because"}
            with pytest.raises(Exception, match="waypoints wanted"):
                adapters.parsed(df, horizon=9).collect()
    for bad in ([[1.0, float("nan"), 0.0]], [[1.0]], []):
        df = spark.createDataFrame([(1, [bad])], "clip_id long, pred_xyz array<array<array<double>>>")
        with pytest.raises(Exception):
            adapters.waypoints(df).collect()
    nine = spark.createDataFrame([(1, [[[float(i) for i in range(9)]]])], "clip_id long, pred_rot array<array<array<double>>>")
    assert adapters.rotations(nine).first().rotation == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0, 7.0, 8.0]]


def test_detector_arrays(spark):
    kind = "stream_id long, frame_id long, xyxy array<array<double>>, confidence array<double>, class_id array<int>"
    rows = [(1, 1, [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]], [0.9, 0.8], [1, 2]), (1, 2, [[0.0, 0.0, 1.0, 1.0]], None, None), (1, 3, [], None, None)]
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in adapters.detections(df).collect())
    assert got == [(1, 1, 0, 0.0, 0.0, 1.0, 1.0, 0.9, 1), (1, 1, 1, 2.0, 2.0, 3.0, 3.0, 0.8, 2), (1, 2, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0)]
    with pytest.raises(Exception, match="four numbers"):
        adapters.detections(spark.createDataFrame([(1, 1, [[0.0, 1.0]], None, None)], kind)).collect()


DETECTIONS = "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_occluded_tracks_move_on(spark):
    rows = [(1, f, 0, 100.0 + 10 * f, 100.0, 140.0 + 10 * f, 180.0, 0.9) for f in range(3)]
    ends = spark.createDataFrame([(1, 12)], "stream_id long, last_frame long")
    got = {r.frame_id: r for r in tracking.track_states(spark.createDataFrame(rows, DETECTIONS), max_age=5, ends=ends).collect()}
    assert sorted(got) == list(range(7)) and [got[f].misses for f in range(7)] == [0, 0, 0, 1, 2, 3, 4]
    assert got[3].x < got[4].x < got[5].x and got[5].x1 == 120.0 and got[6].confirmed and not got[0].confirmed


def test_crowded_assignment_equals_all_permutations(spark):
    from itertools import permutations

    rng = np.random.default_rng(8)
    tracks, dets, want = [], [], {}
    for frame in range(15):
        a, b = (rng.uniform(0, 12, (5, 2)) for _ in range(2))
        box = lambda p: [*map(float, p), *map(float, p + 30)]
        tracks += [(1, frame, i, *box(p)) for i, p in enumerate(a)]
        dets += [(1, frame, i, *box(p)) for i, p in enumerate(b)]
        c = tracking.costs(np.array([box(p) for p in a]), np.array([box(p) for p in b]))
        want[frame] = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5)))
    of = lambda rows, i: spark.createDataFrame(rows, f"stream_id long, frame_id long, {i} long, x1 double, y1 double, x2 double, y2 double")
    got = tracking.associated(of(tracks, "track_id"), of(dets, "det_idx")).groupBy("frame_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("n")).collect()
    assert {r.frame_id: pytest.approx(r.cost) for r in got} == want and all(r.n == 5 for r in got)
    assert tracking.associated(of(tracks[:2], "track_id"), of(dets, "det_idx").limit(0)).filter("det_idx is null").count() == 2


def test_dense_cells_are_dealt(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, (400, 3))
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(p)], "cloud_id long, pt_idx long, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((d > 0) & (d < 0.3)), strict=True) if a < b}
    got = [(r.a, r.b) for r in spatial.near_pairs(df, 0.3, cell_rows=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
