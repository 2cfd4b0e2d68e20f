"""Queries over the domain views of the driver tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from percepta.operators import encounters, kalman, learning, motion, rasters, spatial, tiles, tracking
from percepta.sources.views import view, with_view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to some digits, and -0.0 as 0.0."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def add(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    _QUERIES[name] = lambda spark, sf_dir: rounded(build(view(spark, sf_dir, source)), digits)
    if sql:
        _SQL[name] = with_view(source, sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _rs(names: str, digits: int = 6) -> str:
    return ", ".join(_r(n, n, digits) for n in names.split())


# Kalman filter

_AXIS = "{a}+v{a} AS q{a}, {a}_pp+2*{a}_pv+{a}_vv+0.25::DOUBLE AS a{a}, {a}_pv+{a}_vv AS b{a}, {a}_vv+1 AS c{a}"
_KF = f"""
kf AS (
  SELECT track_id, frame_id, x, 0.0::DOUBLE AS vx, 0.5::DOUBLE AS x_pp, 0.0::DOUBLE AS x_pv, 1.0::DOUBLE AS x_vv, y, 0.0::DOUBLE AS vy, 0.5::DOUBLE AS y_pp, 0.0::DOUBLE AS y_pv, 1.0::DOUBLE AS y_vv
  FROM v_positions WHERE frame_id = 1
  UNION ALL
  SELECT track_id, frame_id, qx + ax/(ax+1)*(zx-qx), vx + bx/(ax+1)*(zx-qx), ax*(1-ax/(ax+1)), bx*(1-ax/(ax+1)), cx-bx*bx/(ax+1),
         qy + ay/(ay+1)*(zy-qy), vy + by_/(ay+1)*(zy-qy), ay*(1-ay/(ay+1)), by_*(1-ay/(ay+1)), cy-by_*by_/(ay+1)
  FROM (SELECT p.track_id, p.frame_id, p.x AS zx, p.y AS zy, k.vx, k.vy, {_AXIS.format(a="x").replace("x+vx", "k.x+k.vx")}, {_AXIS.format(a="y").replace("y+vy", "k.y+k.vy").replace("AS by", "AS by_")}
        FROM kf k JOIN v_positions p ON p.track_id = k.track_id AND p.frame_id = k.frame_id + 1)
)"""
add("kf_02_track_states", "v_positions", kalman.filter_tracks, f"{_KF} SELECT track_id, frame_id, {_rs('x vx x_pp x_pv x_vv y vy y_pp y_pv y_vv', 4)} FROM kf", 4)
add(
    "kf_05_set_state",
    "v_positions",
    lambda d: kalman.filter_tracks_from(d.filter("frame_id > 3"), kalman.filter_tracks(d.filter("frame_id <= 3")).filter("frame_id = 3")),
    f"{_KF} SELECT track_id, frame_id, {_rs('x vx x_pp x_pv x_vv y vy y_pp y_pv y_vv', 4)} FROM kf WHERE frame_id > 3",
    4,
)
add("kf_05_last_states", "v_positions", lambda d: motion.latest(kalman.filter_tracks(d)).select("track_id", "frame_id", "x", "y", "vx", "vy"), f"{_KF} SELECT track_id, frame_id, {_rs('x y vx vy', 4)} FROM kf QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame_id DESC) = 1", 4)


def _mahalanobis(d: DataFrame) -> DataFrame:
    s = kalman.filter_tracks(d)
    return s.select("track_id", "frame_id", kalman.mahalanobis(s, F.lit(50.0), F.lit(50.0)).alias("distance"))


add("kf_06_mahalanobis", "v_positions", _mahalanobis, f"{_KF} SELECT track_id, frame_id, {_r('sqrt((50-x)*(50-x)/(x_pp+1)+(50-y)*(50-y)/(y_pp+1))', 'distance', 4)} FROM kf", 4)

# Association

_BOX = ["x1", "y1", "x2", "y2"]


def _consecutive(d: DataFrame) -> DataFrame:
    tracks = d.select("stream_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("obj").alias("track_id"), *_BOX)
    return spatial.cost_rows(tracks, d, ["stream_id", "frame_id"])


_PAIR = """
pair AS (SELECT d.stream_id, d.frame_id, t.obj AS track_id, d.det_idx, least(t.x2,d.x2)-greatest(t.x1,d.x1) AS w, least(t.y2,d.y2)-greatest(t.y1,d.y1) AS h,
  (t.x2-t.x1)*(t.y2-t.y1)+(d.x2-d.x1)*(d.y2-d.y1) AS areas, sqrt(power((t.x1+t.x2-d.x1-d.x2)/2,2)+power((t.y1+t.y2-d.y1-d.y2)/2,2)) AS dist
  FROM v_detections t JOIN v_detections d ON t.stream_id = d.stream_id AND t.frame_id + 1 = d.frame_id),
iou AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w*h/(areas-w*h) ELSE 0 END AS iou FROM pair)"""
add("asc_03_build_cost_matrix", "v_detections", _consecutive, f"{_PAIR} SELECT stream_id, frame_id, track_id, det_idx, {_rs('iou')}, {_r('dist*(1-iou)', 'cost')} FROM iou WHERE iou > 0.3")


def _associated(d: DataFrame) -> DataFrame:
    tracks = d.select("stream_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("obj").alias("track_id"), *_BOX)
    return tracking.associated(tracks, d).fillna(-1)


add(
    "asc_04_associate",
    "v_detections",
    _associated,
    f"""{_PAIR}, m AS (SELECT stream_id, frame_id, track_id, det_idx, dist*(1-iou) AS cost FROM iou WHERE iou > 0.3),
u AS (SELECT * FROM m
  UNION ALL SELECT stream_id, frame_id + 1, obj, NULL, NULL FROM v_detections t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.stream_id = t.stream_id AND m.frame_id = t.frame_id + 1 AND m.track_id = t.obj)
  UNION ALL SELECT stream_id, frame_id, NULL, det_idx, NULL FROM v_detections d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.stream_id = d.stream_id AND m.frame_id = d.frame_id AND m.det_idx = d.det_idx))
SELECT stream_id, frame_id, coalesce(track_id, -1) AS track_id, coalesce(det_idx, -1) AS det_idx, {_r('coalesce(cost, -1)', 'cost')} FROM u""",
)

# Trackers. An object of the view overlaps none but itself, so in SQL tracks are islands of its frames.


def _tracked(d: DataFrame, **options) -> DataFrame:
    return tracking.histories(tracking.identified(d, **options))


def _islands(rows: str, max_age: int) -> str:
    return f"""
g AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY stream_id, obj ORDER BY frame_id) <= {max_age} THEN 0 ELSE 1 END AS b FROM v_detections WHERE {rows}),
i AS (SELECT *, sum(b) OVER (PARTITION BY stream_id, obj ORDER BY frame_id) AS isl FROM g),
k AS (SELECT *, max(confidence) OVER (PARTITION BY stream_id, obj, isl ORDER BY frame_id) AS top FROM i)"""


def _tracks(first: float) -> str:
    return f"""
n AS (SELECT *, row_number() OVER w AS n, frame_id - lag(frame_id) OVER w - 1 AS gap, first_value(frame_id * 1000000 + det_idx) OVER w AS born FROM k WHERE top >= {first}::DOUBLE WINDOW w AS (PARTITION BY stream_id, obj, isl ORDER BY frame_id)),
t AS (SELECT stream_id, frame_id, det_idx, dense_rank() OVER (PARTITION BY stream_id ORDER BY born) AS track_id, n + 1 AS hit_streak, coalesce(gap, 0) AS misses, n >= 2 AS confirmed FROM n)"""


add("trk_06_mot", "v_detections", lambda d: _tracked(d, max_age=8), f"{_islands('true', 8)}, {_tracks(0)} SELECT * FROM t")
add("trk_06_gate_components", "v_detections", lambda d: _tracked(d, max_age=8, components=True), f"{_islands('true', 8)}, {_tracks(0)} SELECT * FROM t")
# Objects a quarter of a box apart overlap their neighbours: the gate isn't one-to-one, and the solver decides.
add("trk_06_ambiguous_gate", "v_detections", lambda d: _tracked(d.withColumns({"x1": F.col("obj") * 10.0 + F.col("x1") % 7, "x2": F.col("obj") * 10.0 + F.col("x1") % 7 + 40}), max_age=2, components=True))


def _with_resets(d: DataFrame) -> DataFrame:
    """The tracker starts anew every 40 frames, whose own detections are left out."""
    control = d.groupBy("stream_id").agg(F.max("frame_id").alias("last")).select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(40).cast("long"))).alias("frame_id"), F.lit(True).alias("reset"))
    return d.filter("frame_id % 40 > 0").withColumn("reset", F.lit(False)).unionByName(control, allowMissingColumns=True)


_EPOCHS = "(SELECT stream_id * 100000 + frame_id // 40 AS stream_id, frame_id, det_idx, obj, confidence FROM v_detections WHERE frame_id % 40 > 0)"
add(
    "trk_11_reset",
    "v_detections",
    lambda d: _tracked(_with_resets(d), max_age=8, reset="reset").select("stream_id", "frame_id", "det_idx", "track_id"),
    f"{_islands('true', 8).replace('FROM v_detections WHERE true', f'FROM {_EPOCHS}')}, {_tracks(0)} SELECT stream_id // 100000 AS stream_id, frame_id, det_idx, track_id FROM t",
)
add("trk_12_two_stage", "v_detections", lambda d: _tracked(d, max_age=8, high=0.5, low=0.1), f"{_islands('confidence >= 0.1::DOUBLE', 8)}, {_tracks(0.5)} SELECT * FROM t")
add("trk_10_statistics", "v_detections", lambda d: tracking.statistics(_tracked(d, max_age=3), 3), f"{_islands('true', 3)}, {_tracks(0)}, l AS (SELECT stream_id, track_id, max(frame_id) AS f, bool_or(confirmed) AS c FROM t GROUP BY 1, 2), e AS (SELECT stream_id, max(f) AS current_frame, max(track_id) + 1 AS next_track_id FROM l GROUP BY 1) SELECT stream_id, current_frame, next_track_id, count(*) FILTER (WHERE current_frame - f < 3) AS total, count(*) FILTER (WHERE current_frame - f < 3 AND c) AS confirmed FROM l JOIN e USING (stream_id) GROUP BY 1, 2, 3")

# Forecasts and uncertainty

_D = """
d1 AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM v_positions WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
d AS (SELECT *, vx - lag(vx) OVER w AS ax, vy - lag(vy) OVER w AS ay FROM d1 WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame_id DESC) = 1)"""
_STEPS = "(SELECT unnest([1,2,3,4,5]) AS step)"
_CV = ("x + coalesce(vx,0)*step", "y + coalesce(vy,0)*step")
_CA = ("x + coalesce(vx,0)*step + coalesce(ax,0)*step*step/2", "y + coalesce(vy,0)*step + coalesce(ay,0)*step*step/2")
add("prd_01_cv_predict", "v_positions", lambda d: motion.forecast(d, "cv", 1).drop("step"), f"{_D} SELECT track_id, {_r(_CV[0].replace('*step', ''), 'x')}, {_r(_CV[1].replace('*step', ''), 'y')} FROM l")
add("prd_02_cv_trajectory", "v_positions", lambda d: motion.forecast(d, "cv", 5), f"{_D} SELECT track_id, step, {_r(_CV[0], 'x')}, {_r(_CV[1], 'y')} FROM l, {_STEPS}")
add("prd_04_ca_trajectory", "v_positions", lambda d: motion.forecast(d, "ca", 5), f"{_D} SELECT track_id, step, {_r(_CA[0], 'x')}, {_r(_CA[1], 'y')} FROM l, {_STEPS}")


def _held_back(d: DataFrame) -> DataFrame:
    """The forecast of every track's last five frames from those before, against these frames."""
    end = d.groupBy("track_id").agg(F.max("frame_id").alias("end"))
    cut = d.join(end, "track_id")
    truth = cut.filter("frame_id > end - 5").select("track_id", (F.col("frame_id") - F.col("end") + 5).alias("step"), "x", "y")
    return motion.displacement_errors(motion.forecast(cut.filter("frame_id <= end - 5").drop("end"), "ca", 5), truth)


add(
    "prd_11_ade_fde",
    "v_positions",
    _held_back,
    f"""q AS (SELECT *, max(frame_id) OVER (PARTITION BY track_id) AS n FROM v_positions),
c AS (SELECT track_id, frame_id, x, y, x-lag(x) OVER w AS vx, y-lag(y) OVER w AS vy, x-2*lag(x) OVER w+lag(x, 2) OVER w AS ax, y-2*lag(y) OVER w+lag(y, 2) OVER w AS ay FROM q WHERE frame_id <= n-5 WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame_id DESC) = 1),
e AS (SELECT track_id, frame_id-n+5 AS step, sqrt(power({_CA[0].replace('x +', 'l.x +', 1)}-q.x, 2)+power({_CA[1].replace('y +', 'l.y +', 1)}-q.y, 2)) AS e FROM (SELECT track_id, n, frame_id, x, y, frame_id-n+5 AS step FROM q WHERE frame_id > n-5) q JOIN (SELECT track_id, x, y, vx, vy, ax, ay FROM l) l USING (track_id))
SELECT track_id, {_r('avg(e)', 'ade')}, {_r('max_by(e, step)', 'fde')} FROM e GROUP BY track_id""",
)
add("unc_01_position", "v_positions", motion.position_uncertainty, f"{_D} SELECT track_id, {_r('coalesce(sqrt(vx*vx+vy*vy)*0.5, 0)', 'sigma_v')}, {_r('coalesce(sqrt(ax*ax+ay*ay)*0.2, 0)', 'sigma_a')} FROM l")
add("unc_02_forecast", "v_positions", motion.forecast_uncertainty, f"{_D} SELECT track_id, step, {_r('sqrt(power((vx*vx+vy*vy)*0.5*step,2)+power((ax*ax+ay*ay)*0.2*step,2))', 'sigma')} FROM l, {_STEPS}")
add("unc_03_ellipse", "v_positions", lambda d: motion.confidence_ellipse(d.groupBy("track_id").agg(F.covar_samp("x", "x").alias("a"), F.covar_samp("x", "y").alias("b"), F.covar_samp("y", "y").alias("c")), F.col("a"), F.col("b"), F.col("c")).select("track_id", "major", "minor", "angle"), f"c AS (SELECT track_id, covar_samp(x,x) AS a, covar_samp(x,y) AS b, covar_samp(y,y) AS c FROM v_positions GROUP BY track_id) SELECT track_id, {_r('2*sqrt((a+c)/2+sqrt((a-c)*(a-c)/4+b*b))', 'major')}, {_r('2*sqrt(greatest((a+c)/2-sqrt((a-c)*(a-c)/4+b*b),0))', 'minor')}, {_r('atan2(2*b,a-c)/2', 'angle')} FROM c")
add("unc_04_velocity", "v_positions", motion.velocity_uncertainty, f"{_D} SELECT track_id, {_r('coalesce(stddev_pop(sqrt(ax*ax+ay*ay)),0)', 'sigma')} FROM d GROUP BY track_id")
add("unc_05_trajectory", "v_positions", motion.step_uncertainty, f"{_D} SELECT track_id, frame_id, {_r('sqrt(vx*vx+vy*vy)*0.5', 'sigma')} FROM d WHERE vx IS NOT NULL")

# Behaviour and intent

_FEAT = f"""{_D},
u AS (SELECT *, sqrt(vx*vx+vy*vy) AS s, atan2(vy,vx) AS hd, lag(vx) OVER w AS px, lag(vy) OVER w AS py FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
t AS (SELECT *, CASE WHEN s > 0 AND px*px+py*py > 0 THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (vx*px+vy*py)/(s*sqrt(px*px+py*py))))) END AS turn FROM u),
f AS (SELECT track_id, max_by(s, frame_id) AS speed, CASE WHEN min(s) > 1e-6 THEN avg(turn) ELSE 0 END AS angular_velocity, max_by(sqrt(ax*ax+ay*ay), frame_id) AS acceleration,
  var_pop(s) AS speed_variance, var_pop(hd) AS direction_variance, abs(max_by(hd, frame_id) - min_by(hd, frame_id) FILTER (WHERE hd IS NOT NULL)) AS heading_change FROM t GROUP BY track_id),
m AS (SELECT *, CASE WHEN speed < 1 THEN 'stopped' WHEN angular_velocity > 0.1 THEN 'turning' WHEN acceleration > 0.5 THEN 'accelerating' ELSE 'moving_straight' END AS pattern,
  CASE WHEN speed < 1 THEN 0.95 WHEN angular_velocity > 0.1 THEN least(0.9::DOUBLE, angular_velocity/0.2) WHEN acceleration > 0.5 THEN least(0.9::DOUBLE, acceleration) ELSE 0.8 END AS confidence FROM f)"""
_SIX = "speed angular_velocity acceleration speed_variance direction_variance heading_change"
add("beh_01_motion_features", "v_positions", motion.motion_features, f"{_FEAT} SELECT track_id, {_rs(_SIX)} FROM f")
add("beh_02_motion_pattern", "v_positions", lambda d: motion.motion_pattern(motion.motion_features(d)).select("track_id", "pattern", "confidence"), f"{_FEAT} SELECT track_id, pattern, {_rs('confidence')} FROM m")
add("beh_03_behaviour_pattern", "v_positions", lambda d: motion.behaviour_pattern(motion.motion_pattern(motion.motion_features(d))).select("track_id", "behaviour"), f"{_FEAT} SELECT track_id, CASE WHEN pattern = 'stopped' THEN 'stationary' WHEN direction_variance > 0.5 OR pattern = 'turning' THEN 'curved_motion' ELSE 'linear_motion' END AS behaviour FROM m")


def _remembered(d: DataFrame) -> DataFrame:
    """Patterns with the features of up to five tracks, the own one last, as their history."""
    last = Window.partitionBy(F.col("track_id") % 10).orderBy("track_id").rowsBetween(-4, 0)
    return motion.motion_pattern(motion.motion_features(d)).withColumn("past", F.collect_list(F.struct("heading_change", "acceleration", "direction_variance")).over(last))


_MEAN = "CASE WHEN count({c}) OVER w = count(*) OVER w THEN avg({c}) OVER w END"
add(
    "beh_03_with_history",
    "v_positions",
    lambda d: motion.behaviour_pattern(_remembered(d), "past").select("track_id", "behaviour"),
    f"""{_FEAT}, h AS (SELECT *, row_number() OVER (PARTITION BY track_id % 10 ORDER BY track_id) AS n, {_MEAN.format(c='heading_change')} AS mh, {_MEAN.format(c='acceleration')} AS ma FROM m WINDOW w AS (PARTITION BY track_id % 10 ORDER BY track_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT track_id, CASE WHEN pattern = 'stopped' THEN 'stationary' WHEN n > 3 AND mh > 0.3 THEN 'lane_change' WHEN ma > 0.5 THEN 'acceleration_event' WHEN ma < -0.5 THEN 'braking_event' WHEN direction_variance > 0.5 OR pattern = 'turning' THEN 'curved_motion' ELSE 'linear_motion' END AS behaviour FROM h""",
)


def _on_course(d: DataFrame) -> DataFrame:
    last = motion.latest(d).select("track_id", "x", "y").join(motion.motion_features(d), "track_id")
    pairs = encounters.near_pairs(last, 2.0, ("speed",))
    return motion.collision_course(pairs).select(F.col("track_id_a").alias("track_a"), F.col("track_id_b").alias("track_b"), "on_course")


add("beh_06_collision_course", "v_positions", _on_course, f"{_FEAT}, p AS (SELECT f.track_id, speed, x, y FROM f JOIN l USING (track_id)) SELECT a.track_id AS track_a, b.track_id AS track_b, NOT (a.speed < 0.1 AND b.speed < 0.1) AS on_course FROM p a JOIN p b ON a.track_id < b.track_id AND sqrt(power(b.x-a.x,2)+power(b.y-a.y,2)) <= 2")
add("beh_07_lane_change", "v_positions", lambda d: motion.motion_features(d).join(d.groupBy("track_id").agg(F.count("*").alias("n")), "track_id").select("track_id", ((F.col("heading_change") > 0.3) & (F.col("n") > 10)).alias("lane_change")), f"{_FEAT} SELECT track_id, heading_change > 0.3 AND n > 10 AS lane_change FROM f JOIN (SELECT track_id, count(*) AS n FROM v_positions GROUP BY track_id) USING (track_id)")
_INT = f"""{_D},
h1 AS (SELECT *, atan2(vy,vx) - lag(atan2(vy,vx)) OVER (PARTITION BY track_id ORDER BY frame_id) AS hc, sqrt(vx*vx+vy*vy) AS s FROM d),
h AS (SELECT *, (ax*vx+ay*vy)/(s+1e-6) AS al FROM h1 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame_id DESC) = 1),
i AS (SELECT *, CASE WHEN s < 0.5 THEN 'stop' WHEN al > 0.5 THEN 'accelerate' WHEN al < -0.5 THEN 'decelerate' WHEN hc > 0.2 THEN 'turn_left' WHEN hc < -0.2 THEN 'turn_right' ELSE 'continue' END AS intent,
  CASE WHEN s < 0.5 THEN 0.95 WHEN abs(al) > 0.5 THEN least(0.9::DOUBLE, abs(al)) WHEN abs(hc) > 0.2 THEN 0.8 ELSE 0.85 END AS confidence FROM h)"""
add("int_01_predict_intent", "v_positions", motion.intent, f"{_INT} SELECT track_id, intent, {_rs('confidence')}, {_r('CASE WHEN s < 0.5 THEN x ELSE x+vx END', 'px')}, {_r('CASE WHEN s < 0.5 THEN y ELSE y+vy END', 'py')} FROM i")


def _pairs(d: DataFrame) -> DataFrame:
    return encounters.meeting_pairs(motion.latest(motion.differences(d)), 0.25)


# The view's tracks cross the plane in a few frames, so the time within which pairs meet is a quarter of a second here.
_TTC = f"""{_D}, p AS (SELECT a.track_id AS track_id_a, b.track_id AS track_id_b, sqrt(power(b.x-a.x,2)+power(b.y-a.y,2)) AS dist, sqrt(power(b.vx-a.vx,2)+power(b.vy-a.vy,2)) AS rel
  FROM l a JOIN l b ON a.track_id < b.track_id), q AS (SELECT *, dist/(rel+1e-6) AS ttc FROM p WHERE rel >= 0.1 AND dist/(rel+1e-6) < 0.25)"""
add("int_05_time_to_collision", "v_positions", lambda d: motion.time_to_collision(_pairs(d), 0.25).select("track_id_a", "track_id_b", "ttc", "collision", "confidence", "reason"), f"{_TTC} SELECT track_id_a, track_id_b, {_r('ttc', 'ttc')}, true AS collision, {_r('CASE WHEN ttc <= 0 THEN 0 ELSE greatest(0, least(1, 1-ttc/0.25::DOUBLE)) END', 'confidence')}, printf('TTC: %.2fs, distance: %.2fm', ttc, dist) AS reason FROM q")

# Point clouds

_RANGE = "sqrt(x*x+y*y+z*z)"
_XYZ = _rs("x y z intensity")
add("lid_01_filter_range", "v_points", lambda d: spatial.in_range(d, 0.5, 20.0), f"SELECT cloud_id, pt_idx, {_XYZ} FROM v_points WHERE {_RANGE} BETWEEN 0.5 AND 20")
add("lid_02_filter_height", "v_points", lambda d: spatial.in_height(d, 0.0, 2.0), f"SELECT cloud_id, pt_idx, {_XYZ} FROM v_points WHERE z BETWEEN 0 AND 2")
add("lid_03_voxelize", "v_points", lambda d: spatial.voxelize(d, 4.3), f"SELECT cloud_id, CAST(floor(x/4.3::DOUBLE) AS BIGINT) AS vx, CAST(floor(y/4.3::DOUBLE) AS BIGINT) AS vy, CAST(floor(z/4.3::DOUBLE) AS BIGINT) AS vz, {_r('avg(x)', 'x', 11)}, {_r('avg(y)', 'y', 11)}, {_r('avg(z)', 'z', 11)}, {_r('avg(intensity)', 'intensity', 11)}, count(*) AS n FROM v_points GROUP BY 1, 2, 3, 4", 11)
add("lid_04_downsample", "v_points", lambda d: spatial.sampled(d, 50), f"SELECT cloud_id, pt_idx, {_XYZ} FROM v_points QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY md5(CAST(pt_idx AS VARCHAR)), pt_idx) <= 50")
add("lid_05_statistics", "v_points", spatial.cloud_statistics, "SELECT cloud_id, count(*) AS n, " + ", ".join(_r(f"{f}({c})", f"{n}_{c}") for c in "xyz" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + f", {_r(f'max({_RANGE})', 'max_range')} FROM v_points GROUP BY cloud_id")
add("lid_06_process_raw", "v_points", lambda d: spatial.in_height(spatial.in_range(d, 0.5, 100.0), -1.0, 5.0), f"SELECT cloud_id, pt_idx, {_XYZ} FROM v_points WHERE {_RANGE} BETWEEN 0.5 AND 100 AND z BETWEEN -1 AND 5")
add("lid_07_remove_ground", "v_points", spatial.without_ground, f"SELECT cloud_id, pt_idx, {_XYZ} FROM v_points WHERE z >= 0.5")
_NEAR = "nb AS (SELECT a.cloud_id, a.pt_idx AS a, b.pt_idx AS b FROM v_points a JOIN v_points b ON a.cloud_id = b.cloud_id WHERE power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2) > 0 AND sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)) < 1.77)"
add("lid_08_neighbours", "v_points", lambda d: spatial.neighbour_counts(d, 1.77), f"{_NEAR} SELECT cloud_id, a AS pt_idx, count(*) AS n FROM nb GROUP BY 1, 2")
_DBSCAN = f"""{_NEAR}, core AS (SELECT cloud_id, a FROM nb GROUP BY 1, 2 HAVING count(*) >= 3),
ed AS (SELECT nb.* FROM nb SEMI JOIN core c ON nb.cloud_id = c.cloud_id AND nb.a = c.a SEMI JOIN core e ON nb.cloud_id = e.cloud_id AND nb.b = e.a),
reach AS (SELECT cloud_id, a, a AS r FROM core UNION SELECT reach.cloud_id, ed.b, reach.r FROM reach JOIN ed ON reach.cloud_id = ed.cloud_id AND reach.a = ed.a WHERE reach.r < ed.b),
lab AS (SELECT cloud_id, a, min(r) AS cluster FROM reach GROUP BY 1, 2),
bord AS (SELECT nb.cloud_id, nb.b AS a, min(lab.cluster) AS cluster FROM nb JOIN lab ON nb.cloud_id = lab.cloud_id AND nb.a = lab.a ANTI JOIN core c ON nb.cloud_id = c.cloud_id AND nb.b = c.a GROUP BY 1, 2),
al AS (SELECT * FROM lab UNION ALL SELECT * FROM bord)
SELECT cloud_id, a AS pt_idx, cluster FROM al QUALIFY count(*) OVER (PARTITION BY cloud_id, cluster) >= 3"""
add("lid_09_clusters", "v_points", lambda d: spatial.clusters(d, 1.77, 3), _DBSCAN)
_T = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
add("lid_11_transform", "v_points", lambda d: spatial.transformed(d, _T), f"SELECT cloud_id, pt_idx, {_r('1-y', 'x')}, {_r('x+2', 'y')}, {_r('z+3', 'z')}, {_rs('intensity')} FROM v_points")
add("lid_12_count", "v_points", lambda d: d.groupBy("cloud_id").agg(F.count("*").alias("n")), "SELECT cloud_id, count(*) AS n FROM v_points GROUP BY cloud_id")

# Occupancy grids of 50 m at 0.7 m: 71 cells a side

_OCC = "g AS (SELECT DISTINCT cloud_id, CAST(trunc((x+25)/0.7::DOUBLE) AS INT) AS gx, CAST(trunc((y+25)/0.7::DOUBLE) AS INT) AS gy FROM v_points WHERE z BETWEEN 0 AND 2), c AS (SELECT * FROM g WHERE gx BETWEEN 0 AND 70 AND gy BETWEEN 0 AND 70)"
_OFF = "(SELECT unnest([-2,-1,0,1]) AS dx) o1, (SELECT unnest([-2,-1,0,1]) AS dy) o2"


def _grid(d: DataFrame) -> DataFrame:
    return spatial.occupied(d, 50.0, 0.7, 0.0, 2.0)


add("occ_12_from_point_cloud", "v_points", _grid, f"{_OCC} SELECT * FROM c")
add("occ_02_grid_to_world", "v_points", lambda d: _grid(d).select("cloud_id", (F.col("gx") * 0.7 - 25).alias("wx"), (F.col("gy") * 0.7 - 25).alias("wy")), f"{_OCC} SELECT cloud_id, {_r('gx*0.7::DOUBLE-25', 'wx')}, {_r('gy*0.7::DOUBLE-25', 'wy')} FROM c")
add("occ_08_dilate", "v_points", lambda d: spatial.dilated(_grid(d), 71), f"{_OCC} SELECT DISTINCT cloud_id, gx+dx AS gx, gy+dy AS gy FROM c, {_OFF} WHERE gx+dx BETWEEN 0 AND 70 AND gy+dy BETWEEN 0 AND 70")
add("occ_09_erode", "v_points", lambda d: spatial.eroded(spatial.dilated(_grid(d), 71), 71), f"{_OCC}, k AS (SELECT DISTINCT cloud_id, gx+dx AS gx, gy+dy AS gy FROM c, {_OFF} WHERE gx+dx BETWEEN 0 AND 70 AND gy+dy BETWEEN 0 AND 70), n AS (SELECT cloud_id, gx-dx AS gx, gy-dy AS gy, count(*) AS n FROM k, {_OFF} GROUP BY 1, 2, 3) SELECT cloud_id, gx, gy FROM n WHERE gx BETWEEN 0 AND 70 AND gy BETWEEN 0 AND 70 AND n = (least(70,gx+1)-greatest(0,gx-2)+1)*(least(70,gy+1)-greatest(0,gy-2)+1)")
add("occ_10_connectivity", "v_points", lambda d: spatial.connectivity(_grid(d)), f"{_OCC} SELECT a.cloud_id, a.gx, a.gy, count(b.gx) AS n FROM c a LEFT JOIN c b ON a.cloud_id = b.cloud_id AND abs(a.gx-b.gx) <= 1 AND abs(a.gy-b.gy) <= 1 AND (a.gx <> b.gx OR a.gy <> b.gy) GROUP BY 1, 2, 3")

# Depth rasters

add("dep_03_upsample", "v_pixels", lambda d: spatial.repeated(d, 2), f"SELECT image_id, y*2+dy AS y, x*2+dx AS x, {_rs('depth')} FROM v_pixels, (SELECT unnest([0,1]) AS dy) a, (SELECT unnest([0,1]) AS dx) b")
add("dep_04_downsample", "v_pixels", lambda d: spatial.block_mean(d, 3), f"SELECT image_id, CAST(floor(y/3) AS BIGINT) AS y, CAST(floor(x/3) AS BIGINT) AS x, {_r('avg(depth)', 'depth')} FROM v_pixels WHERE y < 9 AND x < 9 GROUP BY 1, 2, 3")
add("dep_05_calibrate", "v_pixels", lambda d: spatial.calibrated(d, d.filter("y = x").select("image_id", "y", "x", (F.col("depth") * 1.5 + F.col("y") / 10.0).alias("metres"))).select("image_id", "y", "x", "depth"), f"f AS (SELECT image_id, regr_slope(depth*1.5+y/10.0, depth) AS a, regr_intercept(depth*1.5+y/10.0, depth) AS b FROM v_pixels WHERE y = x GROUP BY 1) SELECT image_id, y, x, {_r('greatest(a*depth+b, 1e-6)', 'depth')} FROM v_pixels JOIN f USING (image_id)")
add("dep_06_to_3d", "v_pixels", lambda d: spatial.back_projected(d, 500.0, 500.0, 5.0, 5.0, 2.5, 6.0), f"SELECT image_id, y, x, {_r('(x-5)*depth/500', 'px')}, {_r('(y-5)*depth/500', 'py')}, {_r('depth', 'pz')} FROM v_pixels WHERE depth BETWEEN 2.5 AND 6")
_ST = "s AS (SELECT p.image_id, p.y, p.x, dy, dx, q.grey AS v, q.depth AS w FROM v_pixels p, (SELECT unnest([-1,0,1]) AS dy) a, (SELECT unnest([-1,0,1]) AS dx) b JOIN v_pixels q ON q.image_id = p.image_id AND q.y = greatest(0, least(9, p.y+dy)) AND q.x = greatest(0, least(9, p.x+dx)))"
add("dep_08_sobel", "v_pixels", tiles.magnitudes, f"{_ST} SELECT image_id, y, x, {_r('sqrt(power(sum(v*dx*(2-abs(dy))),2)+power(sum(v*dy*(2-abs(dx))),2))', 'mag')} FROM s GROUP BY 1, 2, 3")
add("dep_08_edges", "v_pixels", lambda d: tiles.edges(d.withColumn("grey", F.round(F.col("grey") * 255))).select("image_id", "y", "x", "edge"), f"{_ST}, m AS (SELECT image_id, y, x, sqrt(power(sum(round(v*255)*dx*(2-abs(dy))),2)+power(sum(round(v*255)*dy*(2-abs(dx))),2)) AS mag FROM s GROUP BY 1, 2, 3) SELECT image_id, y, x, mag > quantile_cont(mag, 0.5) OVER (PARTITION BY image_id) AS edge FROM m")
add("dep_11_normalise", "v_pixels", rasters.depth_from_inverse, f"m AS (SELECT *, min(inv_depth) OVER (PARTITION BY image_id) AS lo, max(inv_depth) OVER (PARTITION BY image_id) AS hi FROM v_pixels) SELECT image_id, y, x, {_r('CASE WHEN hi > lo THEN 10-(inv_depth-lo)/(hi-lo)*9.9 ELSE 10 END', 'depth')} FROM m")
add("dep_13_uncertainty", "v_pixels", tiles.local_deviation, f"{_ST} SELECT image_id, y, x, {_r('sqrt(greatest(avg(w*w)-avg(w)*avg(w),0))', 'sigma', 5)} FROM s GROUP BY 1, 2, 3", 5)

# Learning, safety, fusion, frame control

add("iml_04_episode_statistics", "v_transitions", learning.episode_statistics, f"e AS (SELECT episode_id, count(*) AS n, sum(reward) AS r FROM v_transitions GROUP BY 1) SELECT count(*) AS episodes, CAST(sum(n) AS BIGINT) AS total, {_r('avg(n)', 'avg_length', 4)}, {_r('min(n)', 'min_length', 4)}, {_r('max(n)', 'max_length', 4)}, {_r('avg(r)', 'avg_reward', 4)}, {_r('min(r)', 'min_reward', 4)}, {_r('max(r)', 'max_reward', 4)} FROM e", 4)
add("iml_05_normalise", "v_transitions", lambda d: learning.normalised(d.select("episode_id", "step", "obs0", "obs1"), ["obs0", "obs1"]), f"SELECT episode_id, step, {_r('(obs0-avg(obs0) OVER ())/(stddev_pop(obs0) OVER ()+1e-8)', 'obs0')}, {_r('(obs1-avg(obs1) OVER ())/(stddev_pop(obs1) OVER ()+1e-8)', 'obs1')} FROM v_transitions")
add("iml_07_train_split", "v_transitions", lambda d: learning.train_part(d).groupBy("train").agg(F.count("*").alias("n"), F.countDistinct("episode_id").alias("episodes")), "r AS (SELECT *, dense_rank() OVER (ORDER BY episode_id) AS k FROM v_transitions) SELECT k <= floor((SELECT max(k) FROM r)*0.8::DOUBLE) AS train, count(*) AS n, count(DISTINCT episode_id) AS episodes FROM r GROUP BY 1")
_GAE = "z AS (SELECT episode_id, step, reward + 0.99::DOUBLE*coalesce(lead(obs1) OVER w, 0) - obs1 AS delta, obs1, max(step) OVER (PARTITION BY episode_id) AS n FROM v_transitions WINDOW w AS (PARTITION BY episode_id ORDER BY step)), a AS (SELECT p.episode_id, p.step, any_value(p.obs1) AS v, sum(power(0.99::DOUBLE*0.95::DOUBLE, q.step-p.step)*q.delta) AS adv FROM z p JOIN z q ON p.episode_id = q.episode_id AND q.step >= p.step GROUP BY 1, 2)"
add(
    "pol_05_statistics",
    "v_transitions",
    lambda d: learning.policy_statistics(d.groupBy((F.col("episode_id") % 10).alias("run_id"), F.col("step").alias("update")).agg(F.avg("reward").alias("policy_loss"), F.avg("obs1").alias("entropy")).withColumn("learning_rate", 0.001 / F.col("update")), "run_id"),
    f"u AS (SELECT episode_id % 10 AS run_id, step, avg(reward) AS p, avg(obs1) AS e FROM v_transitions GROUP BY 1, 2) SELECT run_id, count(*) AS num_updates, {_r('avg(p)', 'avg_policy_loss')}, {_r('avg(e)', 'avg_entropy')}, {_r('0.001::DOUBLE/max(step)', 'learning_rate')} FROM u GROUP BY run_id",
)
add("pol_03_gae", "v_transitions", lambda d: learning.advantages(d, "obs1"), f"{_GAE} SELECT episode_id, step, {_r('adv', 'advantage', 4)}, {_r('adv+v', 'ret', 4)} FROM a", 4)
_STATE = "s AS (SELECT episode_id, step, act0 AS acceleration, act1 AS steering_angle, speed, obs1 AS min_distance_to_obstacle FROM v_transitions), c AS (SELECT episode_id, step, unnest([{name: 'acceleration_limit', value: abs(acceleration), t: 5.0::DOUBLE}, {name: 'steering_limit', value: abs(steering_angle), t: 45.0::DOUBLE}, {name: 'collision_risk', value: 1/(min_distance_to_obstacle+1e-8::DOUBLE), t: 1.0::DOUBLE}, {name: 'speed_limit', value: speed, t: 30.0::DOUBLE}], recursive := true) FROM s)"


def _states(d: DataFrame) -> DataFrame:
    return d.select("episode_id", "step", F.col("act0").alias("acceleration"), F.col("act1").alias("steering_angle"), "speed", F.col("obs1").alias("min_distance_to_obstacle"))


add("saf_02_violations", "v_transitions", lambda d: learning.violations(_states(d), learning.default_constraints()).select("episode_id", "step", "name", "value", "severity", "message"), f"{_STATE} SELECT episode_id, step, name, {_r('value', 'value', 4)}, {_r('least(1, (value-t)/(t+1e-8::DOUBLE))', 'severity', 4)}, printf('Constraint ''%s'' violated: %.4f > %.4f', name, value, t) AS message FROM c WHERE value > t", 4)
add("saf_06_correct_action", "v_transitions", lambda d: learning.corrected(_states(d)).select("episode_id", "step", "acceleration", "steering_angle"), f"SELECT episode_id, step, {_r('greatest(-5, least(5, act0))', 'acceleration')}, {_r('greatest(-45, least(45, act1))', 'steering_angle')} FROM v_transitions")
add("fus_01_gps_to_local", "v_sensor", lambda d: learning.gps_to_local(d.filter("kind = 'gps'"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).select("vehicle_id", "seq", "north", "east", "up"), f"SELECT vehicle_id, seq, {_r('6371000.0::DOUBLE*radians(lat)', 'north', 4)}, {_r('6371000.0::DOUBLE*radians(lon)', 'east', 4)}, {_r('alt', 'up', 4)} FROM v_sensor WHERE kind = 'gps'", 4)
_EWMA = "e AS (SELECT stream_id, seq, CAST(latency_ms AS DOUBLE) AS ewma, CASE WHEN latency_ms > 33.3 THEN least(trunc(latency_ms/33.3::DOUBLE)::INT, 4) ELSE 0 END AS skip, CASE WHEN latency_ms > 33.3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM v_latency WHERE seq = 1 UNION ALL SELECT stream_id, seq, m, CASE WHEN m > 33.3::DOUBLE THEN greatest(skip, least(trunc(m/33.3::DOUBLE)::INT, 4)) WHEN m <= 0.8::DOUBLE*33.3::DOUBLE THEN greatest(skip-1, 0) ELSE skip END, CASE WHEN m > 33.3::DOUBLE THEN greatest(0.5::DOUBLE, scale-0.1::DOUBLE) WHEN m <= 0.8::DOUBLE*33.3::DOUBLE THEN least(1.0::DOUBLE, scale+0.1::DOUBLE) ELSE scale END FROM (SELECT l.stream_id, l.seq, 0.2::DOUBLE*l.latency_ms+0.8::DOUBLE*e.ewma AS m, e.skip, e.scale FROM e JOIN v_latency l ON l.stream_id = e.stream_id AND l.seq = e.seq+1))"
add("adp_02_frame_control", "v_latency", lambda d: learning.frame_control(d).select("stream_id", "seq", "ewma", "skip", "scale"), f"{_EWMA} SELECT stream_id, seq, {_rs('ewma', 4)}, skip, {_rs('scale', 4)} FROM e", 4)
add("adp_01_max_scale", "v_latency", lambda d: learning.frame_control(d, max_scale=0.8).select("stream_id", "seq", "ewma", "skip", "scale"), f"{_EWMA.replace('0.9::DOUBLE ELSE 1.0::DOUBLE', '0.7::DOUBLE ELSE 0.8::DOUBLE').replace('least(1.0::DOUBLE', 'least(0.8::DOUBLE')} SELECT stream_id, seq, {_rs('ewma', 4)}, skip, {_rs('scale', 4)} FROM e", 4)
add(
    "adp_05_reset",
    "v_latency",
    lambda d: learning.frame_control(d.withColumn("reset", F.col("seq") % 50 == 0), reset="reset").select("stream_id", "seq", "ewma", "skip", "scale"),
    f"v2 AS (SELECT stream_id * 1000000 + seq // 50 AS stream_id, seq % 50 AS seq, latency_ms FROM v_latency WHERE seq % 50 > 0), {_EWMA.replace('v_latency', 'v2')} SELECT stream_id // 1000000 AS stream_id, stream_id % 1000000 * 50 + seq AS seq, {_rs('ewma', 4)}, skip, {_rs('scale', 4)} FROM e",
    4,
)
add("opt_02_latency_profile", "v_latency", learning.latency_profile, f"SELECT stream_id, {_r('avg(latency_ms)', 'mean')}, {_r('quantile_cont(latency_ms, 0.5)', 'median')}, {_r('quantile_cont(latency_ms, 0.95)', 'p95')}, {_r('quantile_cont(latency_ms, 0.99)', 'p99')}, {_r('stddev_pop(latency_ms)', 'std')} FROM v_latency GROUP BY stream_id")
