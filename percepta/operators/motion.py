"""Forecasts, uncertainty, motion features, behaviour and intent of tracks, on windows by track and frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from percepta.operators.folds import Fold, folded

def frames() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("frame_id")


def norm(*c: Column) -> Column:
    return F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))


def differences(positions: DataFrame) -> DataFrame:
    """Adds vx, vy (this frame less the last) and ax, ay (this velocity less the last); null where there is none."""
    d = positions.withColumns({"vx": F.col("x") - F.lag("x").over(frames()), "vy": F.col("y") - F.lag("y").over(frames())})
    return d.withColumns({"ax": F.col("vx") - F.lag("vx").over(frames()), "ay": F.col("vy") - F.lag("vy").over(frames())})


def latest(positions: DataFrame) -> DataFrame:
    """The last frame of every track."""
    last = positions.groupBy("track_id").agg(F.max_by(F.struct(*[c for c in positions.columns if c != "track_id"]), "frame_id").alias("s"))
    return last.select("track_id", "s.*")


def forecast(positions: DataFrame, model: str = "cv", horizon: int = 5, dt: float = 1.0) -> DataFrame:
    """track_id, step, x, y for steps 1 to horizon after the last frame, at constant velocity (cv) or acceleration (ca).

    One frame: its position is repeated. Two frames: ca is cv. In ca the velocity counts by frame and only the acceleration by dt.
    """
    if model not in ("cv", "ca"):
        raise ValueError(f"unknown model {model!r}")
    last = latest(differences(positions)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    k = F.col("step") * F.lit(dt) if model == "ca" else F.col("step")

    def at(p: str) -> Column:
        v = F.coalesce(f"v{p}", F.lit(0.0))
        if model == "cv":
            return F.col(p) + v * k
        return F.when(F.col(f"a{p}").isNull(), F.col(p) + v * F.col("step")).otherwise(F.col(p) + v * k + F.col(f"a{p}") / (dt * dt) * k * k / 2)

    return last.select("track_id", "step", at("x").alias("x"), at("y").alias("y"))


def displacement_errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """track_id, ade (mean distance over common steps), fde (distance of both last steps)."""
    both = predicted.select("track_id", "step", F.col("x").alias("px"), F.col("y").alias("py")).join(truth.select("track_id", "step", "x", "y"), ["track_id", "step"])
    ade = both.groupBy("track_id").agg(F.avg(norm(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).alias("ade"))
    end = lambda d, p: d.groupBy("track_id").agg(F.max_by("x", "step").alias(f"{p}x"), F.max_by("y", "step").alias(f"{p}y"))
    fde = end(predicted, "p").join(end(truth, "t"), "track_id").select("track_id", norm(F.col("px") - F.col("tx"), F.col("py") - F.col("ty")).alias("fde"))
    return ade.join(fde, "track_id")


def position_uncertainty(positions: DataFrame, dt: float = 1.0) -> DataFrame:
    """sigma_v (half the last speed) and sigma_a (a fifth of the last acceleration; 0 below three frames) of every track."""
    last = latest(differences(positions))
    return last.select("track_id", F.coalesce(norm(F.col("vx"), F.col("vy")) * 0.5, F.lit(0.0)).alias("sigma_v"), F.coalesce(norm(F.col("ax") / dt**2, F.col("ay") / dt**2) * 0.2, F.lit(0.0)).alias("sigma_a"))


def forecast_uncertainty(positions: DataFrame, horizon: int = 5, dt: float = 1.0) -> DataFrame:
    last = latest(differences(positions)).join(position_uncertainty(positions, dt), "track_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    v, a = F.coalesce(norm(F.col("vx"), F.col("vy")), F.lit(0.0)), F.coalesce(norm(F.col("ax"), F.col("ay")), F.lit(0.0)) / dt**2
    return last.select("track_id", "step", F.sqrt((F.col("sigma_v") * v * F.col("step")) ** 2 + (F.col("sigma_a") * a * F.col("step")) ** 2).alias("sigma"))


def confidence_ellipse(df: DataFrame, a: Column, b: Column, c: Column, n_std: float = 2.0) -> DataFrame:
    """major, minor and angle (modulo π) of the covariance [[a, b], [b, c]]."""
    root = F.sqrt((a - c) * (a - c) / 4 + b * b)
    mid = (a + c) / 2
    return df.withColumns({"major": n_std * F.sqrt(mid + root), "minor": n_std * F.sqrt(F.greatest(mid - root, F.lit(0.0))), "angle": F.atan2(2 * b, a - c) / 2})


def step_uncertainty(positions: DataFrame, dt: float = 1.0) -> DataFrame:
    """Half the speed of every step; a track of one frame has a row with 0."""
    d = differences(positions).withColumn("n", F.count("*").over(Window.partitionBy("track_id")))
    return d.filter("vx is not null or n = 1").select("track_id", "frame_id", F.coalesce(norm(F.col("vx") / dt, F.col("vy") / dt) * 0.5, F.lit(0.0)).alias("sigma"))


def velocity_uncertainty(positions: DataFrame) -> DataFrame:
    """Population deviation of the lengths of velocity changes; 0 below two velocities."""
    d = differences(positions)
    return d.groupBy("track_id").agg(F.coalesce(F.stddev_pop(norm(F.col("ax"), F.col("ay"))), F.lit(0.0)).alias("sigma"))


def motion_features(positions: DataFrame) -> DataFrame:
    """The six features of every track's whole history."""
    d = differences(positions)
    speed, heading = norm(F.col("vx"), F.col("vy")), F.atan2("vy", "vx")
    d = d.withColumns({"speed": speed, "heading": heading, "pvx": F.lag("vx").over(frames()), "pvy": F.lag("vy").over(frames())})
    cos = (F.col("vx") * F.col("pvx") + F.col("vy") * F.col("pvy")) / (F.col("speed") * norm(F.col("pvx"), F.col("pvy")))
    turn = F.when((F.col("speed") > 0) & (norm(F.col("pvx"), F.col("pvy")) > 0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    d = d.withColumn("turn", turn)
    g = d.groupBy("track_id").agg(
        F.max_by("speed", "frame_id").alias("speed"),
        F.when(F.coalesce(F.min("speed"), F.lit(0.0)) > 1e-6, F.avg("turn")).alias("angular_velocity"),
        F.max_by(norm(F.col("ax"), F.col("ay")), "frame_id").alias("acceleration"),
        F.var_pop("speed").alias("speed_variance"),
        F.var_pop("heading").alias("direction_variance"),
        F.abs(F.max_by("heading", "frame_id") - F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("frame_id")))).alias("heading_change"),
    )
    return g.select("track_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in g.columns[1:]])


def motion_pattern(f: DataFrame) -> DataFrame:
    """Adds pattern and confidence by ordered rules."""
    rules = F.when(F.col("speed") < 1.0, F.struct(F.lit("stopped").alias("p"), F.lit(0.95).alias("c")))
    rules = rules.when(F.col("angular_velocity") > 0.1, F.struct(F.lit("turning").alias("p"), F.least(F.lit(0.9), F.col("angular_velocity") / 0.2).alias("c")))
    rules = rules.when(F.col("acceleration") > 0.5, F.struct(F.lit("accelerating").alias("p"), F.least(F.lit(0.9), F.col("acceleration") / 1.0).alias("c")))
    rules = rules.when(F.col("acceleration") < -0.5, F.struct(F.lit("decelerating").alias("p"), F.least(F.lit(0.9), -F.col("acceleration") / 1.0).alias("c")))
    rules = rules.otherwise(F.struct(F.lit("moving_straight").alias("p"), F.lit(0.8).alias("c")))
    return f.withColumns({"pattern": rules["p"], "confidence": rules["c"]})


#: The behaviours that the rules give.
STATIONARY, LINEAR, CURVED, LANE_CHANGE, ACCELERATION, BRAKING, UNKNOWN = "stationary", "linear_motion", "curved_motion", "lane_change", "acceleration_event", "braking_event", "unknown"


def behaviour_pattern(f: DataFrame, history: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds behaviour, by ordered rules on the pattern and a history of features.

    history names an array column of structs with heading_change, acceleration and direction_variance, oldest first; without
    one the history is the row's own features. The means are those of the last three; the direction variance is the last one.
    """
    p = F.col("pattern")
    if history is None:
        return f.withColumn("behaviour", F.when(p == "stopped", STATIONARY).when(F.col("direction_variance") > 0.5, CURVED).when(p == "turning", CURVED).otherwise(LINEAR))
    h = F.coalesce(F.col(history), F.array().cast(f.schema[history].dataType))
    last = F.slice(h, F.greatest(F.size(h) - 2, F.lit(1)), 3)
    mean = lambda c: F.aggregate(last, F.lit(0.0), lambda acc, x: acc + x[c]) / F.size(last)
    rules = F.when(p == "stopped", STATIONARY).when(F.size(h) == 0, UNKNOWN).when((F.size(h) > 3) & (mean("heading_change") > 0.3), LANE_CHANGE)
    rules = rules.when(mean("acceleration") > threshold, ACCELERATION).when(mean("acceleration") < -threshold, BRAKING)
    return f.withColumn("behaviour", rules.when(F.try_element_at(h, F.lit(-1))["direction_variance"] > 0.5, CURVED).when(p == "turning", CURVED).otherwise(LINEAR))


def pattern_states(patterns: DataFrame, least: int = 5) -> DataFrame:
    """The analyser's state after every frame of patterns(track_id, frame_id, pattern, confidence).

    frame_count; pattern_start (the frame at which the current pattern began); confidence (as it was then, not refreshed since);
    duration (frame_count − pattern_start, which mixes counts and frame ids and may be below 0); ended: at a change in frame_count
    `least` or later, the (start, pattern, confidence) that it ends, else null. Change points are windows over a track's frames.
    """
    w = frames()
    s = patterns.withColumns({"frame_count": F.row_number().over(w), "changed": ~F.col("pattern").eqNullSafe(F.lag("pattern").over(w))})
    begun = F.when(F.col("changed") | (F.col("frame_count") == 1), F.struct(F.col("frame_id").alias("start"), "pattern", "confidence"))
    s = s.withColumn("own", F.last(begun, ignorenulls=True).over(w))
    ended = F.when(F.col("changed") & (F.col("frame_count") > 1) & (F.col("frame_count") >= least), F.lag("own").over(w))
    s = s.withColumn("ended", ended)
    return s.select("track_id", "frame_id", "pattern", "frame_count", F.col("own.start").alias("pattern_start"), F.col("own.confidence").alias("confidence"), (F.col("frame_count") - F.col("own.start")).alias("duration"), "ended")


def _patterns(least: int) -> Fold:
    def step(state, frame, pattern, confidence):
        count, start, current, sure = state
        count += 1
        ended = (start, current, sure) if count > 1 and pattern != current and count >= least else None
        if count == 1 or pattern != current:
            start, current, sure = frame, pattern, confidence
        state[:] = count, start, current, sure
        return current, count, start, sure, count - start, None if ended is None else dict(zip(("start", "pattern", "confidence"), ended, strict=True))

    return Fold([0, None, None, None], step)


def pattern_stream(patterns: DataFrame, least: int = 5, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """pattern_states() whose states live with their tracks: patterns may be a stream, and a row in which `reset` is true removes its track's state.

    A removed track begins again with frame_count 1. reset, time and expire_ms are those of folded(); over a table only reset counts.
    """
    values = [F.col("frame_id").cast("long"), F.col("pattern"), F.col("confidence").cast("double")]
    out = "pattern string, frame_count long, pattern_start long, confidence double, duration long, ended struct<start: long, pattern: string, confidence: double>"
    return folded(patterns, "track_id", "frame_id", values, _patterns(least), out, reset=reset, time=time, expire_ms=expire_ms)


def collision_course(pairs: DataFrame, speed_a: str = "speed_a", speed_b: str = "speed_b") -> DataFrame:
    """Adds on_course to pairs of tracks: true unless both are slower than 0.1. near_pairs() of encounters.py forms them."""
    return pairs.withColumn("on_course", ~((F.col(speed_a) < 0.1) & (F.col(speed_b) < 0.1)))


def intent(positions: DataFrame, lookahead: int = 30) -> DataFrame:
    """intent, confidence and predicted position of every track's last frame."""
    d = differences(positions)
    d = d.withColumn("heading_change", F.atan2("vy", "vx") - F.lag(F.atan2("vy", "vx")).over(frames()))
    d = latest(d)
    speed = norm(F.col("vx"), F.col("vy"))
    along = (F.coalesce("ax", F.lit(0.0)) * F.col("vx") + F.coalesce("ay", F.lit(0.0)) * F.col("vy")) / (speed + 1e-6)
    turn = F.coalesce("heading_change", F.lit(0.0))
    pick = lambda n, c: F.struct(F.lit(n).alias("n"), (F.lit(c) if isinstance(c, float) else c).alias("c"))
    rules = F.when(F.col("vx").isNull(), pick("unknown", 0.0)).when(speed < 0.5, pick("stop", 0.95)).when(along > 0.5, pick("accelerate", F.least(F.lit(0.9), along))).when(along < -0.5, pick("decelerate", F.least(F.lit(0.9), F.abs(along))))
    rules = rules.when(turn > 0.2, pick("turn_left", 0.8)).when(turn < -0.2, pick("turn_right", 0.8)).otherwise(pick("continue", 0.85))
    still = rules["n"].isin("unknown", "stop")
    to = lambda p: F.when(still, F.col(p)).otherwise(F.col(p) + F.col(f"v{p}") * lookahead / 30)
    return d.select("track_id", rules["n"].alias("intent"), rules["c"].alias("confidence"), to("x").alias("px"), to("y").alias("py"))


def time_to_collision(pairs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Of pairs with dx, dy, dvx, dvy: ttc, collision, confidence, reason; the direction of approach doesn't count."""
    rel = norm(F.col("dvx"), F.col("dvy"))
    ttc = norm(F.col("dx"), F.col("dy")) / (rel + 1e-6)
    still = rel < 0.1
    conf = F.when(ttc <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ttc / threshold)))
    return pairs.withColumns({"ttc": F.when(~still, ttc), "collision": ~still & (ttc < threshold), "confidence": F.when(still, 1.0).otherwise(conf), "reason": F.when(still, "No relative motion").otherwise(F.format_string("TTC: %.2fs, distance: %.2fm", ttc, norm(F.col("dx"), F.col("dy"))))})


def intents(positions: DataFrame) -> DataFrame:
    """track_id, rank, intent, confidence: all intents of a track's last frame, the most confident first; equal ones in the order of the rules."""
    d = differences(positions).withColumn("turn", F.atan2("vy", "vx") - F.lag(F.atan2("vy", "vx")).over(frames()))
    d = latest(d)
    speed, force, turn = norm(F.col("vx"), F.col("vy")), F.coalesce(norm(F.col("ax"), F.col("ay")), F.lit(0.0)), F.coalesce("turn", F.lit(0.0))
    one = lambda rule, name, c: F.struct((-c).alias("less"), F.lit(rule).alias("rule"), F.lit(name).alias("intent"))
    first = F.when(speed < 0.5, one(0, "stop", F.lit(0.9))).otherwise(one(0, "continue", F.lit(0.7)))
    rest = [F.when(force > 0.5, one(1, "accelerate", F.least(F.lit(0.9), force))), F.when(turn > 0.2, one(2, "turn_left", F.lit(0.8))).when(turn < -0.2, one(2, "turn_right", F.lit(0.8)))]
    every = F.when(F.col("vx").isNull(), F.array(one(0, "unknown", F.lit(0.0)))).otherwise(F.array_sort(F.array_compact(F.array(first, *rest))))
    out = d.select("track_id", F.posexplode(every).alias("rank", "i"))
    return out.select("track_id", "rank", F.col("i.intent").alias("intent"), (-F.col("i.less")).alias("confidence"))


def reasoning(intent: Column, speed: Column, along: Column, turn: Column) -> Column:
    """The intent, and after a colon what speaks for it."""
    pace = F.when(speed < 0.5, "low velocity").when(speed > 2.0, "high velocity")
    force = F.when(along > 0.5, "positive acceleration").when(along < -0.5, "negative acceleration (braking)")
    side = F.when(F.abs(turn) > 0.2, F.concat(F.lit("heading change to "), F.when(turn > 0, "left").otherwise("right")))
    parts = F.concat_ws(", ", pace, force, side)
    return F.when(parts == "", intent).otherwise(F.concat(intent, F.lit(": "), parts))


def evasion(pairs: DataFrame, safety: float = 1.0) -> DataFrame:
    """Adds ex, ey to pairs with dx, dy (obstacle less ego) and vx, vy (ego): the velocity across the line of sight, on the side to
    which the ego moves, at its speed; null beyond three safety distances."""
    dist = norm(F.col("dx"), F.col("dy"))
    px, py = -F.col("dy") / (dist + 1e-6), F.col("dx") / (dist + 1e-6)
    side = F.signum(px * F.col("vx") + py * F.col("vy")) * norm(F.col("vx"), F.col("vy"))
    near = dist <= 3 * safety
    return pairs.withColumns({"ex": F.when(near, px * side), "ey": F.when(near, py * side)})
