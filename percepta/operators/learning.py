"""Episodes, advantages, safety constraints, sensor fusion and frame control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators.folds import Fold, folded
from percepta.operators.scans import Scan, may_be_long, scanned, then_affine, then_clamped
from percepta.shared import freed, written


def episode_statistics(transitions: DataFrame) -> DataFrame:
    """One row over completed episodes; zeros if there are none."""
    each = transitions.groupBy("episode_id").agg(F.count("*").alias("n"), F.sum("reward").alias("r"), F.bool_or("done").alias("done")).filter("done")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[zero(f(c).cast("double")).alias(f"{n}_{m}") for c, m in (("n", "length"), ("r", "reward")) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def normalised(transitions: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over all rows, divided by population deviation + 1e-8. The statistics are one row."""
    stats = transitions.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = transitions.join(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8) for c in columns}).drop(*stats.columns)


def train_part(transitions: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds train: whether the row's episode is among the first floor(n · ratio) episodes by id.

    Episodes are dealt by range and counted; only the range that holds the cut is looked at, so no task sorts them all.
    """
    ids = transitions.select("episode_id").filter("episode_id is not null").distinct()
    n = ids.count()
    most = int(n * ratio + 1e-9)
    ranked = ids.repartitionByRange("episode_id").sortWithinPartitions("episode_id").select("episode_id", F.spark_partition_id().alias("part"))
    ranked = written(ranked, "episodes")
    counts = {r.part: r.n for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, cut = 0, None
    for part in sorted(counts):
        if before < most <= before + counts[part]:
            # The cut's rank within its range; the others are only counted.
            cut = ranked.filter(F.col("part") == part).orderBy("episode_id").offset(most - before - 1).limit(1).first()[0]
        before += counts[part]
    freed(ranked)
    return transitions.withColumn("train", F.lit(False) if cut is None else F.coalesce(F.col("episode_id") <= F.lit(cut), F.lit(False)))


def _backward(gamma: float, lam: float) -> Scan:
    """(advantage, value) of the step after become p · advantage + q · value + c and w."""

    def elements(values):
        r, v = (np.nan_to_num(x) for x in values)
        return np.full(len(r), gamma * lam), np.full(len(r), gamma), r - v, v

    def combine(e, f):
        return f[0] * e[0], f[0] * e[1], f[0] * e[2] + f[1] * e[3] + f[2], f[3]

    return Scan([()] * 4, elements, combine, lambda e: [e[2], e[2] + e[3]])


def advantages(transitions: DataFrame, value: str, gamma: float = 0.99, lam: float = 0.95, block: int | None = 500_000) -> DataFrame:
    """Generalised advantages and returns of every step, from an episode's end, whose next value is 0. Null rewards and values count as 0.

    The recurrence is linear: episodes of more than `block` steps are dealt over tasks, as scanned() says.
    """
    return scanned(transitions, "episode_id", "step", [F.col("reward"), F.col(value)], _backward(gamma, lam), "advantage double, ret double", down=True, block=block)


def policy_statistics(updates: DataFrame, key: str) -> DataFrame:
    """For every run of updates(key, update, policy_loss, entropy, learning_rate): num_updates, average loss and entropy, and the last learning rate.

    A run without updates has no row; null losses don't count in their average.
    """
    return updates.groupBy(key).agg(F.count("*").alias("num_updates"), F.avg("policy_loss").alias("avg_policy_loss"), F.avg("entropy").alias("avg_entropy"), F.max_by("learning_rate", "update").alias("learning_rate"))


#: Names and state fields of the default constraints.
ACCELERATION, STEERING, COLLISION, SPEED = "acceleration_limit", "steering_limit", "collision_risk", "speed_limit"
STATE_FIELDS = ["acceleration", "steering_angle", "min_distance_to_obstacle", "speed"]


def default_constraints(min_distance: float = 1.0, max_acceleration: float = 5.0, max_steering: float = 45.0, max_speed: float = 30.0) -> list[tuple[str, Column, float]]:
    """name, value of a state, limit. A missing field takes a default that passes."""
    c = lambda n, d: F.coalesce(F.col(n), F.lit(d))
    acceleration, steering, distance, speed = STATE_FIELDS
    return [
        (ACCELERATION, F.abs(c(acceleration, 0.0)), max_acceleration),
        (STEERING, F.abs(c(steering, 0.0)), max_steering),
        (COLLISION, 1 / (c(distance, min_distance) + 1e-8), 1 / min_distance),
        (SPEED, c(speed, 0.0), max_speed),
    ]


def _checked(states: DataFrame, constraints: list[tuple[str, Column, float]]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for n, v, t in constraints])
    return states.withColumn("c", F.explode(each)).select(*states.columns, "c.*")


def violations(states: DataFrame, constraints: list[tuple[str, Column, float]]) -> DataFrame:
    """A row for each state and constraint whose value exceeds its limit: name, value, severity, message."""
    severity = F.least(F.lit(1.0), (F.col("value") - F.col("threshold")) / (F.col("threshold") + 1e-8))
    message = F.format_string("Constraint '%s' violated: %.4f > %.4f", "name", "value", "threshold")
    return _checked(states, constraints).filter("value > threshold").withColumns({"severity": severity, "message": message})


def constraint_statistics(states: DataFrame, constraints: list[tuple[str, Column, float]], order: list[str], block: int | None = None, decay: float = 0.9) -> DataFrame:
    """avg_value (moving, 0.9 and 0.1, from 0), max_value (from 0), min_value and violations of every constraint after all states, in `order`.

    States are numbered once by ranges of the order, for all constraints. A value counts in the moving average by the power of its distance from the
    last state, so all figures are sums and extremes that partitions add up. Null values count as 0. block: rows of a range, for which they are
    counted; None: Spark's own number of ranges.
    """
    most = float(np.finfo(float).max)
    of = lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.nanvl(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    rows = states.select(F.struct(*order).alias("at"), *[of(v).alias(f"v{i}") for i, (_, v, _) in enumerate(constraints)])
    ranges = [max(1, -(-rows.count() // block))] if block else []
    seq = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    ranged = written(rows.repartitionByRange(*ranges, "at").sortWithinPartitions("at").withColumn("seq", seq).drop("at"), "checked")
    part = F.shiftright("seq", 33)
    # One row a range, of which there are as many as shuffle partitions.
    ends = ranged.groupBy(part.alias("range_")).agg(F.count("*").alias("rows_"))
    ends = ends.select("range_", (F.sum("rows_").over(Window.orderBy(F.col("range_").desc())) - 1).alias("end_"))
    ranged = ranged.withColumn("range_", part).join(F.broadcast(ends), "range_")
    weight = (1 - decay) * F.pow(F.lit(decay), F.col("end_") - F.col("seq").bitwiseAND((1 << 33) - 1))
    every = []
    for i, (name, _, threshold) in enumerate(constraints):
        v = F.col(f"v{i}")
        figures = F.sum(v * F.col("weight")), F.greatest(F.lit(0.0), F.max(v)), F.min(v), F.count_if(v > float(threshold))
        every.append(F.struct(F.lit(name).alias("name"), *[f.alias(n) for f, n in zip(figures, ("avg_value", "max_value", "min_value", "violations"), strict=True)]))
    found = ranged.withColumn("weight", weight).agg(F.count("*").alias("n"), F.array(*every).alias("every"))
    return found.filter("n > 0").select(F.explode("every").alias("c")).select("c.*")


def with_action(states: DataFrame, acceleration: str, steering: str) -> DataFrame:
    """States whose acceleration and steering are the action's where it has them."""
    return states.withColumns({"acceleration": F.coalesce(acceleration, "acceleration"), "steering_angle": F.coalesce(steering, "steering_angle")})


def trajectory_safety(states: DataFrame, key: str, constraints: list[tuple[str, Column, float]]) -> DataFrame:
    """For every trajectory: safe (no state violates a constraint) and n_violations."""
    over = sum((F.coalesce(v.cast("double") > t, F.lit(False)).cast("long") for _, v, t in constraints), F.lit(0).cast("long"))
    return states.groupBy(key).agg((F.sum(over) == 0).alias("safe"), F.sum(over).alias("n_violations"))


def safety_metrics(states: DataFrame, constraints: list[tuple[str, Column, float]]) -> DataFrame:
    """One row: total_violations over all states and constraints, and states that violate any."""
    over = sum((F.coalesce(v.cast("double") > t, F.lit(False)).cast("long") for _, v, t in constraints), F.lit(0).cast("long"))
    return states.agg(F.coalesce(F.sum(over), F.lit(0)).alias("total_violations"), F.count_if(over > 0).alias("unsafe_states"))


def corrected(states: DataFrame, max_acceleration: float = 5.0, max_steering: float = 45.0) -> DataFrame:
    """Actions clipped in the dimensions that violate their limit; a null stays null."""
    clip = lambda n, m: F.when(F.abs(F.col(n)) > m, F.signum(n) * m).otherwise(F.col(n))
    return states.withColumns({"acceleration": clip("acceleration", max_acceleration), "steering_angle": clip("steering_angle", max_steering)})


def gps_to_local(df: DataFrame, lat0: Column, lon0: Column, alt0: Column) -> DataFrame:
    """north, east and up in metres from a reference, on a sphere of 6,371,000 m."""
    r = 6_371_000.0
    return df.withColumns({"north": r * F.radians(F.col("lat") - lat0), "east": r * F.radians(F.col("lon") - lon0) * F.cos(F.radians(lat0)), "up": F.col("alt") - alt0})


def _controlled(target: float, recovery: float, alpha: float, step: float, least_scale: float, most: int, gated: bool, max_scale: float) -> Fold:
    def observe(state, latency):
        ewma, skip, scale, seen, dropped = state
        seen += 1
        processed = not gated or skip == 0
        if not processed:
            skip, dropped = skip - 1, dropped + 1
        elif latency is not None:
            if latency < 0:
                raise ValueError(f"a latency of {latency} is below 0")
            ewma = latency if ewma is None else alpha * latency + (1 - alpha) * ewma
            if ewma > target:
                skip, scale = max(skip, min(int(ewma / target), most)), max(least_scale, scale - step)
            elif ewma <= recovery:
                skip, scale = max(skip - 1, 0), min(max_scale, scale + step)
        state[:] = ewma, skip, scale, seen, dropped
        return ewma, skip, scale, processed, 1 - dropped / seen

    return Fold([None, 0, max_scale, 0, 0], observe)


def _smoothed(alpha: float) -> Scan:
    """(has, first, a, b): a first latency is taken as it is, later ones by a · x + b; has tells whether there was one. Rows are numbered too, so that ties keep their order."""

    def elements(values):
        v = values[0]
        if (v < 0).any():
            raise ValueError(f"a latency of {np.nanmin(v)} is below 0")
        there = ~np.isnan(v)
        v = np.nan_to_num(v)
        return there.astype(float), v, np.where(there, 1 - alpha, 1.0), alpha * v, there.astype(float), np.ones(len(v))

    def combine(e, f):
        return np.maximum(e[0], f[0]), np.where(e[0] > 0, f[2] * e[1] + f[3], f[1]), *then_affine(e[2:4], f[2:4]), f[4], e[5] + f[5]

    return Scan([()] * 6, elements, combine, lambda e: [e[5], np.where(e[0] > 0, e[1], np.nan), e[4]])


def _adjusted(target: float, recovery: float, step: float, least_scale: float, max_scale: float, most: int) -> Scan:
    """Skip and scale as clamped steps from the moving average after each observed frame."""

    def elements(values):
        _, ewma, seen = values
        over, under = (seen > 0) & (ewma > target), (seen > 0) & (ewma <= recovery)
        inf = np.full(len(ewma), np.inf)
        to = np.where(over, np.minimum(np.trunc(np.nan_to_num(ewma) / target), most), 0.0)
        skip = np.where(under, -1.0, 0.0), np.where(over, to, np.where(under, 0.0, -inf)), inf
        scale = np.where(over, -step, np.where(under, step, 0.0)), np.where(over, least_scale, -inf), np.where(under, max_scale, inf)
        return *skip, *scale, ewma

    def combine(e, f):
        return *then_clamped(e[:3], f[:3]), *then_clamped(e[3:6], f[3:6]), f[6]

    at = lambda x, e: np.minimum(np.maximum(x + e[0], e[1]), e[2])
    return Scan([()] * 7, elements, combine, lambda e: [e[6], at(0.0, e[:3]), at(max_scale, e[3:6])])


def frame_control(latencies: DataFrame, target: float = 33.3, alpha: float = 0.2, step: float = 0.1, least_scale: float = 0.5, max_skip: int = 4, cap: float = 0.8, recovery: float | None = None, gated: bool = False, max_scale: float = 1.0, block: int | None = 500_000, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """ewma, skip and scale after every frame of a stream: above the target, skip more and scale down; at 0.8 of it or below, relax, to max_scale at most.

    gated: frames are skipped while skip is above 0, each using up one, and only processed frames are observed; processed says which,
    and kept is the share of frames processed so far. Without it every frame is observed. A null latency changes nothing; one below 0
    fails the job. Settings out of range raise ValueError. latencies may be a stream; reset (a boolean column), time and expire_ms are those of folded().

    Over a table without gates or resets the average is a linear recurrence and skip and scale are clamped steps, so streams of more than
    `block` frames are dealt over tasks, as scanned() says. With gates the frames observed depend on skip, and a stream is one ordered run.
    """
    recovery = 0.8 * target if recovery is None else recovery
    if target <= 0 or not 0 < alpha <= 1 or not 0 < least_scale <= max_scale <= 1 or step <= 0 or max_skip < 0 or not 0 <= cap < 1 or not 0 < recovery <= target:
        raise ValueError("a setting of the frame control is out of range")
    most = min(max_skip, int(cap / (1 - cap) + 1))
    latency, out = F.col("latency_ms").cast("double"), "ewma double, skip int, scale double, processed boolean, kept double"
    if gated or latencies.isStreaming or reset:
        control = _controlled(target, recovery, alpha, step, least_scale, most, gated, max_scale)
        return folded(latencies, "stream_id", "seq", [latency], control, out, reset=reset, time=time, expire_ms=expire_ms)
    averages = scanned(latencies, "stream_id", "seq", [latency], _smoothed(alpha), "n double, ewma double, seen double", block=block)
    if block and may_be_long(averages, block):
        averages = written(averages, "averages")  # read by the count of rows and by the second scan
    control = _adjusted(target, recovery, step, least_scale, max_scale, most)
    steps = scanned(averages, "stream_id", "seq", [F.col("n"), F.col("ewma"), F.col("seen")], control, "ewma double, skip double, scale double", block=block)
    return steps.select("stream_id", "seq", "ewma", F.col("skip").cast("int").alias("skip"), "scale", F.lit(True).alias("processed"), F.lit(1.0).alias("kept"))


def target_size(width: Column, height: Column, scale: Column) -> tuple[Column, Column]:
    """Scaled frame size, rounded half to even, 1 at least."""
    return tuple(F.greatest(F.lit(1), F.bround(d * scale).cast("int")) for d in (width, height))


def strided(raster: DataFrame, scale: float) -> DataFrame:
    """Every n-th pixel of every n-th row for n = round(1 / scale); the raster itself from a scale of 1."""
    n = max(1, round(1 / scale)) if scale < 1 else 1
    kept = raster.filter((F.col("y") % n == 0) & (F.col("x") % n == 0))
    return kept.withColumns({c: F.floor(F.col(c) / n) for c in "yx"})


def speedup(original: Column, optimised: Column) -> tuple[Column, Column]:
    """original / optimised, and the reduction in percent; null where a time is 0."""
    return F.try_divide(original, optimised), (1 - F.try_divide(optimised, original)) * 100


def latency_profile(latencies: DataFrame) -> DataFrame:
    pct = [F.percentile("latency_ms", F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))]
    return latencies.groupBy("stream_id").agg(F.avg("latency_ms").alias("mean"), *pct, F.stddev_pop("latency_ms").alias("std"))
