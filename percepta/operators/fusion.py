"""Fusion of interleaved IMU and GPS events, a fold over each vehicle's sequence.

The covariance starts as 0.1 · I, grows by q · I with an IMU event and is scaled on the position's block by a GPS event. So it is two
numbers: that of the position's block and that of the other six.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.operators.folds import Fold, folded

#: Metres; the sphere on which GPS positions are unrolled.
EARTH = 6_371_000.0
POSE = ["px", "py", "pz", "vx", "vy", "vz", "roll", "pitch", "yaw"]


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """The rows of the rotation by roll, pitch and yaw, applied in this order."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a), F.sin(a)) for a in (roll, pitch, yaw))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def _turned(pose: list[float], a: tuple[float, float, float]) -> list[float]:
    """An acceleration of the body in the world's axes: about x, then y, then z."""
    roll, pitch, yaw = pose[6:]
    x, y, z = a
    y, z = y * math.cos(roll) - z * math.sin(roll), y * math.sin(roll) + z * math.cos(roll)
    x, z = x * math.cos(pitch) + z * math.sin(pitch), z * math.cos(pitch) - x * math.sin(pitch)
    x, y = x * math.cos(yaw) - y * math.sin(yaw), x * math.sin(yaw) + y * math.cos(yaw)
    return [x, y, z]


def _fusing(origin: tuple[float, float, float], process_noise: float, gps_noise: float) -> Fold:
    lat0, lon0, alt0 = origin

    def step(state, kind, t, ax, ay, az, gx, gy, gz, lat, lon, alt, speed, heading, accuracy):
        pose, last, spread, rest = state
        if kind == "imu" and last is None:
            last = t
        elif kind == "imu":
            dt, last = t - last, t
            world = _turned(pose, (ax, ay, az))
            for k in range(3):
                pose[3 + k] += world[k] * dt
                pose[k] += pose[3 + k] * dt
            for k, rate in enumerate((gx, gy, gz)):
                pose[6 + k] += rate * dt
            spread, rest = spread + process_noise, rest + process_noise
        elif kind == "gps":
            at = (EARTH * math.radians(lat - lat0), EARTH * math.radians(lon - lon0) * math.cos(math.radians(lat0)), alt - alt0)
            gain = spread / (spread + gps_noise / (accuracy + 1e-6))
            for k in range(3):
                pose[k] += gain * (at[k] - pose[k])
            spread *= 1 - gain
            if speed > 0:
                pose[3:5] = speed * math.sin(math.radians(heading)), speed * math.cos(math.radians(heading))
        state[1:] = last, spread, rest
        return (*pose, spread, rest)

    return Fold([[0.0] * 9, None, 0.1, 0.1], step)


def fused(events: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), process_noise: float = 0.01, gps_noise: float = 1.0, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """vehicle_id, seq, the nine numbers of POSE and both variances after every event of kind imu or gps.

    events(vehicle_id, seq, kind, t, ax, ay, az, gx, gy, gz, lat, lon, alt, speed, heading, accuracy). The first IMU event only sets
    the clock, which GPS events leave alone; gravity is not taken out; a larger accuracy means less noise. Readings that are
    null count as 0 (accuracy: 1), other kinds change nothing. Every row is a snapshot of its own. events may be a
    stream; reset (a boolean column), time and expire_ms are those of folded(). After a reset the pose is zero and the clock unset.
    """
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c == "accuracy" else 0.0)) for c in ("t", "ax", "ay", "az", "gx", "gy", "gz", "lat", "lon", "alt", "speed", "heading", "accuracy")]
    out = ", ".join(f"{c} double" for c in [*POSE, "position_variance", "other_variance"])
    return folded(events, "vehicle_id", "seq", [F.col("kind"), *zero], _fusing(origin, process_noise, gps_noise), out, reset=reset, time=time, expire_ms=expire_ms)


def fusion_statistics(events: DataFrame, states: DataFrame) -> DataFrame:
    """For every vehicle: updates by kind, the last pose and the uncertainty of the position, the root of its block's trace."""
    counts = events.filter(F.col("kind").isin("imu", "gps")).groupBy("vehicle_id").agg(F.count("*").alias("total_updates"), F.count_if(F.col("kind") == "imu").alias("imu_updates"), F.count_if(F.col("kind") == "gps").alias("gps_updates"))
    last = states.groupBy("vehicle_id").agg(F.max_by(F.struct(*POSE, F.sqrt(3 * F.col("position_variance")).alias("position_uncertainty")), "seq").alias("s"))
    return counts.join(last.select("vehicle_id", "s.*"), "vehicle_id")
