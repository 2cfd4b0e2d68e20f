"""Constant-velocity Kalman filter over each track's frames, one axis at a time.

The four-state filter is block-diagonal in (x, vx) and (y, vy): it is two filters with a position, a velocity and the covariances
pp, pv and vv.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.operators.folds import Fold, folded
from percepta.operators.scans import Scan, scanned

Axis = tuple[float, float, float, float, float]
STATE = ", ".join(f"{n} double" for a in "xy" for n in (a, f"v{a}", f"{a}_pp", f"{a}_pv", f"{a}_vv"))


def predicted(s: Axis, dt: float) -> Axis:
    """One axis ahead by dt; process noise dt⁴/4 on the position and dt² on the velocity, none between them."""
    p, v, pp, pv, vv = s
    return p + v * dt, v, pp + 2 * dt * pv + dt * dt * vv + dt**4 / 4, pv + dt * vv, vv + dt * dt


def updated(s: Axis, z: float) -> Axis:
    """One axis corrected by a measurement with unit noise."""
    p, v, pp, pv, vv = s
    near, along = pp / (pp + 1), pv / (pp + 1)
    return p + near * (z - p), v + along * (z - p), pp * (1 - near), pv * (1 - near), vv - pv * pv / (pp + 1)


def born(z: float) -> Axis:
    """State after birth at z: unit covariance, corrected once by the same measurement."""
    return z, 0.0, 0.5, 0.0, 1.0


def _axes(dt: float) -> Fold:
    def step(held: list[Axis | None], *z):
        for k, m in enumerate(z):
            if held[k] is None:
                held[k] = None if m is None else born(m)
            else:
                ahead = predicted(held[k], dt)
                held[k] = ahead if m is None else updated(ahead, m)
        return tuple(v for s in held for v in (s or (None,) * 5))

    return Fold([None, None], step)


def _filtering(dt: float) -> Scan:
    """The filter as an associative operation, for both axes at a time.

    A row is the map from the state before it to that after it: with state and measurement Gaussian, a run of rows is
    (A, b, C, e, J): from x to A x + b with spread C, given that its measurements speak for x by e and J. Beside it stands what the run makes of an axis
    that has had no measurement before: nothing yet (born 0), or the state m, P.
    """
    step = np.array([[1.0, dt], [0.0, 1.0]])
    noise = np.diag([dt**4 / 4, dt * dt])
    unit = np.eye(2)
    turned = lambda x: np.swapaxes(x, -1, -2)
    by = lambda a, x: np.einsum("...ij,...j->...i", a, x)

    def elements(values):
        z = np.stack(values, axis=1)  # rows, axes
        there = ~np.isnan(z)
        z, seen = np.nan_to_num(z), there[..., None]
        near = noise[:, 0] / (noise[0, 0] + 1)  # gain of a measurement after a step from a known state
        keep = unit - np.outer(near, [1.0, 0.0])
        look = step[0] / (noise[0, 0] + 1)
        a = np.where(seen[..., None], keep @ step, step)
        c = np.where(seen[..., None], keep @ noise, noise)
        e = np.where(seen, z[..., None] * look, 0.0)
        j = np.where(seen[..., None], np.outer(step[0], look), 0.0)
        first = np.stack([z, np.zeros_like(z)], axis=-1)
        return a, np.where(seen, z[..., None] * near, 0.0), c, e, j, there.astype(float), first, np.broadcast_to(np.diag([0.5, 1.0]), a.shape).copy()

    def past(f, m, p):
        """The state (m, p) after the run f."""
        a, b, c, e, j = f
        mix = a @ np.linalg.inv(unit + p @ j)
        return by(mix, m + by(p, e)) + b, mix @ p @ turned(a) + c, mix

    def combine(e, f):
        b, c, mix = past(f[:5], e[1], e[2])
        back = turned(e[0]) @ turned(np.linalg.inv(unit + e[2] @ f[4]))
        joined = mix @ e[0], b, c, by(back, f[3] - by(f[4], e[1])) + e[3], back @ f[4] @ e[0] + e[4]
        m, p, _ = past(f[:5], e[6], e[7])
        born = e[5] > 0
        return *joined, np.maximum(e[5], f[5]), np.where(born[..., None], m, f[6]), np.where(born[..., None, None], p, f[7])

    def output(e):
        born, m, p = e[5:]
        return [np.where(born[:, k] > 0, v, np.nan) for k in (0, 1) for v in (m[:, k, 0], m[:, k, 1], p[:, k, 0, 0], p[:, k, 0, 1], p[:, k, 1, 1])]

    def after(states, z):
        """The columns of both axes after one more row, many tracks at once."""
        s = states.reshape(2, 5, -1)
        ahead = np.stack(predicted(tuple(s.transpose(1, 0, 2)), dt))
        there, alive = ~np.isnan(z), ~np.isnan(s[:, 0])
        first = np.zeros_like(ahead) + np.array(born(0.0))[:, None, None]
        first[0] = z
        known = np.where(there, np.stack(updated(tuple(ahead), z)), ahead)
        return np.where(alive, known, np.where(there, first, np.nan)).transpose(1, 0, 2).reshape(states.shape)

    return Scan([(2, 2, 2), (2, 2), (2, 2, 2), (2, 2), (2, 2, 2), (2,), (2, 2), (2, 2, 2)], elements, combine, output, after, _begun)


def filter_tracks(positions: DataFrame, key: str = "track_id", frame: str = "frame_id", dt: float = 1.0, block: int | None = 500_000, reset: str | None = None, time: str | None = None, expire_ms: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """State of both axes after every frame: x, y and for each axis position, velocity and covariance.

    An axis whose measurement is null is only predicted in that frame, so the track goes on; before its first measurement it has no
    state. Rows without a key or frame are left out. Tracks of more than `block` frames are dealt over tasks, as scanned() says.
    positions may be a stream; reset (a boolean column), time and expire_ms are those of folded(). keep: columns of a table that come along, after the others.
    """
    values = [F.col(c).cast("double") for c in "xy"]
    if positions.isStreaming or reset:
        if keep:
            raise ValueError("columns come along only in a table without resets")
        return folded(positions, key, frame, values, _axes(dt), STATE, reset=reset, time=time, expire_ms=expire_ms)
    return scanned(positions, key, frame, values, _filtering(dt), STATE, block=block, keep=keep)


def filter_tracks_from(positions: DataFrame, states: DataFrame, key: str = "track_id", frame: str = "frame_id", dt: float = 1.0) -> DataFrame:
    """filter_tracks() for tracks that go on from given states(key and the columns of STATE): what set_state and then the frames would give.

    A track without a row in states begins with its first measurement; one without frames has no row. Null numbers in a state leave
    that axis unborn.
    """
    given = states.select(F.col(key), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array(*[F.col(n.split()[0]).cast("double") for n in STATE.split(", ")]).alias("state"))
    rows = positions.select(F.col(key), F.col(frame).cast("long").alias("at"), *[F.col(c).cast("double").alias(c) for c in "xy"], F.lit(None).cast("array<double>").alias("state"))
    return scanned(rows.unionByName(given), key, F.col("at"), [F.col("x"), F.col("y")], _filtering(dt), STATE, block=None, begin=("state", _begun)).withColumnRenamed("order", frame)


def _begun(states: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements that stand for given states, whatever was before."""
    s = states.reshape(len(states), 2, 5)
    born = ~np.isnan(s).any(axis=2)
    s = np.nan_to_num(s)
    p = np.stack([s[..., [2, 3]], s[..., [3, 4]]], axis=-2)
    zero, flat = np.zeros_like(p), np.zeros_like(s[..., :2])
    return zero, s[..., :2], p, flat, zero, born.astype(float), s[..., :2], p


def mahalanobis(states: DataFrame, zx: Column, zy: Column) -> Column:
    """Distance of a measurement from a state, both axes having noise pp + 1."""
    return F.sqrt((zx - states["x"]) ** 2 / (states["x_pp"] + 1) + (zy - states["y"]) ** 2 / (states["y_pp"] + 1))
