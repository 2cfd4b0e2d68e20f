"""Small networks: behaviour cloning, a policy's probabilities and a recurrent forecast.

Training sums gradients by partition: each step is one pass in which Spark deals the rows and adds up the gradients, so data of any
size trains one model; the driver holds the weights only. Weights start from a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators import motion
from percepta.shared import freed, written

Weights = list[np.ndarray]


def _summed(data: DataFrame, columns: list[str], gradients: Callable[..., tuple], weights: Weights) -> tuple[Weights, list[float], int]:
    """Adds up gradients(weights, arrays…) → (gradients, losses) over all rows of data; also the number of rows."""

    def partition(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total, losses, rows = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [np.array(batch.column(c).to_pylist(), float) for c in columns]
            g, own = gradients(weights, *arrays)
            flat = np.concatenate([x.ravel() for x in g])
            total, losses, rows = (flat, np.array(own), batch.num_rows) if total is None else (total + flat, losses + own, rows + batch.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[rows], losses, total]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = data.select(*columns).mapInArrow(partition, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    if not len(sums):
        raise ValueError("no rows to train on")
    flat = sums.sort_values("i")["v"].to_numpy()
    n_losses = len(flat) - 1 - sum(w.size for w in weights)
    cuts = np.split(flat[1 + n_losses :], np.cumsum([w.size for w in weights])[:-1])
    return [c.reshape(w.shape) for c, w in zip(cuts, weights, strict=True)], flat[1 : 1 + n_losses].tolist(), int(flat[0])


# Behaviour cloning


def layers(sizes: list[int], seed: int = 0, scale: float = 0.01) -> Weights:
    """Matrices and biases of a network with hidden ramps, in turn."""
    rng = np.random.default_rng(seed)
    return [w for a, b in zip(sizes, sizes[1:], strict=False) for w in (rng.standard_normal((a, b)) * scale, np.zeros(b))]


def outputs(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The input, each hidden layer and the output."""
    made = [x]
    for i in range(0, len(weights), 2):
        z = made[-1] @ weights[i] + weights[i + 1]
        made.append(np.maximum(z, 0) if i + 2 < len(weights) else z)
    return made


def _divergences(predicted: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sums over the rows of a batch, or of each of several."""
    p, q = (np.abs(v) + 1e-8 for v in (predicted, wanted))
    p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
    return (q * (np.log(q + 1e-8) - np.log(p + 1e-8))).sum((-2, -1))


def _cloning(weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[Weights, list[float]]:
    made = outputs(weights, x)
    delta, out = made[-1] - y, []
    for i in range(len(weights) - 2, -1, -2):
        out[:0] = [made[i // 2].T @ delta, delta.sum(0)]
        if i:
            delta = (delta @ weights[i].T) * (made[i // 2] > 0)
    return out, [float(((made[-1] - y) ** 2).sum()), float(_divergences(made[-1], y))]


@dataclass
class Cloned:
    """Weights, and for every step (or epoch) its loss: mse + 0.1 · divergence, which is summed over rows and not averaged."""

    weights: Weights
    history: list[dict] = field(default_factory=list)


def cloning_losses(model: Cloned, data: DataFrame, observation: str = "observation", action: str = "action") -> dict:
    """mse, kl and total over all rows of data."""
    _, (squares, kl), n = _summed(data, [observation, action], _cloning, model.weights)
    mse = squares / (n * len(model.weights[-1]))
    return {"mse": mse, "kl": kl, "total": mse + 0.1 * kl}


def clone_behaviour(data: DataFrame, hidden: tuple[int, ...] = (256, 256), steps: int = 20, rate: float = 1e-3, seed: int = 0, observation: str = "observation", action: str = "action", validation: DataFrame | None = None, patience: int = 10) -> Cloned:
    """Trains actions from observations (array columns), a full pass a step; with validation rows it ends when their loss hasn't fallen for `patience` steps."""
    data = written(data.select(observation, action), "cloning")  # read at every step
    first = data.select(F.size(observation).alias("x"), F.size(action).alias("y")).first()
    if first is None:
        freed(data)
        raise ValueError("no rows to train on")
    model, best, since = Cloned(layers([first.x, *hidden, first.y], seed)), float("inf"), 0
    for step in range(steps):
        g, (squares, kl), n = _summed(data, [observation, action], _cloning, model.weights)
        mse = squares / (n * first.y)
        model.weights = [w - rate * x / n for w, x in zip(model.weights, g, strict=True)]
        model.history.append({"step": step, "mse": mse, "kl": kl, "total": mse + 0.1 * kl, "validation": None})
        if validation is not None:
            loss = cloning_losses(model, validation, observation, action)["total"]
            model.history[-1]["validation"] = loss
            best, since = (loss, 0) if loss < best else (best, since + 1)
            if since >= patience:
                break
    freed(data)
    return model


def predicted_actions(data: DataFrame, model: Cloned, observation: str = "observation", noise: float = 0.0, seed: int = 0) -> DataFrame:
    """data with predicted, an array; a null observation gives null. noise adds normal noise of that deviation."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
    weights = model.weights

    def predict(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(batch.schema.names.index(observation)).to_pylist()
            there = [i for i, v in enumerate(raw) if v is not None]
            out: list = [None] * len(raw)
            if there:
                for i, y in zip(there, outputs(weights, np.array([raw[i] for i in there], float))[-1].tolist(), strict=True):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "predicted"])

    out = data.mapInArrow(predict, f"{fields}, predicted array<double>")
    return out.withColumn("predicted", F.transform("predicted", lambda v: v + noise * F.randn(seed))) if noise else out


def divergence(predicted: str, wanted: str) -> Column:
    """A row's divergence of two arrays, read as shares of their absolute values."""
    share = lambda c: F.transform(c, lambda v: (F.abs(v) + 1e-8) / F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.abs(x) + 1e-8))
    each = F.zip_with(share(F.col(wanted)), share(F.col(predicted)), lambda q, p: q * (F.log(q + 1e-8) - F.log(p + 1e-8)))
    return F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)


def training_statistics(log: DataFrame, order: str = "step", loss: str = "total", mse: str = "mse", run: str | None = None) -> DataFrame:
    """One row over a log of steps, or one for each run: their number, average, least and largest loss, average mse and whether the last loss is below the first."""
    trend = F.when(F.max_by(loss, order) < F.min_by(loss, order), "decreasing").otherwise("increasing")
    return (log.groupBy(run) if run else log).agg(F.count("*").alias("num_steps"), F.avg(loss).alias("avg_loss"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"), F.avg(mse).alias("avg_mse"), trend.alias("loss_trend"))


def batches_of(rows: DataFrame, size: int, key: str, order: str) -> DataFrame:
    """Adds batch, counted from 0 within each key in order; rows that fill no whole batch are left out. ValueError below a size of 1."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    w = Window.partitionBy(key)
    out = rows.withColumns({"batch": F.floor((F.row_number().over(w.orderBy(order)) - 1) / size), "whole": F.floor(F.count("*").over(w) / size)})
    return out.filter(F.col("batch") < F.col("whole")).drop("whole")


def stopping(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "validation", patience: int = 10) -> DataFrame:
    """For every run of a log of epochs: best_epoch, best_loss, and stopped, the first epoch `patience` after a best one without a better one, else null."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(before.isNull() | (F.col(loss) < before), F.col(epoch))
    s = log.withColumn("better", better).withColumn("since", F.col(epoch) - F.max("better").over(w))
    out = s.groupBy(run).agg(F.min(F.when(F.col("since") >= patience, F.col(epoch))).alias("stopped"))
    seen = s.join(out, run).filter(F.col("stopped").isNull() | (F.col(epoch) <= F.col("stopped")))
    return seen.groupBy(run, "stopped").agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"), F.count("*").alias("epochs"))


def training_summary(log: DataFrame, order: str = "step", loss: str = "total", mse: str = "mse", validation: str = "validation", run: str | None = None) -> DataFrame:
    """One row over a log of epochs, or one for each run: their number, the best one by validation loss and its loss, the last, average, least and largest
    loss, the average mse, the improvement from first to last, and the last validation loss."""
    first, last = F.min_by(loss, order), F.max_by(loss, order)
    best = F.min_by(order, F.when(F.col(validation).isNotNull(), F.struct(validation, order)))
    return (log.groupBy(run) if run else log).agg(F.count("*").alias("total_epochs"), best.alias("best_epoch"), F.min(validation).alias("best_loss"), last.alias("final_loss"), F.avg(loss).alias("avg_loss"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"), F.avg(mse).alias("avg_mse"), (first - last).alias("loss_improvement"), F.max_by(validation, order).alias("val_final_loss"))


def save_settings(spark, settings: dict, path: str) -> None:
    """Settings of a training as one row of JSON in a folder that all can read."""
    import json

    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()[0])


# A policy's probabilities


def log_probability(action: str, mean: str, deviation: str) -> Column:
    """Of an action under independent normals, without the constant term: -½ Σ (log σ² + (a − μ)² / σ²)."""
    off = F.zip_with(action, mean, lambda a, m: (a - m) * (a - m))
    each = F.zip_with(off, deviation, lambda d, s: F.log(s * s) + d / (s * s))
    return -0.5 * F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)


def policy_losses(steps: DataFrame) -> DataFrame:
    """One row: policy_loss (−mean of log probability · normalised advantage), value_loss (mean squared error of the value against
    the return), entropy (−mean of log probability) and total_loss, the sum of the first two. The weights of a policy are not changed."""
    stats = steps.agg(F.avg("advantage").alias("m"), F.stddev_pop("advantage").alias("s"))
    scaled = (F.col("advantage") - F.col("m")) / (F.col("s") + 1e-8)
    gap = F.col("value") - F.col("ret")
    out = steps.join(F.broadcast(stats)).agg((-F.avg(F.col("log_prob") * scaled)).alias("policy_loss"), F.avg(gap * gap).alias("value_loss"), (-F.avg("log_prob")).alias("entropy"))
    return out.withColumn("total_loss", F.col("policy_loss") + F.col("value_loss"))


def sampled_actions(data: DataFrame, model: Cloned, deviation: list[float], observation: str = "observation", seed: int = 0) -> DataFrame:
    """data with mean, deviation, action (drawn around the mean) and log_prob."""
    out = predicted_actions(data, model, observation).withColumnRenamed("predicted", "mean")
    draws = [F.lit(float(s)) * F.randn(seed + i) + F.col("mean")[i] for i, s in enumerate(deviation)]
    out = out.withColumns({"deviation": F.array(*[F.lit(float(s)) for s in deviation]), "action": F.when(F.col("mean").isNotNull(), F.array(*draws))})
    return out.withColumn("log_prob", log_probability("action", "mean", "deviation"))


# A recurrent forecast of velocities


def velocity_windows(positions: DataFrame, history: int) -> DataFrame:
    """track_id, frame_id, window (the `history` velocities before, oldest first), target: tracks of fewer than history + 2 points have none."""
    d = motion.differences(positions).filter("vx is not null").withColumn("v", F.array("vx", "vy"))
    w = motion.frames().rowsBetween(-history, -1)
    rows = d.withColumn("window", F.collect_list("v").over(w)).filter(F.size("window") == history)
    return rows.select("track_id", "frame_id", "window", F.col("v").alias("target"))


def last_windows(positions: DataFrame, history: int) -> DataFrame:
    """track_id, x, y and the last `history` velocities, filled up at the front with the first one; zeros for a track of one point."""
    d = motion.differences(positions)
    some = F.array_sort(F.collect_list(F.when(F.col("vx").isNotNull(), F.struct("frame_id", F.array("vx", "vy").alias("v")))))
    g = d.groupBy("track_id").agg(F.max_by(F.struct("x", "y"), "frame_id").alias("at"), F.transform(some, lambda s: s["v"]).alias("v"))
    first = F.coalesce(F.try_element_at("v", F.lit(1)), F.array(F.lit(0.0), F.lit(0.0)))
    kept = F.slice("v", F.greatest(F.size("v") - history + 1, F.lit(1)), history)
    return g.select("track_id", "at.*", F.concat(F.array_repeat(first, F.lit(history) - F.size(kept)), kept).alias("window"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _gates(weights: Weights, x: np.ndarray) -> tuple[list, np.ndarray]:
    """Runs windows (n, t, 2) through a gated recurrent layer and a linear one."""
    w, u, b, out, bias = weights
    k = u.shape[0]
    h, kept = np.zeros((len(x), k)), []
    for t in range(x.shape[1]):
        wx = x[:, t] @ w + b
        hu = h @ u
        r, z = _sigmoid(wx[:, :k] + hu[:, :k]), _sigmoid(wx[:, k : 2 * k] + hu[:, k : 2 * k])
        n = np.tanh(wx[:, 2 * k :] + r * hu[:, 2 * k :])
        kept.append((x[:, t], h, r, z, n, hu))
        h = (1 - z) * n + z * h
    kept.append(h)
    return kept, h @ out + bias


def _forecasting(weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[Weights, list[float]]:
    w, u, b, out, _ = weights
    k = u.shape[0]
    kept, made = _gates(weights, x)
    delta = 2 * (made - y)
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b)
    dout, dbias, dh = kept[-1].T @ delta, delta.sum(0), delta @ out.T
    for xt, h, r, z, n, hu in reversed(kept[:-1]):
        dn, dz = dh * (1 - z) * (1 - n * n), dh * (h - n) * z * (1 - z)
        dr = dn * hu[:, 2 * k :] * r * (1 - r)
        inner = np.concatenate([dr, dz, dn], 1)
        outer = np.concatenate([dr, dz, dn * r], 1)
        dw, du, db = dw + xt.T @ inner, du + h.T @ outer, db + inner.sum(0)
        dh = dh * z + outer @ u.T
    return [dw, du, db, dout, dbias], [float(((made - y) ** 2).sum())]


@dataclass
class Forecaster:
    weights: Weights
    history: int
    loss: float = float("nan")


def fit_forecast(positions: DataFrame, history: int = 5, hidden: int = 16, steps: int = 60, rate: float = 1e-2, seed: int = 0) -> Forecaster:
    """Learns the next velocity from the `history` before it, by adaptive moments over full passes. ValueError without any window."""
    rng = np.random.default_rng(seed)
    wide = 1 / np.sqrt(hidden)
    weights = [rng.uniform(-wide, wide, s) for s in ((2, 3 * hidden), (hidden, 3 * hidden), (3 * hidden,), (hidden, 2), (2,))]
    data = written(velocity_windows(positions, history), "velocity-windows")
    first, second, loss = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], float("nan")
    for step in range(1, steps + 1):
        g, (squares,), n = _summed(data, ["window", "target"], _forecasting, weights)
        loss = squares / (2 * n)
        for i, x in enumerate(g):
            x = x / (2 * n)
            first[i], second[i] = 0.9 * first[i] + 0.1 * x, 0.999 * second[i] + 0.001 * x * x
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    freed(data)
    return Forecaster(weights, history, loss)


def learned_forecast(positions: DataFrame, model: Forecaster | None, horizon: int = 5) -> DataFrame:
    """track_id, step, x, y: velocities are forecast one by one, each from the last ones and those forecast before. RuntimeError without a model."""
    if model is None:
        raise RuntimeError("fit the forecast first")
    weights = model.weights

    def roll(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            window = np.array(batch.column("window").to_pylist(), float)
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
            for step in range(1, horizon + 1):
                v = _gates(weights, window)[1]
                at, window = at + v, np.concatenate([window[:, 1:], v[:, None]], 1)
                yield pa.RecordBatch.from_arrays([batch.column("track_id"), pa.array(np.full(len(at), step, np.int32)), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["track_id", "step", "x", "y"])

    rows = last_windows(positions, model.history)
    return rows.mapInArrow(roll, f"track_id {rows.schema['track_id'].dataType.simpleString()}, step int, x double, y double")


MODELS = ("cv", "ca", "learned")


def forecast(positions: DataFrame, model: str = "cv", horizon: int = 5, history: int | None = None, fitted: Forecaster | None = None) -> DataFrame:
    """Forecasts by the model's name, from the last `history` frames of each track if given. ValueError for another name."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    if history is not None:
        nth = F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("frame_id").desc()))
        positions = positions.withColumn("nth", nth).filter(F.col("nth") <= history).drop("nth")
    return learned_forecast(positions, fitted, horizon) if model == "learned" else motion.forecast(positions, model, horizon)
