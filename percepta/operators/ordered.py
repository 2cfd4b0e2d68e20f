"""Training in ordered batches: each step starts from the weights of the one before, over any number of rows.

Rows are numbered once by counted ranges of their order and written as shares of whole batches. A share is one task, which streams its
rows, steps batch by batch and logs each; its weights begin the next share. A lost executor costs one share, and no task or driver holds
more than a batch of rows. The steps of one model can't run side by side, so time grows with the rows; only numbering is spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators.networks import Cloned, Weights, _cloning, _divergences, cloning_losses, layers
from percepta.shared import fresh_path, freed, written


@dataclass
class Trained(Cloned):
    """Weights; history has a row for each epoch; log (epoch, batch, mse, kl, total) has one for each step, before it is taken."""

    log: DataFrame | None = None


def numbered(rows: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """rows with their place from 0 in the order of the columns `order`, in a written table; nulls come first, equal rows in any order."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    ranges = written(sorted_rows.withColumn(name, at), "ranges")
    part = F.shiftright(name, 33)
    # One row a range, of which there are as many as shuffle partitions.
    before = ranges.groupBy(part.alias("range_")).agg(F.count("*").alias("rows_"))
    before = before.select("range_", (F.sum("rows_").over(Window.orderBy("range_")) - F.col("rows_")).alias("before_"))
    out = ranges.withColumn("range_", part).join(F.broadcast(before), "range_")
    out = written(out.withColumn(name, F.col("before_") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("range_", "before_"), "numbered")
    freed(ranges)
    return out


def _arrays(column) -> np.ndarray:
    """Rows of an Arrow column of arrays without nulls; ValueError unless they are of one length."""
    import pyarrow.compute as pc

    n = pc.list_value_length(column)
    if pc.min(n).as_py() != pc.max(n).as_py():
        raise ValueError("arrays of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _one_by_one(now: Weights, x: np.ndarray, y: np.ndarray, rate: float) -> tuple[Weights, list[tuple[float, float]]]:
    """The weights after a step for each batch x[k], y[k], and the sums (squares, divergence) before each."""
    losses = []
    for a, b in zip(x, y, strict=True):
        g, (squares, kl) = _cloning(now, a, b)
        now = [w - rate * v / len(a) for w, v in zip(now, g, strict=True)]
        losses.append((squares, kl))
    return now, losses


def _without_layers(now: Weights, x: np.ndarray, y: np.ndarray, rate: float) -> tuple[Weights, list[tuple[float, float]]]:
    """As _one_by_one() for a net without hidden layers: a step is a linear map of the weights by its batch's moments, which are summed for
    all batches at once; only the small product is left for each step. The losses follow for all batches at once too."""
    x = np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)
    turned = x.transpose(0, 2, 1)
    keep, add = np.eye(x.shape[2]) - rate / x.shape[1] * (turned @ x), rate / x.shape[1] * (turned @ y)
    every = np.empty((len(x) + 1, x.shape[2], y.shape[2]))
    every[0] = np.concatenate([now[0], now[1][None]])
    for k in range(len(x)):
        every[k + 1] = keep[k] @ every[k] + add[k]
    made = x @ every[:-1]
    return [every[-1, :-1], every[-1, -1]], list(zip(((made - y) ** 2).sum((1, 2)).tolist(), _divergences(made, y).tolist(), strict=True))


def _steps(weights: Weights, size: int, rate: float, first: int):
    """Over sorted rows (observation, action): (batch, mse, kl, null) before each step, and (null, null, null, weights) after the last."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["batch", "mse", "kl", "weights"]
        now, at, held = weights, first, None
        stepped = _without_layers if len(weights) == 2 else _one_by_one
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [_arrays(batch.column(i)) for i in (0, 1)]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            n = len(held[0]) // size
            if not n:
                continue
            x, y = (h[: n * size].reshape(n, size, -1) for h in held)
            now, losses = stepped(now, x, y, rate)
            squares, kl = np.array(losses).T
            held = [h[n * size :] for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(squares / y[0].size), pa.array(kl), pa.nulls(n, pa.list_(pa.float64()))], names=names)
            at += n
        flat = pa.array([np.concatenate([w.ravel() for w in now]).tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), flat], names=names)

    return run


def train_in_batches(
    data: DataFrame,
    order: list[str],
    size: int = 32,
    epochs: int = 1,
    hidden: tuple[int, ...] = (256, 256),
    rate: float = 1e-3,
    seed: int = 0,
    weights: Weights | None = None,
    observation: str = "observation",
    action: str = "action",
    validation: DataFrame | None = None,
    patience: int = 10,
    share: int = 1_000_000,
) -> Trained:
    """Trains actions from observations (array columns) as a loop over batches of `size` rows in order does, `epochs` times.

    Rows beyond the last whole batch are left out, as are rows with a null array or a null within one; rows equal in `order` follow by
    observation and action. The first weights are those given, or drawn from the seed. After each epoch the loss of the validation rows is
    taken; training ends when it hasn't fallen for `patience` epochs. A share has about `share` rows. ValueError without a whole batch.
    """
    if size < 1:
        raise ValueError("a batch has one row at least")
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull())
    rows = data.filter(whole(observation) & whole(action)).select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(observation).alias("x_"), F.col(action).alias("y_"))
    nth = numbered(rows, [*[f"o{i}" for i in range(len(order))], "x_", "y_"])
    batches = nth.count() // size
    if not batches:
        freed(nth)
        raise ValueError("no whole batch of rows to train on")
    per = max(1, share // size)
    shares = written(nth.filter(F.col("nth") < batches * size).select("nth", "x_", "y_", F.floor(F.col("nth") / (size * per)).cast("long").alias("share_")), "shares", by="share_")
    freed(nth)
    if validation is not None:
        validation = written(validation.select(observation, action), "validation")  # read after every epoch
    first = shares.select(F.size("x_").alias("x"), F.size("y_").alias("y")).first()
    model = Trained(weights or layers([first.x, *hidden, first.y], seed))
    spark, logs, best, since = data.sparkSession, fresh_path(data.sparkSession, "steps"), float("inf"), 0
    cuts = np.cumsum([w.size for w in model.weights])[:-1]
    for epoch in range(epochs):
        for i in range(-(-batches // per)):
            rows = shares.filter(F.col("share_") == i).coalesce(1).sortWithinPartitions("nth").select("x_", "y_")
            path = f"{logs}/epoch={epoch}/share={i}"
            rows.mapInArrow(_steps(model.weights, size, rate, i * per), "batch long, mse double, kl double, weights array<double>").write.parquet(path)
            flat = np.array(spark.read.parquet(path).filter("weights is not null").first().weights)
            model.weights = [p.reshape(w.shape) for p, w in zip(np.split(flat, cuts), model.weights, strict=True)]
        steps = spark.read.parquet(f"{logs}/epoch={epoch}").filter("batch is not null")
        model.history.append({"epoch": epoch, **steps.agg(F.avg(F.col("mse") + 0.1 * F.col("kl")).alias("loss"), F.avg("mse").alias("mse")).first().asDict(), "validation": None})
        if validation is not None:
            loss = cloning_losses(model, validation, observation, action)["total"]
            model.history[-1]["validation"] = loss
            best, since = (loss, 0) if loss < best else (best, since + 1)
            if since >= patience:
                break
    freed(shares, *([] if validation is None else [validation]))
    if model.history:
        model.log = spark.read.option("basePath", logs).parquet(logs).filter("batch is not null").select(F.col("epoch").cast("int").alias("epoch"), "batch", "mse", "kl", (F.col("mse") + 0.1 * F.col("kl")).alias("total"))
    return model
