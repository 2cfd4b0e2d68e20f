"""Training in ordered batches equals a loop on one machine."""

import numpy as np
import pytest

from percepta.operators import networks, ordered


def _rows(n):
    rng = np.random.default_rng(n)
    return rng.normal(size=(n, 3)), rng.normal(size=(n, 2))


def _frame(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "at long, observation array<double>, action array<double>").repartition(7, "observation")


def _loop(x, y, size, epochs, rate, w):
    log = []
    for e in range(epochs):
        for k in range(len(x) // size):
            a, b = x[k * size : (k + 1) * size], y[k * size : (k + 1) * size]
            made = np.maximum(a @ w[0] + w[1], 0)
            off = made @ w[2] + w[3] - b
            log.append((e, k, (off**2).mean()))
            d = off / size
            back = (d @ w[2].T) * (made > 0)
            w = [w[0] - rate * a.T @ back, w[1] - rate * back.sum(0), w[2] - rate * made.T @ d, w[3] - rate * d.sum(0)]
    return w, log


@pytest.mark.parametrize("share", [16, 50, 10_000])
def test_weights_equal_a_loop_over_batches(spark, share):
    x, y = _rows(203)
    model = ordered.train_in_batches(_frame(spark, x, y), ["at"], size=8, epochs=2, hidden=(4,), rate=0.1, seed=3, share=share)
    w, log = _loop(x, y, 8, 2, 0.1, networks.layers([3, 4, 2], 3))
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-12) for a, b in zip(model.weights, w, strict=True))
    got = [(r.epoch, r.batch, r.mse) for r in model.log.orderBy("epoch", "batch").collect()]
    assert got == [(e, k, pytest.approx(m)) for e, k, m in log] and len(model.history) == 2
    assert model.history[1]["mse"] == pytest.approx(np.mean([m for e, _, m in log if e == 1]))


def test_equal_places_follow_their_values_and_nulls_go(spark):
    x, y = _rows(40)
    at = [i // 10 for i in range(40)]
    rows = [(p, a.tolist(), b.tolist()) for p, a, b in zip(at, x, y, strict=True)]
    bad = [(0, None, [1.0, 1.0]), (1, [1.0, None, 2.0], [1.0, 1.0]), (2, [1.0, 1.0, 1.0], None)]
    schema = "observation int, o array<double>, a array<double>"  # the order's name clashes with the default of another column
    df = spark.createDataFrame((rows + bad)[::-1], schema).repartition(5)
    model = ordered.train_in_batches(df, ["observation"], size=5, hidden=(4,), rate=0.1, seed=3, observation="o", action="a", share=10)
    rows.sort()
    w, _ = _loop(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), 5, 1, 0.1, networks.layers([3, 4, 2], 3))
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-12) for a, b in zip(model.weights, w, strict=True))


def test_small_and_repeated_rows_and_patience(spark):
    x, y = _rows(20)
    df = _frame(spark, x, y)
    for few in (df.limit(0), df.limit(7)):
        with pytest.raises(ValueError):
            ordered.train_in_batches(few, ["at"], size=8)
    with pytest.raises(ValueError):
        ordered.train_in_batches(df, ["at"], size=0)
    same = df.limit(1).selectExpr("explode(array_repeat(struct(*), 64)) as r").select("r.*")
    assert ordered.train_in_batches(same, ["at"], size=8, hidden=(), share=16).log.count() == 8
    still = ordered.train_in_batches(df, ["at"], size=4, epochs=30, hidden=(), rate=0.0, validation=df, patience=2)
    assert len(still.history) == 3 and still.history[0]["validation"] == still.history[2]["validation"]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as v", "if(id % 3 = 0, null, id) as extra").repartition(9)
    got = ordered.numbered(df, ["v"]).select("v", "nth").collect()
    assert len(got) == 1000 and all(r.v == r.nth for r in got)


def test_a_net_without_layers_steps_by_moments(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(130, 3)), rng.normal(size=(130, 2))
    w = [rng.normal(size=(3, 2)), rng.normal(size=2)]
    now, losses = ordered._one_by_one(w, x[:128].reshape(16, 8, 3), y[:128].reshape(16, 8, 2), 0.1)

    def refused(*_):
        raise AssertionError("a gradient for each batch")

    monkeypatch.setattr(ordered, "_cloning", refused)
    rows = [pa.RecordBatch.from_arrays([pa.array(v[i : i + 50].tolist(), pa.list_(pa.float64())) for v in (x, y)], names=["x_", "y_"]) for i in (0, 50, 100)]
    got = [r for b in ordered._steps(w, 8, 0.1, 5)(rows) for r in b.to_pylist()]
    assert [(r["batch"], r["mse"], r["kl"]) for r in got[:-1]] == [(5 + k, pytest.approx(s / 16), pytest.approx(kl)) for k, (s, kl) in enumerate(losses)]
    assert got[-1]["weights"] == pytest.approx(np.concatenate([v.ravel() for v in now]), rel=1e-9)
    ragged = pa.RecordBatch.from_arrays([pa.array([[1.0], [1.0, 2.0, 3.0]]), pa.array([[1.0, 1.0]] * 2)], names=["x_", "y_"])
    with pytest.raises(ValueError):
        list(ordered._steps(w, 1, 0.1, 0)([ragged]))
