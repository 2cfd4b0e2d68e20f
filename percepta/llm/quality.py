"""Quality classifier: ridge on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percepta.llm.labelled import training_rows
from percepta.shared import written

_KINDS = np.zeros((7, 256))
for _b in range(256):
    _c = chr(_b)
    _k = 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:!?'\"-()" else 6
    _KINDS[_k, _b] = 1.0
N_STATS = 18


def statistics(text: bytes) -> list[float]:
    """Shares of byte kinds, word and line statistics and repetition of a whole text; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = _KINDS @ counts / n
    found = text.split()
    m = len(found)
    if not m:
        return [*share, np.log1p(n), *[0.0] * (N_STATS - 8)]
    lengths = np.fromiter(map(len, found), float, m)
    distinct = len(set(found))
    same = sum(a == b for a, b in zip(found, found[1:], strict=False)) / m
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = counts[46] + counts[33] + counts[63]
    return [*share, np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), distinct / m, distinct / np.sqrt(m), same, len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), (stops + 1) / (m + 1), sum(w[-1:].isalpha() or w[-1] >= 128 for w in found) / m]


def _stats(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        stats = [statistics(t.as_py() or b"") for t in texts]
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(stats, pa.list_(pa.float64()))], names=[*rest, "stats"])


@dataclass
class QualityModel:
    """centre and spread of the statistics; turn and shift of the Fourier features; weights of the ridge; steps and levels of the calibration."""

    centre: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.centre, self.spread, self.turn, self.shift) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated to 0…1, linear between the steps of the isotonic fit."""
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0.0, 1.0)


def fourier(stats: np.ndarray, centre, spread, turn, shift) -> np.ndarray:
    """cos(turn·z + shift), whose products approximate a Gaussian kernel of the standardised statistics, and a constant."""
    z = np.clip((stats - centre) / spread, -6, 6)
    return np.concatenate([np.sqrt(2.0 / len(shift)) * np.cos(z @ turn + shift), np.ones((len(z), 1))], axis=1)


def _normal(centre, spread, turn, shift):
    """A partition's sums for the normal equations of each fold: one row for each row of the matrix."""

    def add(batches: Iterable) -> Iterator:
        import pyarrow as pa

        d = len(shift) + 1
        sums = np.zeros((2, d, d + 1))
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), float).reshape(-1, N_STATS)
            y, fold = batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
            x = fourier(stats, centre, spread, turn, shift)
            for f in (0, 1):
                own = x[fold == f]
                sums[f] += own.T @ np.concatenate([own, y[fold == f][:, None]], axis=1)
        rows = [(f, i, sums[f, i].tolist()) for f in (0, 1) for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["fold", "i", "sums"])

    return add


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean x and the level of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            for k in range(3):
                pools[-1][k] += last[k]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, rest: int = 2, most: int = 20_000, features: int = 256, width: float = 3.0, ridge: float = 1e-3, seed: int = 8) -> QualityModel:
    """Fits on up to `most` labelled documents that aren't held out.

    Each partition sums its part of the normal equations for two folds; the sums of all partitions, `features`² numbers a
    fold, are added up by row. Calibration uses each fold's scores under the other fold's ridge, so it isn't fooled by the fit.
    Without labels every document scores 0.5; with labels of one kind, that label.
    """
    sample = training_rows(docs, labels, label, parts, rest, most).repartition(8, "doc_id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold")
    sample = written(sample.select("text", "y", fold).mapInArrow(_stats, "y int, fold int, stats array<double>"), "statistics")
    moments = sample.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS)]).agg(F.count("*"), *[f(f"s{i}") for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]).first()
    rng = np.random.default_rng(seed)
    turn, shift = rng.standard_normal((N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features)
    if not moments[0]:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), turn, shift, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    centre, spread = np.array(moments[1 : N_STATS + 1]), np.maximum(np.array(moments[N_STATS + 1 :]), 1e-6)
    d = features + 1
    rows = sample.mapInArrow(_normal(centre, spread, turn, shift), "fold int, i int, sums array<double>")
    added = rows.select("fold", "i", F.posexplode("sums").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    sums = np.zeros((2, d, d + 1))
    got = added.toPandas()
    sums[got["fold"], got["i"], got["j"]] = got["v"]
    solve = lambda s: np.linalg.solve(s[:, :d] + ridge * max(s[d - 1, d - 1], 1.0) * np.diag([1.0] * (d - 1) + [1e-6]), s[:, d])
    model = QualityModel(centre, spread, turn, shift, solve(sums.sum(0)), np.zeros(1), np.zeros(1))
    seen = sample.toPandas()  # at most `most` rows of N_STATS numbers, one for each labelled id
    stats, y, own = np.array(seen["stats"].tolist(), float), seen["y"].to_numpy(float), seen["fold"].to_numpy()
    x = fourier(stats, centre, spread, turn, shift)
    out = np.where(own == 0, x @ solve(sums[1]), x @ solve(sums[0])) if len(set(own)) == 2 else x @ model.weights
    model.steps, model.levels = isotonic(out, y)
    return model


def _scored(model: QualityModel):
    def score(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            stats = np.array([statistics(t.as_py() or b"") for t in texts], float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(stats) if len(stats) else stats[:, 0])], names=["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row, from the whole text; null counts as empty.

    Texts of any length are read once, with memory for one of them. Every row has a score of its own, so equal texts,
    repeated rows and ties score alike; an empty table gives an empty result. Other columns are left out.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


