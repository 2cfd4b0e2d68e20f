"""Whitening of embeddings: shifted CholeskyQR over distributed Gram passes, and the singular vectors of the composed triangle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.shared import fresh_path, packed

#: An entry c becomes floor(SCALE · c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Half the distance of doubles at 1.
UNIT = 2.0**-53


@dataclass
class Whitening:
    """n of the fit list and its sums as n · whole + rest; components as columns, by falling eigenvalue; all eigenvalues' sum; largest entry of the whitened covariance less the identity."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.whole, self.rest / self.n) @ self.components) / np.sqrt(self.eigenvalues)


def _centred(x: np.ndarray, whole: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x less its mean, exact up to the last subtraction."""
    return (x - whole) - middle


def whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """rows with x, the array of longs; vectors that are null, empty or hold null, non-finite or out-of-range entries have no row.

    Out of range is an entry whose number does not fit in 53 bits.
    """
    c = F.transform(F.col(vector), lambda v: v.cast("double") * SCALE)
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v) < 2.0**52, F.lit(False)))  # NaN is above all numbers
    return rows.filter(fine & (F.size(vector) > 0)).withColumn("x", F.transform(c, lambda v: F.floor(v) + OFFSET))


def _matrix(column) -> np.ndarray:
    """A list column without nulls, of equal lengths, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _gram(of: Callable[[np.ndarray], np.ndarray], d: int):
    """A partition's part of AᵀA for the rows A = of(x): one output row for each row of the product."""

    def add(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                a = of(_matrix(batch.column("x")))
                total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return add


def _added(batches: Iterable) -> Iterator:
    """The sums of equal rows of all partitions' products."""
    import pyarrow as pa

    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), _matrix(batch.column("row")), strict=True):
            held[i] = held[i] + row if i in held else row.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["i", "row"])


def gram(x: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """AᵀA over all rows: products are summed in each partition, then by row of the product; d rows of d numbers reach the driver."""
    out = np.zeros((d, d))
    parts = x.select("x").mapInArrow(_gram(of, d), "i int, row array<double>")
    for r in parts.repartition("i").mapInArrow(_added, "i int, row array<double>").toArrow().to_pylist():
        out[r["i"]] = r["row"]
    return out


def _solved(upper: np.ndarray, a: np.ndarray) -> np.ndarray:
    """a · upper⁻¹ by forward substitution over the columns of the triangle."""
    out = np.empty_like(a)
    for j in range(upper.shape[0]):
        out[:, j] = (a[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper triangle R with RᵀR = g; with the shift of the method where asked for or where rounding has made g indefinite."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * np.trace(g)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def fit_whitening(x: DataFrame, most: int = 16, tolerance: float = 1e-13, most_passes: int = 8) -> Whitening | None:
    """Components of the covariance of the distinct vectors x (array of longs, equal lengths); None without any.

    A is the matrix of centred rows x - S/n. A first pass makes G = AᵀA and R₁, the Cholesky factor of G plus a shift that keeps it positive
    whatever the rounding. Each further pass solves Q = A R₁⁻¹ … Rₖ⁻¹ against the triangles row block by row block, makes QᵀQ and its
    factor; it ends when QᵀQ is the identity within d · tolerance, mostly after three. R = Rₖ … R₁ then has A's singular values and right
    singular vectors to double precision, unlike G, whose small ones are squared: e = σ² / n. Rows are written once and read by each
    pass; a partition holds one batch and one d × d matrix, and so does the driver, so d is meant up to some thousands.

    Entries that are equal in all rows take no part and have 0 in every component. Directions of rank 0 never become orthonormal;
    with them passes end after most_passes, and components whose e isn't above 1e-12 of the largest are left out.
    """
    spark, path = x.sparkSession, fresh_path(x.sparkSession, "fit-list")
    x.select("x").distinct().write.parquet(path)
    rows = spark.read.parquet(path)
    d = rows.select(F.size("x")).first()
    if d is None:
        return None
    d = d[0]
    halves = [lambda c: F.sum(F.shiftright(c, 26)), lambda c: F.sum(c.bitwiseAND(F.lit((1 << 26) - 1))), F.min, F.max]
    n, *found = rows.agg(F.count("*"), *[f(F.get("x", i)).alias(f"f{k}_{i}") for k, f in enumerate(halves) for i in range(d)]).first()
    high, low, least, largest = (found[k * d : (k + 1) * d] for k in range(4))  # sums in two halves don't overflow
    whole, rest = (np.array(v, dtype=np.int64) for v in zip(*(divmod((h << 26) + v, n) for h, v in zip(high, low, strict=True)), strict=True))
    live = np.flatnonzero(np.array(least) != np.array(largest))
    if not len(live):
        return Whitening(n, whole, rest, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    middle = rest / n
    triangles: list[np.ndarray] = []

    def turned(v: np.ndarray) -> np.ndarray:
        a = _centred(v, whole, middle)[:, live]
        for r in triangles:
            a = _solved(r, a)
        return a

    k, r = len(live), np.eye(len(live))
    trace = 0.0
    for nth in range(most_passes):
        g = gram(rows, turned, k)
        if nth == 0:
            trace = float(np.trace(g)) / n
        elif np.abs(g - np.eye(k)).max() <= k * tolerance:
            break
        triangles.append(_factor(g, n, shifted=nth == 0))
        r = triangles[-1] @ r
    _, sigma, turns = np.linalg.svd(r)
    e = sigma**2 / n
    kept = int((e > e[0] * 1e-12).sum()) if e[0] > 0 else 0
    kept = min(kept, most)
    components = np.zeros((d, kept))
    components[live] = turns[:kept].T
    model = Whitening(n, whole, rest, components, e[:kept], trace, 0.0, len(triangles))
    if kept:
        # A column of ones beside the whitened rows gives their means.
        seen = gram(rows, lambda v: np.concatenate([model.whitened(v), np.ones((len(v), 1))], axis=1), kept + 1) / n
        model.identity_error = float(np.abs(seen[:kept, :kept] - np.outer(seen[:kept, kept], seen[:kept, kept]) - np.eye(kept)).max())
    return model


def _deviation(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Sum of (n·x - S)² of every row, exact; null beyond 64 bits."""
    near = x - whole
    if len(x) and float(np.abs(near).max() + 1) * n < (2.0**62 / max(x.shape[1], 1)) ** 0.5:
        return ((n * near - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in near]
    return [v if v < 2**63 else None for v in exact]


def _applied(model: Whitening):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"))
            w = model.whitened(x) if len(batch) else np.zeros((0, 0))
            at = batch.schema.get_field_index("x")
            others = [k for k in range(batch.num_columns) if k != at]
            arrays = [*(batch.column(k) for k in others), pa.array(_deviation(x, model.n, model.whole, model.rest) if len(batch) else [], pa.int64()), pa.array(list(w), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[k] for k in others), "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """(row, deviation, whitened) for every row with a usable vector, row being all columns of `vectors` as a struct, and the fitted model.

    whitened: an array of up to `most` numbers. The fit list is each distinct vector once, so repeated rows change nothing; all rows are
    projected, repeated ones alike. Vectors that are null, empty or hold null, non-finite or very large entries have no row. Of vectors of
    several lengths the most frequent length counts (the longest of equals), others have no row. One vector, or equal ones, have deviation 0 and no
    component; an empty table gives an empty result. Column names can't clash.
    """
    rows = whole_numbers(packed(vectors).withColumn("v", F.col(f"row.`{vector}`")), "v").drop("v")
    lengths = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()
    rows = rows.filter(F.size("x") == F.lit(lengths.d))
    model = fit_whitening(rows, most)
    schema = T.StructType([rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return rows.mapInArrow(_applied(model), schema), model


def whitened_components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained (e / trace) and identity_error for every usable row and component; see whiten()."""
    found, model = whiten(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", most)
    explained = [] if model is None or not model.trace else (model.eigenvalues / model.trace).tolist()
    n, error = (0, 0.0) if model is None else (model.n, model.identity_error)
    each = found.select(F.col("row.key").alias(key), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("k"))
    return each.select(key, (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
