"""Ordered folds as parallel prefix scans: every row is an element of an associative operation, so a key's rows can be cut into ranges.

Elements are arrays over rows, combined many at a time. A key with more rows than a block is dealt by ranges of its order: each range is
reduced to one element, the few elements of a key are scanned, and each range begins with the element of all before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.shared import lookup_join, written

Element = tuple[np.ndarray, ...]
#: Rows that are combined one after the other; all chunks of a batch at once.
CHUNK = 32
#: Rows of a segment in a batch up to which a scan that can steps from row to row, all segments of the batch at once.
STEPS = 1024


class Scan(NamedTuple):
    """shapes: those of an element's parts for one row. elements: from the values of rows (NaN: null). combine: earlier, later. output: the columns of a state, NaN for null.

    step: the columns of the states after rows, from those before them (NaN: none) and the rows' values; begun: the element of given columns. With both, batches of short segments are
    stepped, as a loop over each would: fewer and simpler operations than combining, and its very rounding.
    """

    shapes: list[tuple[int, ...]]
    elements: Callable[[list[np.ndarray]], Element]
    combine: Callable[[Element, Element], Element]
    output: Callable[[Element], list[np.ndarray]]
    step: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    begun: Callable[[np.ndarray], Element] | None = None


def prefix(scan: Scan, e: Element, starts: np.ndarray) -> Element:
    """The combination of every row's element with all before it back to its segment's start."""
    n = len(starts)
    if n <= 1:
        return e
    m = -(-n // CHUNK)
    pad = lambda x: np.concatenate([x, np.repeat(x[-1:], m * CHUNK - n, axis=0)]).reshape(m, CHUNK, *x.shape[1:])
    parts, fresh = [pad(x) for x in e], pad(starts)
    for j in range(1, CHUNK):
        go = np.flatnonzero(~fresh[:, j])
        made = scan.combine(tuple(p[go, j - 1] for p in parts), tuple(p[go, j] for p in parts))
        for p, v in zip(parts, made, strict=True):
            p[go, j] = v
    if m > 1:
        begun = np.logical_or.accumulate(fresh, axis=1)
        before = prefix(scan, tuple(p[:-1, -1] for p in parts), begun[:-1, -1])
        row, col = np.nonzero(~begun[1:])
        made = scan.combine(tuple(b[row] for b in before), tuple(p[row + 1, col] for p in parts))
        for p, v in zip(parts, made, strict=True):
            p[row + 1, col] = v
    return tuple(p.reshape(m * CHUNK, *p.shape[2:])[:n] for p in parts)


def stepped(scan: Scan, values: np.ndarray, starts: np.ndarray, before: np.ndarray | None) -> np.ndarray | None:
    """The columns of the states after all rows (column, row), before: those before the first one; None if a segment has more than STEPS rows."""
    first = np.flatnonzero(starts)
    lengths = np.diff(np.append(first, len(starts)))
    if lengths.max() > STEPS:
        return None
    of = np.argsort(-lengths, kind="stable")
    first, lengths = first[of], lengths[of]
    state = np.full((len(scan.output(scan.elements(list(values[:, :1])))), len(first)), np.nan)
    if before is not None:
        state[:, of == 0] = before[:, None]
    out = np.empty((len(state), len(starts)))
    for j in range(lengths[0]):
        n = np.searchsorted(-lengths, -j)  # segments of more than j rows come first
        state = scan.step(state[:, :n], values[:, first[:n] + j])
        out[:, first[:n] + j] = state
    return out


def _flat(e: Element) -> np.ndarray:
    return np.concatenate([x.reshape(len(x), int(np.prod(x.shape[1:]))) for x in e], axis=1)


def _shaped(scan: Scan, flat: np.ndarray) -> Element:
    ends = np.cumsum([int(np.prod(s)) for s in scan.shapes])[:-1]
    return tuple(p.reshape(len(flat), *s) for p, s in zip(np.split(flat, ends, axis=1), scan.shapes, strict=True))


def _scanning(scan: Scan, n_in: int, schema: T.StructType, what: str):
    """Over sorted rows (segment, values…, carry, key, sub, order). what: rows (outputs of each), totals (one element a segment), carried (of each total, the element of those before)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        held: Element | None = None
        tail, at = None, None

        def made(rest, columns):
            arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t, mask=np.isnan(c)) if c.ndim == 1 else pa.array(list(c), t) for c, t in zip([*rest, *columns], kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            if not len(batch):
                continue
            segment = batch.column(0).to_numpy()
            values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1 : 1 + n_in]]
            carry = batch.column(1 + n_in)
            if what == "rows" and scan.step and carry.null_count == len(carry):
                starts = np.append(True, segment[1:] != segment[:-1])
                before = np.concatenate(scan.output(held)) if at is not None and segment[0] == at else None
                found = stepped(scan, np.stack(values), starts, before)
                if found is not None:
                    held, at = scan.begun(found[:, -1][None]), segment[-1]
                    yield made([batch.column(k) for k in range(2 + n_in, batch.num_columns)], list(found))
                    continue
            e = tuple(np.array(x) for x in scan.elements(values))
            given = np.flatnonzero(carry.is_valid().to_numpy(zero_copy_only=False))
            if len(given):
                flat = carry.take(pa.array(given)).flatten().to_numpy().reshape(len(given), -1)
                for x, v in zip(e, _shaped(scan, flat), strict=True):
                    x[given] = v
            starts = np.append(True, segment[1:] != segment[:-1])
            if at is not None and segment[0] == at:
                first = scan.combine(held, tuple(x[:1] for x in e))
                for x, v in zip(e, first, strict=True):
                    x[:1] = v
            elif tail is not None:
                yield tail
            before = held if at is not None and segment[0] == at else None
            e = prefix(scan, e, starts)
            rest = [batch.column(k) for k in range(2 + n_in, batch.num_columns)]
            held, at = tuple(x[-1:].copy() for x in e), segment[-1]
            if what == "rows":
                keep = np.setdiff1d(np.arange(len(segment)), given)
                yield made([c.take(pa.array(keep)) for c in rest], scan.output(tuple(x[keep] for x in e)))
            elif what == "carried":
                # Of each row the element before it; the first of a segment has none and is left out.
                keep = np.flatnonzero(~starts) if before is None else np.append(0, np.flatnonzero(~starts))
                prior = [x[keep - 1] for x in e]
                for p, v in zip(prior, before or prior, strict=True):
                    if before is not None:
                        p[0] = v[0]
                yield made([c.take(pa.array(keep)) for c in rest], [_flat(tuple(prior))])
            else:
                ends = np.append(np.flatnonzero(starts)[1:] - 1, len(segment) - 1)
                of = lambda i: made([c.take(pa.array(i)) for c in rest], [_flat(tuple(x[i] for x in e))])  # noqa: E731, B023
                yield of(ends[:-1])
                tail = of(ends[-1:])
        if tail is not None:
            yield tail

    return run


def _applied(rows: DataFrame, scan: Scan, n_in: int, schema: T.StructType, what: str, by: list[str], rest: list[str]) -> DataFrame:
    """rows(key, sub, order, value_…, carry) dealt and sorted by `by`, a segment each, and the scan over them."""
    values = [f"value_{i}" for i in range(n_in)]
    rows = rows.repartition(*by).sortWithinPartitions("key", "sub", F.col("carry").isNull(), "order", *values)
    return rows.select(F.xxhash64(*by).alias("segment"), *values, "carry", *rest).mapInArrow(_scanning(scan, n_in, schema, what), schema)


def _dealt(df: DataFrame, key: str, at: Column, values: list[Column], block: int | None, down: bool, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """rows(key, sub, order, value_…, carry), and those of keys with more than a block of rows, whose sub is a range of the order."""
    order = at.cast("long")
    rows = df.select(F.col(key).alias("key"), (-order if down else order).alias("order"), *[v.cast("double").alias(f"value_{i}") for i, v in enumerate(values)], *([F.struct(*keep).alias("kept")] if keep else [])).dropna(subset=["key", "order"])
    none = F.lit(None).cast("array<double>").alias("carry")
    if block and may_be_long(rows, block):
        counts = written(rows.groupBy("key").count().filter(F.col("count") > block), "long-keys")
        largest = counts.agg(F.max("count")).first()[0]
        if largest:
            n = -(-largest // block)
            cuts = F.percentile_approx("order", [k / n for k in range(1, n)], min(max(10_000, 20 * n), 1_000_000))
            bounds = written(lookup_join(rows, counts.select("key"), ["key"], "inner").groupBy("key").agg(F.array_distinct(cuts).alias("cuts")), "ranges")
            rows = lookup_join(rows, bounds, ["key"])
            sub = F.coalesce(_below("cuts", "order"), F.lit(0))
            rows = rows.withColumn("sub", sub.cast("int")).withColumn("carry", none)
            return rows.drop("cuts"), rows.filter(F.col("cuts").isNotNull()).drop("cuts")
    return rows.withColumn("sub", F.lit(0)).withColumn("carry", none), None


def may_be_long(df: DataFrame, block: int) -> bool:
    """Whether a key may have more than a block of rows, by Spark's estimate of the input's size at 16 bytes a row; below it, rows aren't counted.

    The answer only decides how rows are dealt, not what comes out.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 16 * block


def _below(cuts: str, value: str) -> Column:
    """How many of sorted cuts are below value, by halving."""
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.when(F.get(F.col(cuts), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) < F.col(value), F.struct((F.floor((acc["lo"] + acc["hi"]) / 2) + 1).cast("int").alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))))
    return F.when(F.col(cuts).isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step, lambda acc: acc["lo"]))


def scanned(df: DataFrame, key: str, order: str | Column, values: list[Column], scan: Scan, out: str, down: bool = False, block: int | None = 500_000, begin: tuple[str, Callable[[np.ndarray], Element]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """key, order and the columns of `out` (a schema string) for every row of df: the scan's state after it.

    Rows whose key or order is null are left out; values are doubles, null as NaN. down: from the last row to the first. Rows of equal key
    and order come by their values and stay in one range. Keys with more than `block` rows are dealt by approximate quantiles of
    their order, so that a task has about a block of them, with one more pass over these keys only; None: no key is that long, and rows aren't counted.
    begin: an array column that is null but in rows that give a key's state before its first row (one a key, order null), and
    what makes elements of such arrays, NaN for null; with it, block must be None. keep: columns of df that come along, after the others.
    """
    if df.isStreaming:
        raise ValueError("a scan takes a table: a stream has no last row to begin at" if down else "a scan takes a table")
    name = order if isinstance(order, str) else "order"
    at, n_in = F.col(order) if isinstance(order, str) else order, len(values)
    if begin:
        elements = begin[1]
        given = df.filter(F.col(begin[0]).isNotNull()).select(F.col(key).alias("key"), F.lit(0).alias("sub"), F.transform(begin[0], lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("carry"))
        rows, long = _dealt(df.filter(F.col(begin[0]).isNull()), key, at, values, None, down, keep)
        rows = rows.unionByName(_as_rows(given.mapInArrow(_elements(elements), _totals_schema(rows)), n_in), allowMissingColumns=True)
    else:
        rows, long = _dealt(df, key, at, values, block, down, keep)
    head = [T.StructField("key", rows.schema["key"].dataType), T.StructField("order", T.LongType()), *([T.StructField("kept", rows.schema["kept"].dataType)] if keep else [])]
    schema = T.StructType([*head, *T.StructType.fromDDL(out).fields])
    if long is not None:
        totals = _applied(long, scan, n_in, _totals_schema(rows), "totals", ["key", "sub"], ["key", "sub"])
        carried = _applied(_as_rows(totals, n_in), scan, n_in, _totals_schema(rows), "carried", ["key"], ["key", "sub"])
        # A range begins with a row that stands for all rows before it.
        rows = rows.unionByName(written(_as_rows(carried, n_in), "carried"), allowMissingColumns=True)
    found = _applied(rows, scan, n_in, schema, "rows", ["key", "sub"], schema.names[: len(head)])
    return found.select(F.col("key").alias(key), (-F.col("order") if down else F.col("order")).alias(name), *schema.names[len(head) :], *([f"kept.{c}" for c in keep] if keep else []))


def _elements(of: Callable[[np.ndarray], Element]):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                flat = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(_flat(of(flat))), pa.list_(pa.float64()))], names=batch.schema.names)

    return run


def _totals_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("sub", T.IntegerType()), T.StructField("carry", T.ArrayType(T.DoubleType()))])


def _as_rows(totals: DataFrame, n_in: int) -> DataFrame:
    return totals.select("key", "sub", F.lit(None).cast("long").alias("order"), *[F.lit(None).cast("double").alias(f"value_{i}") for i in range(n_in)], "carry")


def affine(a: np.ndarray, b: np.ndarray) -> Element:
    """x becomes a · x + b."""
    return a, b


def then_affine(e: Element, f: Element) -> Element:
    return e[0] * f[0], f[0] * e[1] + f[1]


def then_clamped(e: Element, f: Element) -> Element:
    """x becomes x + a, but low at least and high at most, as (a, low, high); such steps are closed under composition."""
    within = lambda x: np.minimum(np.maximum(x + f[0], f[1]), f[2])
    return e[0] + f[0], within(e[1]), within(e[2])
