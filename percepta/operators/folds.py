"""Ordered folds: a step function runs over each key's rows in order, in one pass and with one state in memory.

Over a table, Spark deals the keys, sorts each partition and streams it; a key's history is never held as an array, so a pass is
linear in its rows and a key may have any number of them. Over a stream, the state is kept between batches, late rows may wait in it for
their turn, and it ends with a reset or when its key stays silent. Linear folds over tables are in scans.py.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from copy import deepcopy
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fold(NamedTuple):
    """start: the state of a key before its first row, a list that JSON can hold. step(state, *values) changes it and gives the row's output."""

    start: list
    step: Callable[..., tuple]


def _run(fold: Fold, n_in: int, schema: T.StructType, resets: bool):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
        at, state = None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            orders = batch.column(1).to_pylist()
            out = []
            ended = batch.column(2 + n_in).to_pylist() if resets else [False] * len(keys)
            for key, end, *values in zip(keys, ended, *(batch.column(2 + k).to_pylist() for k in range(n_in)), strict=True):
                if state is None or key != at:
                    at, state = key, deepcopy(fold.start)
                if end:
                    state = None
                else:
                    out.append(fold.step(state, *values))
            if resets:
                keys, orders = ([v for v, end in zip(x, ended, strict=True) if not end] for x in (keys, orders))
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(fields) - 2)
            arrays = [pa.array(keys, fields[0][1]), pa.array(orders, fields[1][1]), *(pa.array(c, t) for c, (_, t) in zip(columns, fields[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    return run


def _run_on(start: list, apply: Callable[[list, list[tuple]], list[tuple]], names: list[str], timed: bool, expire_ms: int | None):
    """A key's rows (order, ended, time, values…) of one batch of a stream, from the state after its batch before.

    The state is the last order, the fold's state, the rows that wait for the watermark, and the newest time.
    """

    def run(key: tuple, frames: Iterable, held) -> Iterator:
        import pandas as pd

        last, state, waiting, newest = json.loads(held.get[0]) if held.exists else (None, None, [], None)
        for frame in frames:
            for row in frame.iloc[:, 1:].itertuples(index=False, name=None):
                order, ended, time, *values = (None if pd.isna(v) else v for v in row)
                if last is None or order > last:
                    waiting.append([int(order), bool(ended), time, *(values[:-1] if timed else values)])
                    newest = time if newest is None or time is None else max(newest, time)
        mark = held.getCurrentWatermarkMs() if timed else None
        ready = [r for r in waiting if not timed or r[2] <= mark]
        waiting = [r for r in waiting if timed and r[2] > mark]
        silent = not waiting and (held.hasTimedOut and not ready or timed and expire_ms is not None and newest is not None and newest + expire_ms <= mark)
        ready.sort(key=lambda r: (r[0], not r[1], [(v is not None, v) for v in r[3:]]))
        out, part = [], []
        for r in [*ready, None]:
            if part and (r is None or r[1]):
                state = deepcopy(start) if state is None else state
                out += apply(state, part)
                part = []
            if r is not None and r[1]:
                state = None
            elif r is not None:
                part.append((r[0], *r[3:]))
        if ready:
            last = ready[-1][0]
        if silent or (state is None and not waiting):
            if held.exists:
                held.remove()
        else:
            held.update((json.dumps([last, state, waiting, newest]),))
            if timed and waiting:
                held.setTimeoutTimestamp(min(r[2] for r in waiting))
            elif timed and expire_ms is not None:
                held.setTimeoutTimestamp(newest + expire_ms)
            elif expire_ms is not None:
                held.setTimeoutDuration(expire_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=names)

    return run


def ordered_stream(df: DataFrame, key: str, order: Column, values: list[Column], start: list, apply: Callable[[list, list[tuple]], list[tuple]], schema: T.StructType, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """What apply(state, rows) gives for each key's rows (order, values…) of a stream, in order, with the state kept between batches.

    Without `time` each batch is sorted by itself, and rows whose order isn't later than the last one of the key's batches before are left out.
    With `time`, the stream's watermark column, rows wait in the state until the watermark has passed them and are then taken in order, so any
    rows that come within the watermark's delay find their place, in whatever batch; order must grow with time. The state then holds a
    key's rows of one delay.

    A row whose boolean column `reset` is true ends its key: its state is removed, and what comes later begins anew; it gives no row itself and is taken
    before others of its order. expire_ms: a key that is silent for so long (by the watermark with `time`, else by the clock) is
    removed. So the state store holds only keys that live.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ended = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    stamp = F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(None).cast("bigint")
    rows = df.select(F.col(key), order.cast("long").alias("order_"), ended.alias("ended_"), stamp.alias("ms_"), *[v.alias(f"value_{i}") for i, v in enumerate(values)], *([F.col(time).alias("time_")] if time else []))
    rows = rows.dropna(subset=[key, "order_", *(["ms_"] if time else [])])
    kind = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    # The watermark column itself must reach the operator, as the last one, though only its milliseconds are read.
    return rows.groupBy(key).applyInPandasWithState(_run_on(start, apply, schema.names, bool(time), expire_ms), schema, "state string", "append", kind)


def folded(df: DataFrame, key: str, order: str | Column, values: list[Column], fold: Fold, out: str, down: bool = False, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """key, order and the columns of `out` (a schema string) for every row of df, made by the fold's step from `values`, in order.

    Rows whose key or order is null are left out. down: from the last row to the first. reset: a boolean column; a row in which it is true puts
    its key back to the start and gives no row.
    df may be a stream (append mode), as ordered_stream() says, with `time` for late rows and expire_ms for keys that end; NaN counts as null, and
    down is an error, as a stream has no last row. A task holds a key's rows of one batch.
    """
    name = order if isinstance(order, str) else "order"
    at = F.col(order) if isinstance(order, str) else order
    if df.isStreaming:
        if down:
            raise ValueError("a stream has no last row to begin at")
        kinds = df.select(F.col(key), at.cast("long").alias(name)).schema
        schema = T.StructType([*kinds.fields, *T.StructType.fromDDL(out).fields])
        return ordered_stream(df, key, at, values, fold.start, lambda state, rows: [(r[0], *fold.step(state, *r[1:])) for r in rows], schema, reset, time, expire_ms)
    ended = [F.coalesce(F.col(reset), F.lit(False)).alias("ended")] if reset else []
    rows = df.select(F.col(key), at.cast("long").alias(name), *[v.alias(f"value_{i}") for i, v in enumerate(values)], *ended).dropna(subset=[key, name])
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(out).fields])
    first = [F.col("ended").desc()] if reset else []
    rows = rows.repartition(key).sortWithinPartitions(key, F.col(name).desc() if down else F.col(name), *first, *[f"value_{i}" for i in range(len(values))])
    return rows.mapInArrow(_run(fold, len(values), schema, bool(reset)), schema)
