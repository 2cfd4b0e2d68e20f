"""The tracker over a stream of detections, with the live tracks of every stream as keyed state."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.operators.folds import ordered_stream
from percepta.operators.tracking import BOX, Live

OUT = "stream_id long, frame_id long, det_idx long, track_id long"


def _stepped(max_age: int, high: float | None, low: float):
    def apply(state: list, rows: list[tuple]) -> list[tuple]:
        live = Live(state[0], *(np.array(x, np.int64) for x in state[1:3]), np.array(state[3], float).reshape(-1, 4))
        out = []
        for frame, part in groupby(rows, key=lambda r: r[0]):
            found = list(part)
            boxes, scores = np.array([r[2:6] for r in found], float), np.array([1.0 if r[6] is None else r[6] for r in found], float)
            ids = live.step(frame, boxes, scores, max_age, high, low).tolist()
            out += [(frame, int(r[1]), i) for r, i in zip(found, ids, strict=True) if i]
        state[:] = live.next_id, live.ids.tolist(), live.seen.tolist(), live.boxes.tolist()
        return out

    return apply


def track_stream(detections: DataFrame, max_age: int = 30, high: float | None = None, low: float = 0.1, reset: str | None = None, time: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """identified() over a streaming DataFrame, in append mode.

    A frame must come whole within one batch, or share one `time`; rows of frames that aren't later than the stream's last one are left out. reset (a boolean
    column; its row needs no box), time and expire_ms are those of ordered_stream(): after a reset ids begin at 1 again.
    The state holds a stream's live tracks and grows with them only.
    """
    box = F.lit(True)
    for c in BOX:
        box = box & F.col(c).isNotNull()
    kept = detections.filter(box | F.coalesce(F.col(reset), F.lit(False)) if reset else box)
    values = [F.col("det_idx").cast("long"), *[F.col(c).cast("double") for c in BOX], F.col("confidence").cast("double")]
    rows = kept.withColumn("stream_id", F.col("stream_id").cast("long"))
    return ordered_stream(rows, "stream_id", F.col("frame_id"), values, [1, [], [], []], _stepped(max_age, high, low), T.StructType.fromDDL(OUT), reset, time, expire_ms)
