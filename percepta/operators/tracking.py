"""Trackers: a small ordered step gives ids to detections, windows derive all else.

Association reads only a track's last box, never its filter. So Python holds the live tracks of one stream at a time and gives
ids; hits, misses, confirmation and the Kalman states follow from the id column on the JVM side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.operators.kalman import filter_tracks
from percepta.shared import connected_components, large, lookup_join, written

BOX = ["x1", "y1", "x2", "y2"]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of the shorter side, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    owner = np.full(m, -1)
    row_price, col_price = np.zeros(n), np.zeros(m)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        tree, col, at, length = [row], -1, row, 0.0
        while True:
            ahead = length + cost[at] - row_price[at] - col_price
            better = ~done & (ahead < reach)
            reach[better], via[better] = ahead[better], at
            col = int(np.where(done, np.inf, reach).argmin())
            length = float(reach[col])
            done[col] = True
            if owner[col] < 0:
                break
            at = int(owner[col])
            tree.append(at)
        settled = done & (reach < length)
        for r in tree:
            held = np.flatnonzero(owner == r)
            row_price[r] += length - (float(reach[held[0]]) if len(held) else 0.0)
        col_price[settled] += reach[settled] - length
        while col >= 0:
            r = int(via[col])
            was = np.flatnonzero(owner == r)
            owner[col] = r
            col = int(was[0]) if len(was) else -1
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def _compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU and centre distance · (1 − IoU) of boxes side by side."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda r: (r[..., 2] - r[..., 0]) * (r[..., 3] - r[..., 1])
    either = area(a) + area(b) - both
    iou = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
    gap = (a[..., :2] + a[..., 2:] - b[..., :2] - b[..., 2:]) / 2
    return iou, np.sqrt((gap**2).sum(-1)) * (1 - iou)


def costs(tracks: np.ndarray, detections: np.ndarray, gate: float = 0.3, most: float = 100.0) -> np.ndarray:
    """Centre distance · (1 − IoU) where the IoU exceeds gate, most elsewhere."""
    iou, cost = _compared(tracks[:, None, :], detections[None, :, :])
    return np.where(iou > gate, cost, most)


def _near(tracks: np.ndarray, detections: np.ndarray, gate: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that can overlap by more than gate, in parts of about a million; a pair may come twice.

    Such boxes differ in size by a factor 1 / gate at most, so they meet in neighbouring cells of a grid as wide as the larger one's level, a power of two.
    """
    sides, reach = [], np.inf if gate == 0 else np.ceil(np.log2(1 / gate))
    for box in (tracks, detections):
        size = np.maximum(box[:, 2] - box[:, 0], box[:, 3] - box[:, 1])
        kept = np.flatnonzero(np.isfinite(box).all(1) & (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1]) & np.isfinite(size))
        sides.append((kept, (box[kept, :2] + box[kept, 2:]) / 2, np.ceil(np.log2(size[kept]))))
    (ti, tc, tl), (di, dc, dl) = sides
    for at in np.unique(tl):
        for other in np.unique(dl[np.abs(dl - at) <= reach]):
            own, there, width = tl == at, dl == other, 2.0 ** max(at, other)
            t, cells, d, held = ti[own], np.floor(tc[own] / width), di[there], np.floor(dc[there] / width)
            (ux, ix), (uy, iy) = (np.unique(c, return_inverse=True) for c in held.T)
            code = ix * len(uy) + iy
            order = np.argsort(code, kind="stable")
            d, code = d[order], code[order]
            for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                x, y = cells[:, 0] + i, cells[:, 1] + j
                px, py = np.minimum(np.searchsorted(ux, x), len(ux) - 1), np.minimum(np.searchsorted(uy, y), len(uy) - 1)
                hit = np.flatnonzero((ux[px] == x) & (uy[py] == y))
                at_code = px[hit] * len(uy) + py[hit]
                lo = np.searchsorted(code, at_code)
                n = np.searchsorted(code, at_code, "right") - lo
                for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1):
                    m = n[part]
                    within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    yield np.repeat(t[hit[part]], m), d[np.repeat(lo[part], m) + within]


def gated(tracks: np.ndarray, detections: np.ndarray, gate: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """track, detection and cost of all pairs whose IoU exceeds gate (0 at least), in order."""
    if len(tracks) * len(detections) <= 4096:
        iou, cost = _compared(tracks[:, None, :], detections[None, :, :])
        t, d = np.nonzero(iou > gate)
        return t, d, cost[t, d]
    found = []
    for t, d in _near(tracks, detections, gate):
        iou, cost = _compared(tracks[t], detections[d])
        found.append((t[iou > gate] * len(detections) + d[iou > gate], cost[iou > gate]))
    code, first = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, int)]), return_index=True)
    cost = np.concatenate([c for _, c in found] or [np.zeros(0)])[first]
    return code // len(detections), code % len(detections), cost


def assign_pairs(t: np.ndarray, d: np.ndarray, cost: np.ndarray, most: float) -> np.ndarray:
    """Which of the pairs (t, d), all cheaper than most, are in the least-cost assignment where staying alone costs a t `most`.

    Shortest augmenting paths, one t after the other; a path ends at a free d or where a t is better left alone, so it looks no farther than it must.
    """
    from heapq import heappop, heappush

    if not len(t):
        return np.zeros(0, int)
    lone = (np.bincount(t)[t] == 1) & (np.bincount(d)[d] == 1)
    ways: dict[int, list[tuple[int, float, int]]] = {}
    for k in np.flatnonzero(~lone).tolist():
        ways.setdefault(int(t[k]), []).append((int(d[k]), float(cost[k]), k))
    owner: dict[int, tuple[int, int]] = {}  # of a d its t and their pair
    row_price: dict[int, float] = dict.fromkeys(ways, 0.0)
    col_price: dict[int, float] = {}
    for row in ways:
        reach: dict[int, float] = {}
        via: dict[int, tuple[int, int]] = {}  # of a d the t before it and their pair
        done: dict[int, float] = {}
        into: dict[int, int] = {}  # of a t in the tree the d that it owns
        heap, at, length = [], row, 0.0
        alone, last = np.inf, row
        while True:
            base = length - row_price[at]
            if base + most < alone:
                alone, last = base + most, at
            for col, c, k in ways[at]:
                ahead = base + c - col_price.get(col, 0.0)
                if col not in done and ahead < reach.get(col, np.inf):
                    reach[col], via[col] = ahead, (at, k)
                    heappush(heap, (ahead, col))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] > alone:
                length, end = alone, into.get(last)
                break
            length, end = heappop(heap)
            if end not in owner:
                break
            done[end] = length
            at = owner[end][0]
            into[at] = end
        for r in (row, *into):
            row_price[r] += length - (done[into[r]] if r in into else 0.0)
        for col, far in done.items():
            col_price[col] = col_price.get(col, 0.0) + far - length
        while end is not None:
            r, _ = owner[end] = via[end]
            end = into.get(r)
    return np.sort(np.concatenate([np.flatnonzero(lone), np.array([k for _, k in owner.values()], int)]))


def _pairable(rows: int, cols: int, t: np.ndarray, d: np.ndarray) -> bool:
    """Whether the shorter side can surely be paired without the pairs (t, d): Hall's condition by the most pairs of one of either side."""
    if not len(t):
        return True
    a, b = np.bincount(t).max(), np.bincount(d).max()
    if rows > cols:
        rows, cols, a, b = cols, rows, b, a
    return cols - a >= min(rows, b)


def matched(tracks: np.ndarray, detections: np.ndarray, gate: float = 0.3, most: float = 100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """track, detection and cost of the pairs of the least-cost assignment of costs() that cost less than most.

    Only gated pairs are formed, as all others cost the same. The matrix is made only where leftovers would have to take a pair dearer than that.
    """
    if gate >= 0:
        t, d, cost = gated(tracks, detections, gate)
        below = cost < most
        met = np.flatnonzero(below)[assign_pairs(t[below], d[below], cost[below], most)]
        free_t, free_d = np.ones(len(tracks), bool), np.ones(len(detections), bool)
        free_t[t[met]], free_d[d[met]] = False, False
        dear = (cost > most) & free_t[t] & free_d[d]
        if _pairable(free_t.sum(), free_d.sum(), t[dear], d[dear]):
            return t[met], d[met], cost[met]
    c = costs(tracks, detections, gate, most)
    t, d = np.array([p for p in assign(c) if c[p] < most], int).reshape(-1, 2).T
    return t, d, c[t, d]


def matches(tracks: np.ndarray, detections: np.ndarray, gate: float = 0.3, most: float = 100.0) -> list[tuple[int, int]]:
    """Pairs (track, detection) of the least-cost assignment that cost less than most."""
    if not len(tracks) or not len(detections):
        return []
    t, d, _ = matched(tracks, detections, gate, most)
    return list(zip(t.tolist(), d.tolist(), strict=True))


@dataclass
class Live:
    """The live tracks of a stream in the order of their births."""

    next_id: int = 1
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, max_age: int, high: float | None, low: float) -> np.ndarray:
        """Ids of a frame's detections, 0 for none. With high, those of `low` or more meet the tracks that the higher ones left, and give no birth."""
        live = frame - self.seen <= max_age
        if not live.all():
            self.ids, self.seen, self.boxes = self.ids[live], self.seen[live], self.boxes[live]
        out = np.zeros(len(boxes), np.int64)
        parts = [np.arange(len(boxes))] if high is None else [np.flatnonzero(scores >= high), np.flatnonzero((low <= scores) & (scores < high))]
        free = np.arange(len(self.ids))
        for part in parts:
            if len(free) and len(part):
                t, d, _ = matched(self.boxes[free], boxes[part])
                k, i = free[t], part[d]
                out[i], self.seen[k], self.boxes[k] = self.ids[k], frame, boxes[i]
                free = np.delete(free, t)
        new = parts[0][out[parts[0]] == 0]
        if len(new):
            out[new] = self.next_id + np.arange(len(new))
            self.ids, self.seen, self.boxes = np.append(self.ids, out[new]), np.append(self.seen, np.full(len(new), frame)), np.concatenate([self.boxes, boxes[new]])
            self.next_id += len(new)
        return out


def _identified(max_age: int, high: float | None, low: float):
    """Over sorted rows (group, stream, frame, det, box, score, ended, …): group, stream, frame, det and track of those that have one, and the columns after ended."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        at, live, held = None, Live(), []  # held: the parts of the frame `at`, each with its rows of a batch

        def settle():
            ids = live.step(at[2], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), max_age, high, low)
            for (_, scores, batch, rows), some in zip(held, np.split(ids, np.cumsum([len(h[1]) for h in held])[:-1]), strict=True):
                if made and made[-1][0] is batch:
                    made[-1][1].append(rows[some > 0])
                    made[-1][2].append(some[some > 0])
                else:
                    made.append((batch, [rows[some > 0]], [some[some > 0]]))

        def flushed():
            for batch, rows, ids in made:
                out = batch.take(pa.array(np.concatenate(rows)))
                names = ["group_id", "stream_id", "frame_id", "det_idx", "track_id", *out.schema.names[10:]]
                yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(np.concatenate(ids)), *out.columns[10:]], names=names)

        for batch in batches:
            made: list[tuple] = []
            if not len(batch):
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            boxes = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4, 8)], 1)
            scores, ended = (batch.column(k).to_numpy(zero_copy_only=False) for k in (8, 9))
            resets = ended.any()
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(k[lo]) for k in keys)
                if key != at:
                    if held:
                        settle()
                    if at and at[:2] != key[:2]:
                        live = Live()
                    at, held = key, []
                rows = np.arange(lo, hi)
                if resets and ended[lo:hi].any():
                    live, rows = Live(), rows[~ended[lo:hi]]
                if len(rows):
                    held.append((boxes[rows], scores[rows], batch, rows))
            yield from flushed()
        made = []
        if held:
            settle()
            yield from flushed()

    return run


def _iou(a: str, b: str) -> Column:
    """Overlap of two boxes whose columns are BOX and those names with a suffix."""
    c = lambda n, k: F.col(n + k)
    w, h = (F.greatest(F.least(c(f"{d}2", a), c(f"{d}2", b)) - F.greatest(c(f"{d}1", a), c(f"{d}1", b)), F.lit(0.0)) for d in "xy")
    area = lambda k: (c("x2", k) - c("x1", k)) * (c("y2", k) - c("y1", k))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def gate_components(rows: DataFrame, max_age: int, gate: float = 0.3) -> DataFrame:
    """rows(stream_id, frame_id, det_idx, box, …) with group_id: detections that no chain of gated pairs connects have different ones.

    A detection can only meet a track whose last box it overlaps by more than the gate, at most max_age frames later: such pairs are edges, their
    connected components never compete. Overlap above a gate needs sizes within a factor 1 / gate, so pairs meet in the cells of a grid as wide as
    the larger box, of levels by powers of two, and in buckets of frames; boxes of all sizes can be mixed.
    """
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    node = F.struct("stream_id", "frame_id", "det_idx")
    d = rows.select(node.alias("node"), *BOX, F.ceil(F.log2(size)).cast("int").alias("level"), F.floor(F.col("frame_id") / (max_age + 1)).alias("bucket")).filter(size > 0)
    deepest = int(np.ceil(np.log2(1 / gate)))
    at = lambda c: F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 2 / F.pow(F.lit(2.0), F.col("level"))).alias(f"c{c}")
    key = ["stream", "level", "cx", "cy", "bucket"]
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    wide = d.select(F.col("node.stream_id").alias("stream"), "*", at("x"), at("y"), F.explode(around).alias("o")).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "bucket": F.col("bucket") + F.col("o.k")}).drop("o")
    small = d.withColumn("own", F.col("level")).withColumn("level", F.explode(F.sequence("level", F.col("level") + deepest)))
    small = small.select(F.col("node.stream_id").alias("stream"), "level", at("x"), at("y"), "bucket", "own", F.col("node").alias("node_o"), *[F.col(c).alias(f"{c}_o") for c in BOX])
    gap = F.abs(F.col("node.frame_id") - F.col("node_o.frame_id"))
    pairs = large(wide).join(small, key).filter((F.col("own") < F.col("level")) | (F.col("node_o") < F.col("node"))).filter((gap > 0) & (gap <= max_age) & (_iou("", "_o") > gate))
    found = connected_components(pairs.select(F.col("node").alias("a"), F.col("node_o").alias("b")), "gate")
    out = large(rows.withColumn("node", node)).join(found, "node", "left")
    return out.withColumn("group_id", F.xxhash64(F.coalesce("component", "node"))).drop("node", "component")


def identified(detections: DataFrame, max_age: int = 30, high: float | None = None, low: float = 0.1, reset: str | None = None, components: bool = False, keep: list[str] | None = None) -> DataFrame:
    """stream_id, frame_id, det_idx, track_id of the detections that belong to a track; ids count births within a stream.

    Frames of a stream come in order; frame ids without rows are frames without detections. A track ends after max_age
    frames without a match. high: detections below it are matched second and found no track (two-stage tracking). Rows whose stream,
    frame or box is null are left out; a null confidence is 1. Streams are sorted runs of a partition, never held whole.

    reset: a boolean column; a row in which it is true ends all tracks of its stream before its frame, needs no box, has no row, and ids begin at 1
    again. components: each component of the gate (see gate_components) is a run of its own, so that a long stream isn't one task; a frame's
    least-cost assignment is that of its components, and births are numbered over the stream afterwards, so ids are the same, but where
    assignments of equal cost tie. Not together with reset. keep: columns of detections that come along, after the others.
    """
    if reset and components:
        raise ValueError("components of the gate don't end with a reset")
    ended = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    d = detections.select(*[F.col(c).cast("long").alias(c) for c in ("stream_id", "frame_id", "det_idx")], *[F.col(c).cast("double").alias(c) for c in BOX], F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("score"), ended.alias("ended"), *([F.struct(*keep).alias("kept")] if keep else []))
    there = F.col("ended")
    d = d.dropna(subset=["stream_id", "frame_id"]).filter(there | ~F.array_contains(F.array(*[F.col(c).isNull() for c in BOX]), True))
    d = gate_components(d, max_age) if components else d.withColumn("group_id", F.col("stream_id"))
    d = d.select("group_id", "stream_id", "frame_id", "det_idx", *BOX, "score", "ended", *(["kept"] if keep else []))
    d = d.repartition("group_id").sortWithinPartitions("group_id", "stream_id", "frame_id", F.col("ended").desc(), "det_idx")
    schema = T.StructType.fromDDL("group_id long, stream_id long, frame_id long, det_idx long, track_id long")
    out = d.mapInArrow(_identified(max_age, high, low), T.StructType([*schema.fields, *([d.schema["kept"]] if keep else [])]))
    names = ["stream_id", "frame_id", "det_idx", "track_id", *[f"kept.{c}" for c in keep or []]]
    if not components:
        return out.select(names)
    out = written(out, "identified")
    births = out.groupBy("group_id", "stream_id", "track_id").agg(F.min(F.struct("frame_id", "det_idx")).alias("born"))
    births = births.select("group_id", "stream_id", F.col("track_id").alias("nth"), F.row_number().over(Window.partitionBy("stream_id").orderBy("born")).cast("long").alias("track_id"))
    return large(out.withColumnRenamed("track_id", "nth")).join(births, ["group_id", "stream_id", "nth"]).select(names)


def histories(ids: DataFrame) -> DataFrame:
    """Adds hit_streak (2 at birth, never reset), misses (frames missed since the last match) and confirmed (3 hits) to identified rows."""
    w = Window.partitionBy("stream_id", "track_id").orderBy("frame_id")
    out = ids.withColumns({"hit_streak": F.row_number().over(w) + 1, "misses": F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) - 1, F.lit(0))})
    return out.withColumn("confirmed", F.col("hit_streak") >= 3)


def live_tracks(detections: DataFrame, max_age: int = 30, high: float | None = None, low: float = 0.1, ends: DataFrame | None = None) -> DataFrame:
    """track_states() without the Kalman states, which no other column needs."""
    extra = ["confidence", *(["class_id"] if "class_id" in detections.columns else [])]
    h = histories(identified(detections, max_age, high, low, keep=[*BOX, *extra])).drop("det_idx", "misses")
    w = Window.partitionBy("stream_id", "track_id").orderBy("frame_id")
    h = h.withColumn("until", F.least(F.lead("frame_id").over(w) - 1, F.col("frame_id") + max_age - 1))
    last = detections.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.max(F.col("frame_id").cast("long")).alias("last_frame")) if ends is None else ends
    h = lookup_join(h, written(last, "last-frames"), ["stream_id"], "inner", spread=[F.col("track_id")]).withColumn("until", F.least("until", "last_frame"))
    # An empty sequence can't be: a row's own frame is always live.
    h = h.withColumn("at", F.explode(F.sequence("frame_id", F.greatest("until", "frame_id")))).withColumn("misses", F.col("at") - F.col("frame_id"))
    return h.select("stream_id", "track_id", F.col("at").alias("frame_id"), "misses", "hit_streak", "confirmed", *BOX, *extra)


def track_states(detections: DataFrame, max_age: int = 30, high: float | None = None, low: float = 0.1, ends: DataFrame | None = None) -> DataFrame:
    """A row for every live track after every frame of its stream, also the frames that miss it.

    stream_id, track_id, frame_id, misses (frames since the last match), hit_streak (2 at birth, never reset; age is the same count),
    confirmed, the last matched box with its confidence and class, and the Kalman state: corrected where a detection matched, predicted
    where none did. A track is live while it has fewer than max_age misses. Frames of a stream run from its first to its last
    one, or to last_frame in ends(stream_id, last_frame).
    """
    live = live_tracks(detections, max_age, high, low, ends)
    kept = [c for c in live.columns if c != "frame_id"]
    seen = F.col("misses") == 0
    rows = live.select("*", F.struct("stream_id", "track_id").alias("key"), *[F.when(seen, (F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in "xy"])
    states = filter_tracks(rows, "key", "frame_id", keep=kept)
    return states.select("stream_id", "track_id", "frame_id", *kept[2:], "x", "y", "vx", "vy", "x_pp", "y_pp")


def confirmed_tracks(states: DataFrame) -> DataFrame:
    """The confirmed ones of live_tracks or track_states, occluded ones too."""
    return states.filter("confirmed")


def track_by_id(states: DataFrame, track_id: int) -> DataFrame:
    """One track's rows of every stream; none if there is no such track."""
    return states.filter(F.col("track_id") == track_id)


def box_around(x: Column, y: Column) -> list[Column]:
    """The box that stands for a track without any detection: 50 × 50 around its position."""
    return [c.alias(n) for c, n in zip((x - 25, y - 25, x + 25, y + 25), BOX, strict=True)]


def _associated(gate: float, most: float):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["stream_id", "frame_id", "track_id", "det_idx", "cost"]
        at, sides = None, ([], [])

        def settle():
            (ti, tb), (di, db) = (([r[0] for r in s], np.array([r[1] for r in s], float).reshape(-1, 4)) for s in sides)
            t, d, c = (x.tolist() for x in matched(tb, db, gate, most)) if len(ti) and len(di) else ([], [], [])
            out = [(*at, ti[i], di[j], v) for i, j, v in zip(t, d, c, strict=True)]
            t, d = set(t), set(d)
            out += [(*at, i, None, None) for k, i in enumerate(ti) if k not in t]
            return out + [(*at, None, j, None) for k, j in enumerate(di) if k not in d]

        def flushed(rows):
            kinds = [pa.int64()] * 4 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            made: list[tuple] = []
            for stream, frame, side, i, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (stream, frame) != at:
                    made += settle() if at else []
                    at, sides = (stream, frame), ([], [])
                sides[side].append((i, box))
            yield flushed(made)
        if at:
            yield flushed(settle())

    return run


def associated(tracks: DataFrame, detections: DataFrame, gate: float = 0.3, most: float = 100.0) -> DataFrame:
    """stream_id, frame_id, track_id, det_idx, cost of the least-cost assignment in every frame; unmatched tracks and detections have the other id null.

    tracks(stream_id, frame_id, track_id, box) and detections(stream_id, frame_id, det_idx, box). A frame's boxes are one run of a sorted
    partition; pairs below the IoU gate cost `most` and don't match. Rows without stream, frame or box are left out.
    """
    side = lambda d, n, i: d.select(*[F.col(c).cast("long").alias(c) for c in ("stream_id", "frame_id")], F.lit(n).alias("side"), F.col(i).cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in BOX])
    rows = side(tracks, 0, "track_id").unionByName(side(detections, 1, "det_idx")).dropna()
    rows = rows.repartition("stream_id", "frame_id").sortWithinPartitions("stream_id", "frame_id", "side", "i")
    return rows.mapInArrow(_associated(gate, most), "stream_id long, frame_id long, track_id long, det_idx long, cost double")


def statistics(tracked: DataFrame, max_age: int = 30) -> DataFrame:
    """For every stream after its last frame: live tracks, confirmed ones among them, the frame and the next id."""
    last = tracked.groupBy("stream_id", "track_id").agg(F.max("frame_id").alias("last"), F.bool_or("confirmed").alias("confirmed"))
    end = last.groupBy("stream_id").agg(F.max("last").alias("current_frame"), (F.max("track_id") + 1).alias("next_track_id"))
    live = last.join(end, "stream_id").withColumn("live", F.col("current_frame") - F.col("last") < max_age)
    return live.groupBy("stream_id", "current_frame", "next_track_id").agg(F.count_if("live").alias("total"), F.count_if(F.col("live") & F.col("confirmed")).alias("confirmed"))
