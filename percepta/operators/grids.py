"""Occupancy grids as sparse tables of cells (key, gx, gy, value); a cell that isn't there has the value 0.

Coordinates are cut toward 0, so the strip before the origin falls into cell 0; rays start in the cell below them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators.boxes import corners
from percepta.operators.motion import norm


@dataclass(frozen=True)
class Grid:
    """Columns and rows of cells of `resolution` metres; the origin is the lower left corner, half the size below 0 by default."""

    size: float = 50.0
    resolution: float = 0.7
    ox: float | None = None
    oy: float | None = None
    key: str = "cloud_id"

    @property
    def n(self) -> int:
        return int(self.size / self.resolution)

    @property
    def origin(self) -> tuple[float, float]:
        return (-self.size / 2 if self.ox is None else self.ox, -self.size / 2 if self.oy is None else self.oy)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        return tuple(((c - o) / self.resolution).cast("int") for c, o in zip((x, y), self.origin, strict=True))

    def inside(self, gx: str = "gx", gy: str = "gy") -> Column:
        return F.col(gx).between(0, self.n - 1) & F.col(gy).between(0, self.n - 1)


def _placed(points: DataFrame, grid: Grid) -> DataFrame:
    gx, gy = grid.cell(F.col("x"), F.col("y"))
    return points.withColumns({"gx": gx, "gy": gy}).filter(grid.inside())


def marked(cells: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """cells with points(key, x, y, value) set: the larger value stays; points outside the grid are left out."""
    own = _placed(points, grid).select(grid.key, "gx", "gy", "value")
    return merged(cells, own, grid)


def cleared(cells: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """cells without those of points(key, x, y)."""
    return cells.join(_placed(points, grid).select(grid.key, "gx", "gy"), [grid.key, "gx", "gy"], "left_anti")


def looked_up(cells: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """points(key, x, y, …) with the value of their cell; 0 where there is none, also outside the grid."""
    gx, gy = grid.cell(F.col("x"), F.col("y"))
    at = points.withColumns({"gx": gx, "gy": gy}).join(cells, [grid.key, "gx", "gy"], "left")
    return at.withColumn("value", F.coalesce(F.when(grid.inside(), F.col("value")), F.lit(0.0))).drop("gx", "gy")


def above(cells: DataFrame, grid: Grid, threshold: float = 0.5) -> DataFrame:
    """The corners wx, wy of cells whose value exceeds the threshold."""
    ox, oy = grid.origin
    return cells.filter(F.col("value") > threshold).select(grid.key, (F.col("gx") * grid.resolution + ox).alias("wx"), (F.col("gy") * grid.resolution + oy).alias("wy"))


def merged(one: DataFrame, other: DataFrame, grid: Grid) -> DataFrame:
    """The larger value of each cell."""
    return one.unionByName(other).groupBy(grid.key, "gx", "gy").agg(F.max("value").alias("value"))


def of_boxes(boxes: DataFrame, grid: Grid, least: float, most: float) -> DataFrame:
    """Cells of boxes(key, box_id, …): of their corners between two heights, and of their centres at any height."""
    ends = corners(boxes.withColumn("b", F.struct(grid.key, "box_id")), "b").filter(F.col("z").between(least, most)).select(F.col(f"b.{grid.key}").alias(grid.key), "x", "y")
    middles = boxes.select(grid.key, F.col("cx").alias("x"), F.col("cy").alias("y"))
    return _placed(ends.unionByName(middles), grid).select(grid.key, "gx", "gy").distinct().withColumn("value", F.lit(1.0))


def of_costmap(costs: DataFrame, grid: Grid, threshold: float = 0.5) -> DataFrame:
    """Cells of the grid whose nearest cell of costs(key, y, x, cost), scaled to the grid, exceeds the threshold.

    A cost cell is found for each grid cell by its index; each occupied cost cell makes the few grid cells that fall on it.
    """
    size = costs.groupBy(grid.key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    hot = costs.filter(F.col("cost") > threshold).join(size, grid.key)

    # Cell i falls on int(i · h / n), capped at the last row: the cells from y · n / h upward, up to the next row's.
    def falling(c: str, most: str) -> Column:
        share = F.col(most) / F.lit(float(grid.n))
        near = F.sequence(F.floor(F.col(c) / share).cast("int") - 1, F.ceil((F.col(c) + 1) / share).cast("int"))
        return F.filter(near, lambda i: (i >= 0) & (i < grid.n) & (F.least((i * share).cast("int"), F.col(most) - 1) == F.col(c)))

    hot = hot.withColumn("gy", F.explode(falling("y", "h"))).withColumn("gx", F.explode(falling("x", "w")))
    return hot.select(grid.key, "gx", "gy", F.lit(1.0).alias("value"))


#: Cells a side of a block that one step of a stencil holds.
BLOCK = 128


def _blocks(cells: DataFrame, key: str, n: int, off: range, back: bool, made: Callable) -> DataFrame:
    """key, gx, gy, value that `made` gives for blocks of the grid: cells cross once, and also to a block whose edge is within reach.

    made(present, known, value, x0, y0): arrays of a block with its border, and where the block begins; the block's present, known, value.
    """
    side, low, high = min(BLOCK, n), -off[0], off[-1]
    if back:
        low, high = high, low
    # A cell reaches the cells from `-low` to `high` around it, so a block needs `high` cells before and `low` after it.
    block = lambda c: F.sequence(F.floor((F.col(c) - low) / side), F.floor((F.col(c) + high) / side))
    dealt = cells.select(key, "gx", "gy", F.col("value").cast("double").alias("value"), F.explode(block("gx")).alias("bx")).withColumn("by", F.explode(block("gy")))
    last = (n - 1) // side
    dealt = dealt.filter(F.col("bx").between(0, last) & F.col("by").between(0, last)).repartition(key, "bx", "by").sortWithinPartitions(key, "bx", "by")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def stepped(rows):
            """Output of whole blocks."""
            code = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            gx, gy, bx, by = (rows.column(i).to_numpy() for i in (1, 2, 4, 5))
            known = rows.column(3).is_valid().to_numpy(zero_copy_only=False)
            value = rows.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(bx) != 0) | (np.diff(by) != 0)) + 1
            at, xs, ys, vs, ks = [], [], [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(code)], strict=True):
                x0, y0, wide = int(bx[lo]) * side, int(by[lo]) * side, side + low + high
                x, y = gx[lo:hi] - x0 + high, gy[lo:hi] - y0 + high
                present, valid, held = (np.zeros((wide, wide), t) for t in (bool, bool, float))
                present[x, y], valid[x, y], held[x, y] = True, known[lo:hi], value[lo:hi]
                present, valid, held = made(present, valid, held, x0, y0)
                x, y = np.nonzero(present[: n - x0, : n - y0])
                at.append(np.full(len(x), lo))
                xs.append(x + x0)
                ys.append(y + y0)
                vs.append(held[x, y])
                ks.append(valid[x, y])
            keys = rows.column(0).take(pa.array(np.concatenate(at)))
            ints = [pa.array(np.concatenate(c), rows.column(i).type) for i, c in ((1, xs), (2, ys))]
            return pa.RecordBatch.from_arrays([keys, *ints, pa.array(np.concatenate(vs), mask=~np.concatenate(ks))], names=[key, "gx", "gy", "value"])

        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            ends = [rows.column(i) for i in (0, 4, 5)]
            cut, last = rows.num_rows - 1, tuple(c[-1] for c in ends)
            while cut and tuple(c[cut - 1] for c in ends) == last:
                cut -= 1
            held = rows.slice(cut)
            if cut:
                yield stepped(rows.slice(0, cut))
        if held is not None:
            yield stepped(held)

    return dealt.mapInArrow(run, f"`{key}` {kinds[key]}, gx {kinds['gx']}, gy {kinds['gy']}, value double")


def dilated(cells: DataFrame, grid: Grid, k: int = 3) -> DataFrame:
    """The largest value within −k // 2 … k // 2 cells, which for k = 3 reaches two back and one ahead."""
    off = range(-k // 2, k // 2 + 1)

    def largest(present, known, value, *_):
        value = np.where(known, value, -np.inf)
        # A block's cell i stands at i + off[-1] of the border and takes the values of the cells i − o.
        for axis in (0, 1):
            size = present.shape[axis] - len(off) + 1
            parts = [tuple(np.take(m, range(i, i + size), axis) for m in (present, known, value)) for i in range(len(off))]
            present, known, value = reduce(lambda a, b: (a[0] | b[0], a[1] | b[1], np.maximum(a[2], b[2])), parts)
        return present, known, value

    return _blocks(cells, grid.key, grid.n, off, False, largest)


def eroded(cells: DataFrame, grid: Grid, k: int = 3) -> DataFrame:
    """The least value within the same reach, 1 at most; cells outside the grid don't count, missing ones are 0 and go."""
    off, n = range(-k // 2, k // 2 + 1), grid.n

    def least(present, known, value, x0, y0):
        x, y = (np.arange(len(present)) + c + off[0] for c in (x0, y0))
        beyond = ((x < 0) | (x >= n))[:, None] | ((y < 0) | (y >= n))[None, :]
        present, known, value = present | beyond, known & ~beyond, np.where(known & ~beyond, value, np.inf)
        for axis in (0, 1):
            size = present.shape[axis] - len(off) + 1
            parts = [tuple(np.take(m, range(i, i + size), axis) for m in (present, known, value)) for i in range(len(off))]
            present, known, value = reduce(lambda a, b: (a[0] & b[0], a[1] | b[1], np.fmin(a[2], b[2])), parts)
        return present & known & (value > 0), known, np.minimum(value, 1.0)

    return _blocks(cells.filter(grid.inside()), grid.key, n, off, True, least)


def rays_hit(rays: DataFrame, cells: DataFrame, grid: Grid, threshold: float = 0.5, max_range: float | None = None) -> DataFrame:
    """rays(key, ray_id, x, y, rx, ry, …) with distance, hx, hy of the first cell above the threshold; null if there is none in range.

    A ray's cells come from where it crosses the lines of the grid: crossings in x and in y are sequences, ordered by distance (y first
    at a tie), and running sums of their steps are the cells. These meet the occupied cells in an equi-join; the least distance wins.
    A ray that starts in an occupied cell hits at 0; one without a direction, or that starts outside the grid, hits nothing.
    """
    n, res, (ox, oy) = grid.n, grid.resolution, grid.origin
    reach = float(n * res * 2**0.5) if max_range is None else float(max_range)
    length = norm(F.col("rx"), F.col("ry"))
    r = rays.select(grid.key, "ray_id", F.floor((F.col("x") - ox) / res).cast("int").alias("sx"), F.floor((F.col("y") - oy) / res).cast("int").alias("sy"), "x", "y", F.try_divide("rx", length).alias("ux"), F.try_divide("ry", length).alias("uy"))
    r = r.filter((length > 0) & F.col("sx").between(0, n - 1) & F.col("sy").between(0, n - 1))

    def crossings(p: str, start: str, u: str, o: float, tie: int) -> Column:
        ahead = F.col(u) > 0
        lines = F.when(ahead, F.sequence(F.col(start) + 1, F.lit(n))).when(F.col(u) < 0, F.sequence(F.col(start), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        event = lambda line: F.struct(F.try_divide(line * res + o - F.col(p), F.col(u)).alias("t"), F.lit(tie).alias("tie"), F.when(F.lit(tie == 1), F.signum(u)).otherwise(0.0).cast("int").alias("mx"), F.when(F.lit(tie == 0), F.signum(u)).otherwise(0.0).cast("int").alias("my"))
        return F.transform(lines, event)

    start = F.array(F.struct(F.lit(-1.0).alias("t"), F.lit(0).alias("tie"), F.lit(0).alias("mx"), F.lit(0).alias("my")))
    events = r.select(grid.key, "ray_id", "sx", "sy", F.explode(F.concat(start, crossings("x", "sx", "ux", ox, 1), crossings("y", "sy", "uy", oy, 0))).alias("e"))
    along = Window.partitionBy(grid.key, "ray_id").orderBy("e.t", "e.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = events.select(grid.key, "ray_id", F.greatest(F.col("e.t"), F.lit(0.0)).alias("t"), (F.col("sx") + F.sum("e.mx").over(along)).alias("gx"), (F.col("sy") + F.sum("e.my").over(along)).alias("gy"))
    # Steps only lead away from the start, so once outside the grid a ray never comes back.
    hit = passed.filter(F.col("t") <= reach).join(cells.filter(F.col("value") > threshold), [grid.key, "gx", "gy"]).groupBy(grid.key, "ray_id").agg(F.min("t").alias("distance"))
    out = rays.join(hit, [grid.key, "ray_id"], "left")
    return out.withColumns({"hx": F.col("x") + F.try_divide("rx", length) * F.col("distance"), "hy": F.col("y") + F.try_divide("ry", length) * F.col("distance")})


def in_sight(segments: DataFrame, cells: DataFrame, grid: Grid, threshold: float = 0.5) -> DataFrame:
    """segments(key, ray_id, x, y, tx, ty) with visible: no cell above the threshold up to the target, its own cell included."""
    rays = segments.withColumns({"rx": F.col("tx") - F.col("x"), "ry": F.col("ty") - F.col("y")})
    hit = rays_hit(rays, cells, grid, threshold).withColumn("length", norm(F.col("rx"), F.col("ry")))
    return hit.withColumn("visible", (F.col("length") == 0) | F.col("distance").isNull() | (F.col("distance") > F.col("length"))).select(*segments.columns, "visible")
