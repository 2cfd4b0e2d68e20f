"""Boxes, point clouds, occupancy grids and depth rasters as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators import grids
from percepta.operators.motion import norm
from percepta.shared import all_of, connected_components, freed, large, lookup_join, written


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given as x1, y1, x2, y2; 0 if they only touch or have no area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def centre_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return norm((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2)


def cost_rows(tracks: DataFrame, detections: DataFrame, on: list[str], cell: float = 100.0, max_distance: float = 100.0, gate: float = 0.3) -> DataFrame:
    """Pairs of a track's and a detection's box whose IoU exceeds gate, with cost distance · (1 − IoU); all others cost max_distance.

    Boxes meet in the cells that they cover, an equi-join; a pair counts in the first cell of its overlap.
    """

    def covered(d: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return d.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))

    box = ["x1", "y1", "x2", "y2"]
    t = covered(tracks.select(*on, F.col("track_id"), *[F.col(c) for c in box])).withColumnsRenamed({c: f"t_{c}" for c in box})
    d = covered(detections.select(*on, "det_idx", *box))
    both = t.join(d, [*on, "_cx", "_cy"])
    a, b = {c: F.col(f"t_{c}") for c in box}, {c: F.col(c) for c in box}
    first = (F.col("_cx") == F.floor(F.greatest("t_x1", "x1") / cell)) & (F.col("_cy") == F.floor(F.greatest("t_y1", "y1") / cell))
    out = both.filter(first).withColumns({"iou": iou(a, b), "distance": centre_distance(a, b)}).filter(F.col("iou") > gate)
    return out.select(*on, "track_id", "det_idx", "iou", (F.col("distance") * (1 - F.col("iou"))).alias("cost"))


def voxelize(points: DataFrame, size: float) -> DataFrame:
    cells = {f"v{c}": F.floor(F.col(c) / size) for c in "xyz"}
    return points.withColumns(cells).groupBy("cloud_id", *cells).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")], F.count("*").alias("n"))


def cloud_statistics(points: DataFrame) -> DataFrame:
    each = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return points.groupBy("cloud_id").agg(F.count("*").alias("n"), *each, F.max(norm(F.col("x"), F.col("y"), F.col("z"))).alias("max_range"))


def in_range(points: DataFrame, least: float, most: float) -> DataFrame:
    r = norm(F.col("x"), F.col("y"), F.col("z"))
    return points.filter((r >= least) & (r <= most))


def in_height(points: DataFrame, least: float, most: float) -> DataFrame:
    return points.filter(F.col("z").between(least, most))


def without_ground(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The points at the threshold's height or above; those without a height go."""
    return points.filter(F.col("z") >= threshold)


def sampled(points: DataFrame, n: int) -> DataFrame:
    """n points of every cloud (all where it has no more), in the order of a hash of their index."""
    order = Window.partitionBy("cloud_id").orderBy(F.md5(F.col("pt_idx").cast("string")), "pt_idx")
    return points.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def transformed(points: DataFrame, m: list[list[float]]) -> DataFrame:
    """Points under a 4×4 homogeneous transform."""
    out = {c: m[i][0] * F.col("x") + m[i][1] * F.col("y") + m[i][2] * F.col("z") + m[i][3] for i, c in enumerate("xyz")}
    return points.withColumns(out)


#: Offsets of the 27 cells around a cell, itself included.
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def near_pairs(points: DataFrame, eps: float, cell_rows: int = 2048, block_rows: int = 256) -> DataFrame:
    """cloud_id, a, b of all pairs of points, each once, at a distance above 0 and below eps: an equi-join on blocks of 8 × 8 × 8 cells of eps.

    A point stays in its own block and, where its cell is at the border, is copied to those blocks beyond it that come before its own; so pairs across
    blocks meet once, in the first of the two, and most points cross once a side. Blocks of more than block_rows points are joined cell by cell, and their cells of
    more than cell_rows points are dealt over shares of that many, to each of which the copies go, so neither is a task of its own.
    """
    block, key = ["bx", "by", "bz"], ["cloud_id", "fine", "gx", "gy", "gz"]
    # Read four times: the view's order of points is made once.
    at = written(points.select("cloud_id", F.col("pt_idx").alias("i"), "x", "y", "z").dropna(), "points")
    at = at.select("*", *[F.floor(F.col(c) / eps).alias(f"c{c}") for c in "xyz"])
    at = at.withColumns({f"b{c}": F.shiftright(f"c{c}", 3) for c in "xyz"})
    dense = at.groupBy("cloud_id", *block).agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    dense = written(dense.select("cloud_id", *block, F.lit(True).alias("fine")), "dense-blocks")
    cells = lookup_join(at, dense, ["cloud_id", *block], "inner", spread=[F.col("i")]).select("cloud_id", "fine", *[F.col(f"c{c}").alias(f"g{c}") for c in "xyz"])
    cells = written(cells.groupBy(key).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("shares")).filter("shares > 1"), "dense-cells")

    own = lookup_join(at, dense, ["cloud_id", *block], spread=[F.col("i")]).withColumn("fine", F.coalesce("fine", F.lit(False)))
    own = own.select("cloud_id", "fine", "i", "x", "y", "z", *[F.when(F.col("fine"), F.col(f"c{c}")).otherwise(F.col(f"b{c}")).alias(f"g{c}") for c in "xyz"])
    own = lookup_join(own, cells, key, spread=[F.col("i")])
    own = own.withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("i"), F.col("shares"))).otherwise(0).cast("int")).drop("shares")

    # Blocks in reach that come before a point's own in the order of x, y, z, and its own.
    there = at.select("cloud_id", F.col("i").alias("j"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[f"c{c}" for c in "xyz"], *[F.col(f"b{c}").alias(f"h{c}") for c in "xyz"])
    before = F.lit(False)
    for c in "xyz":
        first, beyond = F.shiftright(F.col(f"c{c}") - 1, 3), F.shiftright(F.col(f"c{c}") + 1, 3)
        there = there.withColumn(f"b{c}", F.explode(F.sequence(first, F.when(before, beyond).otherwise(F.col(f"h{c}")))))
        before = before | (F.col(f"b{c}") < F.col(f"h{c}"))
    there = lookup_join(there, dense, ["cloud_id", *block], spread=[F.col("j")])
    home = ~before
    target = lambda fine, places, same: F.struct(F.lit(fine).alias("fine"), *[v.alias(f"g{c}") for c, v in zip("xyz", places, strict=True)], same.alias("same"))
    each = [(o, [F.col(f"c{c}") + d for c, d in zip("xyz", o, strict=True)]) for o in AROUND]
    fine = [F.when(all_of([F.shiftright(v, 3) == F.col(f"b{c}") for c, v in zip("xyz", places, strict=True)]) & (~home | F.lit(o <= (0, 0, 0))), target(True, places, F.lit(o == (0, 0, 0)))) for o, places in each]
    there = there.withColumn("t", F.explode(F.when(F.col("fine"), F.array_compact(F.array(*fine))).otherwise(F.array(target(False, [F.col(c) for c in block], home)))))
    there = there.select("cloud_id", "j", "ox", "oy", "oz", "t.*")
    there = lookup_join(there, cells, key, spread=[F.col("j")])
    there = there.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
    d = norm(*[F.col(c) - F.col(f"o{c}") for c in "xyz"])
    both = large(own).join(there, [*key, "share"]).filter((~F.col("same") | (F.col("i") < F.col("j"))) & (d > 0) & (d < eps))
    return both.select("cloud_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def neighbours(points: DataFrame, eps: float) -> DataFrame:
    """cloud_id, a, b of all ordered pairs of near_pairs."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return near_pairs(points, eps).select("cloud_id", F.explode(both).alias("p")).select("cloud_id", "p.*")


def neighbour_counts(points: DataFrame, eps: float) -> DataFrame:
    """cloud_id, pt_idx, n of every point that has neighbours: pairs are counted at both ends and never doubled."""
    ends = near_pairs(points, eps).select("cloud_id", F.explode(F.array("a", "b")).alias("pt_idx"))
    return ends.groupBy("cloud_id", "pt_idx").agg(F.count("*").alias("n"))


def clusters(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """cloud_id, pt_idx, cluster (its least core index): cores have min_points other neighbours; a border point joins the first
    cluster that reaches it; clusters below min_points and noise go."""
    pairs = written(near_pairs(points, eps), "near-pairs")
    ends = pairs.select("cloud_id", F.explode(F.array("a", "b")).alias("i"))
    cores = written(ends.groupBy("cloud_id", "i").agg(F.count("*").alias("k")).filter(F.col("k") >= min_points).select("cloud_id", "i"), "cores")
    marked = large(pairs).join(cores.select("cloud_id", F.col("i").alias("a"), F.lit(True).alias("ca")), ["cloud_id", "a"], "left")
    marked = written(large(marked).join(cores.select("cloud_id", F.col("i").alias("b"), F.lit(True).alias("cb")), ["cloud_id", "b"], "left"), "marked-pairs")
    # A node is a struct of longs; the least one of a component has the least core index.
    node = lambda c: F.struct("cloud_id", F.col(c).alias("i"))
    parts = connected_components(marked.filter("ca and cb").select(node("a").alias("a"), node("b").alias("b")))
    labels = parts.select("node.cloud_id", F.col("node.i").alias("i"), F.col("component.i").alias("cluster"))
    labels = large(cores).join(labels, ["cloud_id", "i"], "left").withColumn("cluster", F.coalesce("cluster", "i"))
    ways = marked.filter("(ca is null) <> (cb is null)").select("cloud_id", F.when(F.col("ca"), F.col("a")).otherwise(F.col("b")).alias("i"), F.when(F.col("ca"), F.col("b")).otherwise(F.col("a")).alias("edge"))
    border = large(ways).join(labels, ["cloud_id", "i"]).groupBy("cloud_id", F.col("edge").alias("i")).agg(F.min("cluster").alias("cluster"))
    every = written(labels.unionByName(border), "clustered")
    big = every.groupBy("cloud_id", "cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select("cloud_id", "cluster")
    freed(pairs, cores, marked)
    return large(every).join(big, ["cloud_id", "cluster"]).select("cloud_id", F.col("i").alias("pt_idx"), "cluster")


def occupied(points: DataFrame, size: float, resolution: float, least: float, most: float) -> DataFrame:
    """cloud_id, gx, gy of the cells of a centred square grid that hold a point between two heights; coordinates are cut toward 0."""
    n = int(size / resolution)
    p = points.filter(F.col("z").between(least, most))
    p = p.withColumns({f"g{c}": ((F.col(c) + size / 2) / resolution).cast("int") for c in "xy"})
    return p.filter(F.col("gx").between(0, n - 1) & F.col("gy").between(0, n - 1)).select("cloud_id", "gx", "gy").distinct()


def offsets(k: int) -> list[int]:
    """-k // 2 … k // 2: k = 3 reaches two cells back and one ahead."""
    return list(range(-k // 2, k // 2 + 1))


def dilated(cells: DataFrame, n: int, k: int = 3) -> DataFrame:
    return grids.dilated(cells.withColumn("value", F.lit(1.0)), grids.Grid(float(n), 1.0), k).drop("value")


def eroded(cells: DataFrame, n: int, k: int = 3) -> DataFrame:
    """Cells all of whose neighbours within the grid are occupied."""
    return grids.eroded(cells.withColumn("value", F.lit(1.0)), grids.Grid(float(n), 1.0), k).drop("value")


def connectivity(cells: DataFrame) -> DataFrame:
    """Occupied neighbours, of eight, of every occupied cell."""
    eight = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = cells.withColumn("o", F.explode(eight)).select("cloud_id", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    counts = near.groupBy("cloud_id", "gx", "gy").agg(F.count("*").alias("n"))
    return cells.join(counts, ["cloud_id", "gx", "gy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def block_mean(raster: DataFrame, factor: int) -> DataFrame:
    """Means of factor × factor blocks; incomplete blocks at the far edges go."""
    size = raster.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    cut = raster.join(size, "image_id").filter((F.col("y") < F.col("h") - F.col("h") % factor) & (F.col("x") < F.col("w") - F.col("w") % factor))
    return cut.groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("depth").alias("depth"))


def repeated(raster: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a block of factor × factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = raster.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return out.select("image_id", (F.col("y") * factor + F.col("dy")).alias("y"), (F.col("x") * factor + F.col("dx")).alias("x"), "depth")


def back_projected(raster: DataFrame, fx: float, fy: float, cx: float, cy: float, least: float, most: float) -> DataFrame:
    p = raster.filter(F.col("depth").between(least, most))
    return p.select("image_id", "y", "x", ((F.col("x") - cx) * F.col("depth") / fx).alias("px"), ((F.col("y") - cy) * F.col("depth") / fy).alias("py"), F.col("depth").alias("pz"))


def calibrated(raster: DataFrame, references: DataFrame) -> DataFrame:
    """Depth in metres from references(image_id, y, x, metres): a line through two or more distinct depths, else a mean ratio; 1e-6 at least.

    An image whose slope is at or below 0, or not finite, fails the job. Images without usable references are left out.
    """
    refs = raster.join(references, ["image_id", "y", "x"]).filter((F.col("depth") > 0) & (F.col("metres") > 0))
    fit = refs.groupBy("image_id").agg(F.regr_slope("metres", "depth").alias("a"), F.regr_intercept("metres", "depth").alias("b"), F.avg(F.col("metres") / F.col("depth")).alias("r"), (F.max("depth") - F.min("depth")).alias("span"))
    line = F.col("span") > 1e-9
    fit = fit.select("image_id", F.when(line, F.col("a")).otherwise(F.col("r")).alias("slope"), F.when(line, F.col("b")).otherwise(0.0).alias("shift"))
    bad = F.col("slope").isNull() | F.isnan("slope") | (F.col("slope") <= 0) | F.isnan("shift") | (F.abs("slope") == float("inf"))
    fit = fit.withColumn("slope", F.when(bad, F.raise_error(F.concat(F.lit("no positive scale for image "), F.col("image_id").cast("string"))).cast("double")).otherwise(F.col("slope")))
    return raster.join(fit, "image_id").withColumn("depth", F.greatest(F.col("slope") * F.col("depth") + F.col("shift"), F.lit(1e-6)))


def proxy_iou(a: str, b: str) -> Column:
    """3-D overlap by centre distance of struct columns (cx, cy, cz, dx, dy, dz); rotation doesn't count."""
    c = lambda s, n: F.col(f"{s}.{n}")
    vol = lambda s: c(s, "dx") * c(s, "dy") * c(s, "dz")
    reach = norm(c(a, "dx"), c(a, "dy"), c(a, "dz")) + norm(c(b, "dx"), c(b, "dy"), c(b, "dz"))
    dist = norm(*[c(a, n) - c(b, n) for n in ("cx", "cy", "cz")])
    inter = (1 - dist / reach) * F.least(vol(a), vol(b))
    return F.when((vol(a) == 0) | (vol(b) == 0) | (dist > reach), 0.0).otherwise(inter / (vol(a) + vol(b) - inter))
