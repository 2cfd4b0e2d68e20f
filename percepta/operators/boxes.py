"""Boxes in space: centre (cx, cy, cz), size (dx, dy, dz) and a rotation, an array of three rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.operators.motion import norm
from percepta.shared import crowded_join

UNIT = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
#: The corners in their order, as signs of half the size.
CORNERS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]


def unit_rotation() -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in row]) for row in UNIT])


def volume() -> Column:
    return F.col("dx") * F.col("dy") * F.col("dz")


def corners(boxes: DataFrame, key: str = "box_id") -> DataFrame:
    """key, corner (0 to 7), x, y, z of every box's corners, turned and moved to its centre."""
    signs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xyz", s, strict=True)]) for s in CORNERS])
    each = boxes.select(key, "cx", "cy", "cz", "rotation", F.posexplode(signs).alias("corner", "s"), *[F.col(f"d{c}") / 2 for c in "xyz"]).toDF(key, "cx", "cy", "cz", "rotation", "corner", "s", "hx", "hy", "hz")
    turned = lambda i: sum((F.col("rotation")[i][j] * F.col(f"s.{c}") * F.col(f"h{c}") for j, c in enumerate("xyz")), F.lit(0.0))
    return each.select(key, "corner", *[(turned(i) + F.col(f"c{c}")).alias(c) for i, c in enumerate("xyz")])


def projected(points: DataFrame, intrinsics: list[list[float]]) -> DataFrame:
    """Adds u, v: points seen through a 3×3 matrix; null in the plane of the camera."""
    row = lambda k: sum((F.lit(float(m)) * F.col(c) for m, c in zip(intrinsics[k], "xyz", strict=True)), F.lit(0.0))
    return points.withColumns({"u": F.try_divide(row(0), row(2)), "v": F.try_divide(row(1), row(2))})


def from_depth(boxes: DataFrame, raster: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Boxes in space from boxes(box_id, image_id, x1, y1, x2, y2) and the depth at their middle pixel, cut and clipped to the image.

    Their depth is half the distance, and they aren't turned. A middle pixel without depth gives nulls.
    """
    size = raster.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    middle = lambda a, b, most: F.greatest(F.lit(0), F.least(F.col(most), (F.col(a) + F.col(b)) / 2)).cast("long")
    at = boxes.join(size, "image_id").withColumns({"px": middle("x1", "x2", "w"), "py": middle("y1", "y2", "h")})
    at = at.join(raster.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "depth"), ["image_id", "py", "px"], "left")
    d = F.col("depth")
    place = {"cx": (F.col("px") - cx) * d / fx, "cy": (F.col("py") - cy) * d / fy, "cz": d}
    extent = {"dx": (F.col("x2") - F.col("x1")) / fx * d, "dy": (F.col("y2") - F.col("y1")) / fy * d, "dz": d * 0.5}
    return at.withColumns(place | extent | {"rotation": unit_rotation()}).select("box_id", "image_id", *place, *extent, "rotation")


def moments(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """For every cloud: n, centre, size and the six sample covariances of its points; sums that partitions add up."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"], *[F.covar_samp(a, b).alias(f"{a}{b}") for a, b in pairs])


def _axes(batches: Iterable) -> Iterator:
    """Principal axes of each row's covariances, the widest first, as the columns of a rotation, and their variances."""
    import pyarrow as pa

    for batch in batches:
        n = batch.column("n").to_numpy()
        six = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("xx", "xy", "xz", "yy", "yz", "zz")], 1)
        values, vectors = np.linalg.eigh(six[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
        values, vectors = values[:, ::-1], vectors[:, :, ::-1]
        vectors = np.where((n < 3)[:, None, None], np.eye(3), vectors)
        kept = [batch.column(c) for c in batch.schema.names]
        made = [pa.array(vectors.tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(values.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names, "rotation", "variances"])


def with_axes(covariances: DataFrame) -> DataFrame:
    """Adds rotation (principal axes as columns, of either sign) and variances to rows of moments(); below three points no turn."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in covariances.schema.fields)
    return covariances.mapInArrow(_axes, f"{fields}, rotation array<array<double>>, variances array<double>")


def from_cloud(points: DataFrame, key: str = "cloud_id", confidence: float = 0.9) -> DataFrame:
    """A box for every cloud: the mean, the extent along the axes and, beside it, the turn of the principal axes."""
    return with_axes(moments(points, key)).withColumn("confidence", F.lit(confidence)).select(key, "cx", "cy", "cz", "dx", "dy", "dz", "rotation", "confidence")


def moved(boxes: DataFrame, m: list[list[float]]) -> DataFrame:
    """Boxes under a 4×4 transform: centre and rotation change, the size doesn't."""
    centre = {f"c{c}": sum((F.lit(float(m[i][j])) * F.col(f"c{d}") for j, d in enumerate("xyz")), F.lit(float(m[i][3]))) for i, c in enumerate("xyz")}
    cell = lambda i, j: sum((F.lit(float(m[i][k])) * F.col("rotation")[k][j] for k in range(3)), F.lit(0.0))
    turn = F.array(*[F.array(*[cell(i, j) for j in range(3)]) for i in range(3)])
    return boxes.withColumns(centre | {"rotation": turn})


def near_boxes(boxes: DataFrame, group: str) -> DataFrame:
    """group, a, b, iou of the pairs of boxes of a group whose overlap by centre distance is above 0.

    Boxes fall into levels by powers of two of their reach, and each meets smaller ones, or ones of its own level, in the cells around it of a grid as
    wide as its level; so a huge box doesn't widen the cells of small ones. A box stands in one cell of each level above its own. Crowded cells are
    dealt over tasks.
    """
    reach = norm(F.col("dx"), F.col("dy"), F.col("dz"))
    b = boxes.filter(volume() > 0).select(group, F.col("box_id").alias("id"), "cx", "cy", "cz", volume().alias("volume"), reach.alias("reach"))
    b = b.withColumn("level", F.ceil(F.log2("reach")).cast("int"))
    levels = sorted(r.level for r in b.select("level").distinct().collect() if r.level is not None)  # at most one for each exponent of a double
    cells = lambda d: d.withColumns({f"g{c}": F.floor(F.col(f"c{c}") / F.pow(F.lit(2.0), F.col("level") + 1)) for c in "xyz"})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    large = cells(b).withColumn("o", F.explode(around)).withColumns({f"g{c}": F.col(f"g{c}") + F.col(f"o.{n}") for c, n in zip("xyz", "ijk", strict=True)}).drop("o")
    above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col("level"))
    small = cells(b.withColumn("own", F.col("level")).withColumn("level", F.explode(above))).select(group, "level", "gx", "gy", "gz", "own", *[F.col(c).alias(f"o_{c}") for c in ("id", "cx", "cy", "cz", "volume", "reach")])
    both = crowded_join(large, small, [group, "level", "gx", "gy", "gz"], F.col("o_id")).filter((F.col("own") < F.col("level")) | ((F.col("own") == F.col("level")) & (F.col("id") < F.col("o_id"))))
    dist, most = norm(*[F.col(f"c{c}") - F.col(f"o_c{c}") for c in "xyz"]), F.col("reach") + F.col("o_reach")
    shared = (1 - dist / most) * F.least("volume", "o_volume")
    out = both.filter((dist < most) & (F.col("id") != F.col("o_id")))
    out = out.select(group, F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), (shared / (F.col("volume") + F.col("o_volume") - shared)).alias("iou"))
    return out.filter(F.col("iou") > 0)
