"""Depth rasters as tables of pixels (image_id, y, x, depth): lookups, depth from edges and fusion with points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percepta.operators.tiles import edges, majorities
from percepta.shared import lookup_join, written


def depth_at(raster: DataFrame, points: DataFrame, most: float = 100.0) -> DataFrame:
    """points(image_id, px, py, …) with depth, the coordinates cut to pixels; `most` outside the image."""
    at = points.withColumns({"y": F.col("py").cast("long"), "x": F.col("px").cast("long")})
    return at.join(raster.select("image_id", "y", "x", "depth"), ["image_id", "y", "x"], "left").withColumn("depth", F.coalesce("depth", F.lit(most))).drop("y", "x")


def depth_from_edges(raster: DataFrame, value: str = "grey", near: float = 3.5, far: float = 6.5, least: float = 0.1, most: float = 100.0, median: bool = True) -> DataFrame:
    """Adds a placeholder depth: near at edges, far elsewhere, then the median of 5 × 5 pixels, which for two values is a majority of 13."""
    marks = edges(raster, value).select("image_id", "y", "x", F.col("edge").cast("int").alias("edge"))
    if median:
        marks = majorities(marks, "edge")
    depth = F.when(F.col("edge") == 1, near).otherwise(far)
    return marks.select("image_id", "y", "x", F.greatest(F.lit(least), F.least(F.lit(most), depth)).alias("depth"))


def depth_from_inverse(raster: DataFrame, value: str = "inv_depth", least: float = 0.1, most: float = 10.0) -> DataFrame:
    """image_id, y, x, depth: an image's inverse depths spread over least (the largest) to most; most throughout an image of one value."""
    ends = written(raster.groupBy("image_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "inverse-ends")
    both = lookup_join(raster.select("image_id", "y", "x", F.col(value).alias("v")), ends, ["image_id"], "inner", spread=[F.col("y"), F.col("x")])
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return both.select("image_id", "y", "x", F.when(F.col("hi") > F.col("lo"), most - share * (most - least)).otherwise(most).alias("depth"))


def fused_with_points(raster: DataFrame, points: DataFrame, fx: float, fy: float, cx: float, cy: float, weight: float = 0.5, least: float = 0.1, most: float = 100.0) -> DataFrame:
    """The raster with the depth of points(image_id, pt_idx, x, y, z) mixed in where they fall; the last point of a pixel counts.

    Points behind the camera or outside the image are left out; all depths are clipped. Without any point the raster stays as it is.
    """
    p = points.filter("z > 0").select("image_id", F.bround(F.col("x") * fx / F.col("z") + cx).cast("long").alias("x"), F.bround(F.col("y") * fy / F.col("z") + cy).cast("long").alias("y"), "z", "pt_idx")
    seen = p.groupBy("image_id", "y", "x").agg(F.max_by("z", "pt_idx").alias("z"))
    any_point = points.select("image_id").distinct().withColumn("clip", F.lit(True))
    out = raster.join(seen, ["image_id", "y", "x"], "left").join(any_point, "image_id", "left")
    mixed = F.when(F.col("z").isNull(), F.col("depth")).otherwise((1 - weight) * F.col("depth") + weight * F.col("z"))
    return out.withColumn("depth", F.when(F.col("clip"), F.greatest(F.lit(least), F.least(F.lit(most), mixed))).otherwise(F.col("depth"))).drop("z", "clip")
