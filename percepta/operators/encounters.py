"""Pairs of tracks that are near or can meet, joined on cells as wide as their reach; pairs farther apart are never formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.shared import crowded_join

#: Speeds below 2 to this power share a level.
SLOWEST = -10
#: Fixed value: relative speed below which two tracks never meet.
STILL = 0.1


def _cell(size: Column) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(n) for c, n in (("x", "cx"), ("y", "cy"))]


def _around(tracks: DataFrame, size: Column) -> DataFrame:
    """Each track in its own and the eight cells around it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = tracks.select("*", *_cell(size), F.explode(steps).alias("step_"))
    return out.withColumns({"cx": F.col("cx") + F.col("step_.i"), "cy": F.col("cy") + F.col("step_.j")}).drop("step_")


def _sides(tracks: DataFrame, extra: list[str]) -> DataFrame:
    kept = tracks.select("track_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", *extra)])
    return kept.dropna()


def _ordered(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """track_a < track_b, and the columns of both."""
    swap = F.col("track_id") > F.col("track_id_o")
    pick = lambda c, a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c)
    return pairs.select(*[x for c in ("track_id", *columns) for x in (pick(f"{c}_a", c, f"{c}_o"), pick(f"{c}_b", f"{c}_o", c))])


def near_pairs(tracks: DataFrame, radius: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """track_id_a < track_id_b, x, y and the `extra` columns of both, and distance, of all pairs of tracks(track_id, x, y, …) at most `radius` apart.

    Tracks meet in an equi-join on cells of the radius' width. Tracks with a null among these columns are in no pair.
    """
    columns = ["x", "y", *extra]
    rows = _sides(tracks, list(extra))
    others = rows.select(*[F.col(c).alias(f"{c}_o") for c in rows.columns], *_cell(F.lit(float(radius))))
    pairs = _around(rows, F.lit(float(radius))).join(others, ["cx", "cy"]).filter("track_id < track_id_o")
    pairs = pairs.withColumn("distance", F.sqrt((F.col("x_o") - F.col("x")) ** 2 + (F.col("y_o") - F.col("y")) ** 2)).filter(F.col("distance") <= radius)
    return _ordered(pairs, columns).withColumn("distance", F.sqrt((F.col("x_b") - F.col("x_a")) ** 2 + (F.col("y_b") - F.col("y_a")) ** 2))


def meeting_pairs(tracks: DataFrame, threshold: float = 3.0) -> DataFrame:
    """track_id_a < track_id_b, dx, dy, dvx, dvy (b less a) of all pairs of tracks(track_id, x, y, vx, vy) with distance / relative speed below `threshold`.

    Two tracks that meet within the threshold are at most threshold · (their speeds' sum) apart, so at most twice the faster one's reach. Speeds
    fall into levels of powers of two. A track looks for slower ones, or ones of its own level, in the nine cells around it of a grid as wide as
    twice its level's reach; so a few fast tracks don't widen the cells of all others. A track stands in one cell of each level
    that isn't below its own, of which there are few (a level for each power of two). Crowded cells are dealt over tasks. Tracks with a null are in no pair.
    """
    rows = _sides(tracks, ["vx", "vy"])
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    rows = rows.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest(speed, F.lit(2.0**SLOWEST)))), F.lit(SLOWEST)).cast("int"))
    levels = sorted(r.level for r in rows.select("level").distinct().collect())  # at most one for each exponent of a double
    size = threshold * (2 * F.pow(F.lit(2.0), F.col("level")) + 1e-6) * (1 + 1e-9)
    all_levels = F.array(*map(F.lit, levels)).cast("array<int>")
    slow = rows.select(*[F.col(c).alias(f"{c}_o") for c in ("track_id", "vx", "vy")], "x", "y", F.col("level").alias("level_o"), F.explode(F.filter(all_levels, lambda v: v >= F.col("level"))).alias("level"))
    slow = slow.select("*", *_cell(size)).withColumnsRenamed({"x": "x_o", "y": "y_o"})
    pairs = crowded_join(_around(rows, size), slow, ["level", "cx", "cy"], F.col("track_id_o"))
    pairs = pairs.filter((F.col("level_o") < F.col("level")) | ((F.col("level_o") == F.col("level")) & (F.col("track_id") < F.col("track_id_o"))))
    apart, relative = (F.sqrt((F.col(f"{a}_o") - F.col(a)) ** 2 + (F.col(f"{b}_o") - F.col(b)) ** 2) for a, b in (("x", "y"), ("vx", "vy")))
    pairs = pairs.filter((relative >= STILL) & (apart / (relative + 1e-6) < threshold))
    both = _ordered(pairs, ["x", "y", "vx", "vy"])
    return both.select("track_id_a", "track_id_b", *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d{c}") for c in ("x", "y", "vx", "vy")])
