"""Nearest points in clouds of any density, by cells that are halved until few points are left in each.

Splitting gives leaves of at most `most` points. The k nearest within its own leaf bound how far a point must look; the leaves within that
bound are found by equality of cells: leaves also count as part of the larger cells around them, and a point asks at the level whose cells
are about as large as its bound. Leaves are compared by their boxes before their points are read. No task or row holds a cloud.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.operators.boxes import moments, with_axes
from percepta.shared import CROWD, freed, large, lookup_join, written

_BITS = 50  # halvings of a cloud's extent along an axis, within a double's precision
_SLACK = 1 + 1e-9  # beyond the rounding of distances
_AXES = "xyz"
_CELL = [f"c{a}" for a in _AXES]
_LEAF = ["cloud_id", "level", *_CELL]


def _place(at: Column, axis: str) -> Column:
    """The place of a coordinate along an axis of its cloud, in 2^-50 of the extent; it never falls as `at` rises."""
    return F.floor(F.least(F.greatest((at - F.col(f"lo_{axis}")) * F.col("unit"), F.lit(0.0)), F.lit(2.0**_BITS - 1)))


def _up(place: str, level: str) -> Column:
    return F.expr(f"shiftright({place}, {_BITS} - {level})")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda s, c: s + c, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in _AXES], F.lit(0.0)))


def leaves(points: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """points(cloud_id, ix, iy, iz, …) with level and cx, cy, cz of the largest cell around each that holds `most` points at most; also the tables it reads.

    Three levels are counted in a pass, and only points of cells that are still too full go on. Points closer than 2^-50 of the extent share a leaf.
    """
    open_points, parts, tables, base = points, [], [], 0
    while True:
        top = min(base + 3, _BITS)
        cells = {f"c{a}": F.shiftright(f"i{a}", _BITS - top) for a in _AXES}
        counts = open_points.withColumns(cells).groupBy("cloud_id", *_CELL).agg(F.count("*").alias("n"))
        for level in range(base, top + 1):
            # A window holds 512 rows at most: the cells three levels down.
            w = Window.partitionBy("cloud_id", *[F.shiftright(c, top - level) for c in _CELL])
            counts = counts.withColumn(f"n{level}", F.sum("n").over(w))
        level = F.coalesce(*[F.when(F.col(f"n{i}") <= most, i) for i in range(base, top + 1)], F.lit(_BITS if top == _BITS else None)).cast("int")
        counts = written(counts.select("cloud_id", *_CELL, level.alias("level"), "n"), "cell-counts")
        crowded = counts.filter(F.col("n") > CROWD).select("cloud_id", *_CELL)
        dealt = written(lookup_join(open_points.withColumns(cells), counts, ["cloud_id", *_CELL], "inner", crowded=crowded).drop(*_CELL, "n"), "leaf-points")
        freed(counts)
        tables.append(dealt)
        parts.append(dealt.filter("level is not null"))
        open_points, base = dealt.filter("level is null").drop("level"), top
        if top == _BITS or not open_points.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({f"c{a}": _up(f"i{a}", "level") for a in _AXES}), tables


def _bounded(points: DataFrame) -> DataFrame:
    """A row for each location: r, within which its `want` nearest points lie, loose where its leaf holds fewer and the cell around that leaf bounds it."""
    other = points.select(*_LEAF, *[F.col(c).alias(f"b{c}") for c in _AXES])
    keep = ["pt_idx", *_AXES, "want", "unit", *[f"lo_{a}" for a in _AXES]]
    near = large(points.filter("place = 1").select(*_LEAF, *keep)).join(other, _LEAF).groupBy(*_LEAF, *keep).agg(F.sort_array(F.collect_list(_distance("", "b"))).alias("d"))
    own = F.get("d", F.col("want") - 1)
    around = (2 * 3**0.5 * 2.0**_BITS) / F.col("unit") / F.pow(F.lit(2.0), F.col("level"))
    out = near.withColumns({"r": F.coalesce(own, around) * _SLACK, "loose": own.isNull()}).drop("d", *_CELL, "level")
    fit = F.floor(F.log2(F.lit(2.0**_BITS) / F.col("unit") / (2 * F.col("r"))))
    return out.withColumn("at_level", F.when(F.col("r") == 0, _BITS).otherwise(F.greatest(F.lit(0), F.least(F.lit(_BITS), fit))).cast("int"))


def _reached(asking: DataFrame, leaf: DataFrame) -> DataFrame:
    """asking with the leaves whose box is within r: at the level of r all leaves within its cells, at coarser levels leaves that are such a cell."""
    levels = sorted(r.level for r in leaf.select("level").distinct().collect())  # 51 at most, as are those asked for
    asked = sorted(r.at_level for r in asking.select("at_level").distinct().collect())
    sides = {f"{e}{a}": _place(F.col(a) + s * F.col("r"), a) for a in _AXES for e, s in (("f", -1), ("t", 1))}
    coarser = F.filter(F.array(*[F.lit(x) for x in levels]), lambda v: v < F.col("at_level"))
    emit = asking.withColumns(sides).withColumn("at", F.explode(F.concat(coarser, F.array("at_level")))).withColumn("whole", F.col("at") == F.col("at_level"))
    for a in _AXES:
        emit = emit.withColumn(f"g{a}", F.explode(F.sequence(_up(f"f{a}", "at"), _up(f"t{a}", "at"))))
    ways = F.concat(
        F.transform(F.filter(F.array(*[F.lit(x) for x in asked]), lambda v: v <= F.col("level")), lambda v: F.struct(v.alias("at"), F.lit(True).alias("whole"))),
        F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("whole"))),
    )
    listed = leaf.withColumn("way", F.explode(ways)).select("*", "way.*").drop("way")
    listed = listed.withColumns({f"g{a}": F.expr(f"shiftright(c{a}, level - at)") for a in _AXES})
    met = large(emit.drop(*sides, "at_level", "unit", *[f"lo_{a}" for a in _AXES])).join(listed, ["cloud_id", "at", "whole", *[f"g{a}" for a in _AXES]])
    gap = lambda far: F.sqrt(reduce(lambda s, c: s + c, [(F.greatest(F.abs(F.col(a) - F.col(f"lo_{a}")), F.abs(F.col(a) - F.col(f"hi_{a}"))) if far else F.greatest(F.col(f"lo_{a}") - F.col(a), F.col(a) - F.col(f"hi_{a}"), F.lit(0.0))) ** 2 for a in _AXES]))
    keep = [*_LEAF, "pt_idx", *_AXES, "want", "r"]
    met = met.withColumns({"least": gap(False), "far": gap(True) * _SLACK}).filter(F.col("least") <= F.col("r"))
    # A loose bound shrinks to the distance within which the nearest leaves lie whole and hold enough points.
    w = Window.partitionBy("cloud_id", "pt_idx")
    enough = F.sum("n").over(w.orderBy("far").rangeBetween(Window.unboundedPreceding, 0)) >= F.col("want")
    tight = met.filter("loose").withColumn("enough", enough).withColumn("r", F.least("r", F.min(F.when(F.col("enough"), F.col("far"))).over(w)))
    return met.filter("not loose").select(*keep).unionByName(tight.filter(F.col("least") <= F.col("r")).select(*keep))


def nearest(points: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """cloud_id, pt_idx, rank, nb of the k nearest points of each point, itself first, equal distances by pt_idx; all points in clouds below k.

    Points that coincide are searched for once and only the k least of them can be neighbours of others, so a location that holds a third of
    all rows is no cell of its own. Points without finite coordinates have no row and are nobody's neighbour. most: points a leaf, max(64, 4 k) if none.
    """
    if k < 1:
        raise ValueError("one neighbour at least, the point itself")
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in _AXES])
    p = points.filter(finite).select("cloud_id", "pt_idx", *[(F.col(c).cast("double") + 0.0).alias(c) for c in _AXES])
    same = Window.partitionBy("cloud_id", *_AXES).orderBy("pt_idx")
    kept = written(p.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k), "places")
    side = F.greatest(*[F.max(c) - F.min(c) for c in _AXES])
    extent = kept.groupBy("cloud_id").agg(*[F.min(c).alias(f"lo_{c}") for c in _AXES], (F.lit(2.0**_BITS) / F.when(side > 0, side).otherwise(1.0)).alias("unit"), F.least(F.lit(k), F.count("*")).cast("int").alias("want"))
    extent = written(extent, "extents")
    gridded = written(lookup_join(kept, extent, ["cloud_id"], "inner").withColumns({f"i{a}": _place(F.col(a), a) for a in _AXES}), "gridded")
    inside, tables = leaves(gridded, most or max(64, 4 * k))
    asking = written(_bounded(inside), "bounds")
    leaf = written(inside.groupBy(*_LEAF).agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in _AXES for n, f in (("lo", F.min), ("hi", F.max))]), "leaves")
    other = inside.select(*_LEAF, F.col("pt_idx").alias("nb"), *[F.col(c).alias(f"b{c}") for c in _AXES])
    met = large(_reached(asking, leaf)).join(other, _LEAF).withColumn("dist", _distance("", "b")).filter(F.col("dist") <= F.col("r"))
    rank = F.row_number().over(Window.partitionBy("cloud_id", "pt_idx").orderBy("dist", "nb"))
    first = met.select("cloud_id", "pt_idx", *_AXES, "want", "nb", "dist", rank.alias("rank")).filter((F.col("rank") <= k) & (F.col("rank") <= F.col("want")))
    found = written(first.groupBy("cloud_id", *_AXES, "want").agg(F.sort_array(F.collect_list(F.struct("rank", "nb"))).alias("near")), "found")
    freed(kept, extent, gridded, asking, leaf, *tables)
    ids = F.concat(F.array("pt_idx"), F.filter(F.transform("near", lambda v: v["nb"]), lambda v: v != F.col("pt_idx")))
    each = large(p).join(found, ["cloud_id", *_AXES]).select("cloud_id", "pt_idx", F.posexplode(F.slice(ids, 1, F.col("want"))).alias("rank", "nb"))
    return each.withColumn("rank", F.col("rank") + 1)


def normals(points: DataFrame, k: int = 10) -> DataFrame:
    """cloud_id, pt_idx, nx, ny, nz: the direction in which the k + 1 nearest points spread least, of either sign; 0 in clouds below k points."""
    near = nearest(points, k + 1).withColumn("at", F.struct("cloud_id", "pt_idx"))
    around = large(near).join(points.select("cloud_id", F.col("pt_idx").alias("nb"), *_AXES), ["cloud_id", "nb"])
    axes = with_axes(moments(around, "at"))
    n = points.groupBy("cloud_id").agg(F.count("*").alias("points"))
    least = lambda i: F.when(F.col("points") < k, 0.0).otherwise(F.col("rotation")[i][2])
    return large(axes.select("at.cloud_id", "at.pt_idx", "rotation")).join(n, "cloud_id").select("cloud_id", "pt_idx", *[least(i).alias(f"n{c}") for i, c in enumerate(_AXES)])
