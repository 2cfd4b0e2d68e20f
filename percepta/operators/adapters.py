"""Forecast samples and detector arrays of other tools as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.operators.motion import norm

#: Where reasoning stands in an output, and in a trace, in this order.
REASONING_KEYS = ["cot", "reasoning", "reasoning_traces", "chain_of_causation"]
TRACE_KEYS = ["text", "content", "reasoning", "cot", "value"]


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def samples_of(value: str, depth: int, batch_index: int = 0, inner: int = 2) -> Column:
    """A nested array of `depth` levels as an array of samples, each of `inner` levels (waypoints of coordinates).

    One level more than a sample's is an array of samples, two are batches of them, three are batches of sets; with none a single sample.
    """
    c, more = F.col(value), depth - inner
    if more not in (0, 1, 2, 3):
        raise ValueError(f"{value} has {depth} levels; {inner} to {inner + 3} can be read")
    if more >= 2:
        out_of_range = F.raise_error(F.concat(F.lit(f"batch {batch_index} is out of range of "), F.size(c).cast("string")))
        c = F.when((F.size(c) > batch_index) & F.lit(batch_index >= 0), F.get(c, F.lit(batch_index))).otherwise(out_of_range.cast("void"))
    return F.array(c) if more == 0 else F.flatten(c) if more == 3 else c


def waypoints(outputs: DataFrame, value: str = "pred_xyz", key: str = "clip_id", batch_index: int = 0, dims: tuple[int, ...] = (3,)) -> DataFrame:
    """key, sample, t, x, y, z (null in two dimensions) of the trajectories in a nested array column of any of the known shapes.

    A shape without samples or waypoints, a waypoint of another number of coordinates, and a coordinate that is null or not finite
    fail the job.
    """
    some = samples_of(value, _depth(outputs.schema[value].dataType), batch_index)
    checked = outputs.select(key, some.alias("samples"))
    bad = F.col("samples").isNull() | (F.size("samples") < 1) | F.exists("samples", lambda s: F.size(s) < 1)
    fail = lambda text: F.raise_error(F.lit(text))
    checked = checked.withColumn("samples", F.when(bad, fail("no sample or waypoint").cast(checked.schema["samples"].dataType)).otherwise(F.col("samples")))
    flat = checked.select(key, F.posexplode("samples").alias("sample", "s")).select(key, "sample", F.posexplode("s").alias("t", "p"))
    wrong = ~F.size("p").isin(*dims) | F.exists("p", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    flat = flat.withColumn("p", F.when(wrong, fail("a waypoint that can't be read").cast(flat.schema["p"].dataType)).otherwise(F.col("p")))
    return flat.select(key, "sample", "t", *[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def sample_counts(trajectories: DataFrame, key: str = "clip_id") -> DataFrame:
    """key and num_samples of waypoints' rows (key, sample, t, …)."""
    return trajectories.groupBy(key).agg((F.max("sample") + 1).alias("num_samples"))


def first_samples(trajectories: DataFrame) -> DataFrame:
    """The waypoints of each clip's sample 0."""
    return trajectories.filter(F.col("sample") == 0)


def positions_2d(trajectories: DataFrame) -> DataFrame:
    """Waypoints without their height."""
    return trajectories.drop("z")


def rotations(outputs: DataFrame, value: str = "pred_rot", key: str = "clip_id", batch_index: int = 0) -> DataFrame:
    """key, sample, t, rotation (three rows of three) of a nested array column of matrices, or of rows of nine numbers."""
    depth = _depth(outputs.schema[value].dataType)
    flat9 = depth == 3 and outputs.select(F.max(F.size(F.get(F.get(F.col(value), F.lit(0)), F.lit(0))))).first()[0] == 9
    if flat9:
        value_col = F.transform(F.col(value), lambda s: F.transform(s, lambda p: F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(3)), lambda i: F.slice(p, i, 3))))
        outputs, depth = outputs.select(key, value_col.alias(value)), 4
    some = samples_of(value, depth, batch_index, inner=3)
    flat = outputs.filter(F.col(value).isNotNull()).select(key, F.posexplode(some).alias("sample", "s")).select(key, "sample", F.posexplode("s").alias("t", "rotation"))
    wrong = (F.size("rotation") != 3) | F.exists("rotation", lambda r: (F.size(r) != 3) | F.exists(r, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return flat.withColumn("rotation", F.when(wrong, F.raise_error(F.lit("a rotation that can't be read")).cast(flat.schema["rotation"].dataType)).otherwise(F.col("rotation")))


def _texts(c: Column, kind: T.DataType) -> Column | None:
    """The texts of a nested column in order, or None if it can hold none."""
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(c))
    if isinstance(kind, T.ArrayType):
        if _texts(F.lit(None), kind.elementType) is None:
            return None
        return F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: _texts(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        for k in TRACE_KEYS:
            if k in kind.names:
                return _texts(c[k], kind[k].dataType)
    return None


def reasoning(outputs: DataFrame, n_samples: str, key: str = "clip_id") -> DataFrame:
    """key, sample, reasoning: the traces of the first column of REASONING_KEYS that there is, dealt to the samples in order; null where they are too few."""
    name = next((k for k in REASONING_KEYS if k in outputs.columns), None)
    found = None if name is None else _texts(F.col(name), outputs.schema[name].dataType)
    texts = F.array().cast("array<string>") if found is None else F.coalesce(found, F.array().cast("array<string>"))
    rows = outputs.select(key, texts.alias("traces"), F.explode(F.sequence(F.lit(0), F.col(n_samples).cast("int") - 1)).alias("sample"))
    return rows.select(key, "sample", F.get("traces", F.col("sample")).alias("reasoning"))


def parsed(outputs: DataFrame, key: str = "clip_id", horizon: int | None = None, batch_index: int = 0) -> DataFrame:
    """key, sample, n_waypoints, trajectory (array of x, y, z), reasoning of every sample. A horizon other than the one asked for fails the job."""
    points = waypoints(outputs, key=key, batch_index=batch_index)
    each = points.groupBy(key, "sample").agg(F.count("*").alias("n_waypoints"), F.transform(F.array_sort(F.collect_list(F.struct("t", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])).alias("trajectory"))
    if horizon is not None:
        fail = F.raise_error(F.concat(F.lit(f"{horizon} waypoints wanted, there are "), F.col("n_waypoints").cast("string"))).cast("long")
        each = each.withColumn("n_waypoints", F.when(F.col("n_waypoints") == horizon, F.col("n_waypoints")).otherwise(fail))
    counts = each.groupBy(key).agg(F.count("*").alias("samples"))
    return each.join(reasoning(outputs.join(counts, key), "samples", key), [key, "sample"], "left")


def sample_errors(predicted: DataFrame, truth: DataFrame, key: str = "clip_id") -> DataFrame:
    """key, sample, ade, fde, horizon of predicted(key, sample, t, x, y, z) against truth(key, t, x, y, z) over their common waypoints.

    Where the truth has no z, z doesn't count.
    """
    at = predicted.join(truth.select(key, "t", *[F.col(c).alias(f"t{c}") for c in "xyz"]), [key, "t"])
    gap = norm(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), F.coalesce(F.col("z") - F.col("tz"), F.lit(0.0)))
    return at.groupBy(key, "sample").agg(F.avg(gap).alias("ade"), F.max_by(gap, "t").alias("fde"), F.count("*").alias("horizon"))


def best_samples(errors: DataFrame, key: str = "clip_id") -> DataFrame:
    """key, best_sample (the least ade, the first of equals), min_ade, its fde as min_fde."""
    best = errors.groupBy(key).agg(F.min(F.struct("ade", "sample", "fde")).alias("b"))
    return best.select(key, F.col("b.sample").alias("best_sample"), F.col("b.ade").alias("min_ade"), F.col("b.fde").alias("min_fde"))


def detections(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys…, det_idx, x1, y1, x2, y2, confidence, class_id (and features) of rows with the arrays xyxy, confidence, class_id and perhaps features.

    Missing confidences are 1, classes 0; an empty xyxy gives no row. A null xyxy, or a box without four numbers, fails the job.
    """
    keys = keys or ["stream_id", "frame_id"]
    part = lambda c, kind: F.get(F.col(c), F.col("det_idx")).cast(kind) if c in frames.columns else F.lit(None).cast(kind)
    wrong = F.col("xyxy").isNull() | F.exists("xyxy", lambda b: b.isNull() | (F.size(b) != 4))
    fail = F.raise_error(F.lit("boxes have four numbers")).cast(frames.schema["xyxy"].dataType)
    rows = frames.withColumn("xyxy", F.when(wrong, fail).otherwise(F.col("xyxy"))).select("*", F.posexplode("xyxy").alias("det_idx", "box"))
    box = [F.get("box", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    extra = [F.get("features", F.col("det_idx")).alias("features")] if "features" in frames.columns else []
    return rows.select(*keys, "det_idx", *box, F.coalesce(part("confidence", "double"), F.lit(1.0)).alias("confidence"), F.coalesce(part("class_id", "int"), F.lit(0)).alias("class_id"), *extra)


def tracked_arrays(tracks: DataFrame, frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys…, xyxy, confidence, class_id, tracker_id: a frame's tracks as arrays in the order of their ids; a frame without tracks keeps its own arrays, with a null tracker_id."""
    keys = keys or ["stream_id", "frame_id"]
    item = F.struct("track_id", F.array("x1", "y1", "x2", "y2").alias("box"), "confidence", "class_id")
    g = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("t"))
    of = lambda c: F.transform("t", lambda s: s[c])
    out = frames.join(g, keys, "left")
    own = lambda c, made: F.coalesce(made, F.col(c)).alias(c)
    return out.select(*keys, own("xyxy", of("box")), own("confidence", of("confidence")), own("class_id", of("class_id")), of("track_id").alias("tracker_id"))

