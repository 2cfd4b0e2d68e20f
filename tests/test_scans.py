"""Folds as parallel prefix scans: equal to plain loops, with keys cut into many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percepta.operators import kalman, learning, scans


def rounded(rows):
    return sorted(tuple(None if v is None else round(v, 8) if isinstance(v, float) else v for v in r) for r in rows)


def positions(spark):
    """A long track, one with gaps, one whose y comes late, short ones; null keys and frames."""
    rng = np.random.default_rng(1)
    rows = [("long", i, float(i + rng.normal()), float(-i)) for i in range(3000)]
    rows += [("gaps", i, float(rng.normal()) if i % 5 else None, float(i) if i % 3 == 0 else None) for i in range(700)]
    rows += [("late", i, 1.0, None if i < 400 else 2.0) for i in range(500)] + [(f"k{i}", 3, float(i), None) for i in range(20)]
    rows += [(None, 1, 1.0, 1.0), ("long", None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "track_id string, frame_id long, x double, y double").repartition(7)


def looped(df, dt=1.0, start=None):
    held, out = {}, []
    for r in sorted((r for r in df.collect() if r.track_id is not None and r.frame_id is not None), key=lambda r: (r.track_id, r.frame_id)):
        s = held.setdefault(r.track_id, list((start or {}).get(r.track_id, [None, None])))
        for k, z in enumerate((r.x, r.y)):
            if s[k] is None:
                s[k] = None if z is None else kalman.born(z)
            else:
                ahead = kalman.predicted(s[k], dt)
                s[k] = ahead if z is None else kalman.updated(ahead, z)
        out.append((r.track_id, r.frame_id, *(v for a in s for v in (a or (None,) * 5))))
    return rounded(out)


@pytest.mark.parametrize("block", [None, 100, 500_000])
def test_kalman_scan_equals_the_loop(spark, block):
    df = positions(spark)
    for dt in (1.0, 0.25):
        assert rounded(kalman.filter_tracks(df, dt=dt, block=block).collect()) == looped(df, dt)


def test_short_tracks_have_the_very_states_of_a_loop(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [(t, f, *(None if rng.random() < 0.4 else float(rng.normal()) * 1e5 for _ in "xy")) for t in range(40) for f in range(int(rng.integers(1, 130)))]
    df = spark.createDataFrame(rows, "track_id long, frame_id long, x double, y double")
    want, held = {}, {}
    for t, f, *z in rows:
        s = held.setdefault(t, [None, None])
        for k, m in enumerate(z):
            ahead = s[k] and kalman.predicted(s[k], 1.0)
            s[k] = ahead if m is None else kalman.updated(ahead, m) if ahead else kalman.born(m)
        want[t, f] = tuple(v for a in s for v in (a or (None,) * 5))
    assert {(r[0], r[1]): tuple(r[2:]) for r in kalman.filter_tracks(df).collect()} == want
    # The same where a track goes over batches, and where long segments between them are combined.
    scan = kalman._filtering(1.0)
    schema = T.StructType.fromDDL(f"order long, {kalman.STATE}")
    for longest, near in ((1024, 0), (50, 1e-9)):
        z = [[r[k] for r in rows] for k in (2, 3)]
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *(pa.array(c, pa.float64()) for c in z), pa.nulls(len(rows), pa.list_(pa.float64())), pa.array([r[1] for r in rows])], names=list("szwco"))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(scans, "STEPS", longest)
            got = [r for b in scans._scanning(scan, 2, schema, "rows")([batch.slice(i, 60) for i in range(0, len(batch), 60)]) for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
        for (t, f, *_), r in zip(rows, got, strict=True):
            assert r == (want[t, f] if not near else tuple(v if v is None else pytest.approx(v, rel=near, abs=1e-6) for v in want[t, f]))


def test_tracks_go_on_from_given_states(spark):
    df = positions(spark)
    start = {"long": [(5.0, 1.0, 0.5, 0.1, 1.0), None], "k3": [(1.0, 0.0, 2.0, 0.0, 3.0), (7.0, -1.0, 1.0, 0.5, 1.0)], "none": [(0.0,) * 5, None]}
    names = [n.split()[0] for n in kalman.STATE.split(", ")]
    states = spark.createDataFrame([(k, *(v for a in s for v in (a or (None,) * 5))) for k, s in start.items()], f"track_id string, {kalman.STATE}")
    assert states.columns[1:] == names
    assert rounded(kalman.filter_tracks_from(df, states).collect()) == looped(df, start=start)


def test_one_long_key_is_dealt_over_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("track_id"), F.col("id").alias("frame_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these partitions are too small for it
    try:
        out = kalman.filter_tracks(df, block=10_000).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and max(sizes) < 100_000


@pytest.mark.parametrize("block", [None, 64])
def test_advantages_equal_the_loop(spark, block):
    rng = np.random.default_rng(2)
    rows = [(e, s, float(rng.normal()) if s % 9 else None, float(rng.normal())) for e, n in ((1, 900), (2, 3), (3, 200)) for s in range(n)]
    df = spark.createDataFrame(rows, "episode_id long, step long, reward double, value double").repartition(5)
    want = []
    for e in (1, 2, 3):
        ahead = after = 0.0
        for _, s, r, v in sorted((r for r in rows if r[0] == e), key=lambda r: -r[1]):
            ahead, after = (r or 0.0) + 0.99 * after - v + 0.99 * 0.95 * ahead, v
            want.append((e, s, ahead, ahead + v))
    assert rounded(learning.advantages(df, "value", block=block).collect()) == rounded(want)


@pytest.mark.parametrize("block", [50, 500_000])
def test_constraint_statistics_equal_the_loop(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, 0, float(rng.normal()) * 6 if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "episode_id long, step long, speed double")
    checks = [("a", F.abs("speed"), 5.0), ("b", F.col("speed"), 3.0)]
    want = {}
    for name, of, most in (("a", abs, 5.0), ("b", float, 3.0)):
        avg, high, low, n = 0.0, 0.0, float("inf"), 0
        for _, _, v in rows:
            v = 0.0 if v is None else of(v)
            avg, high, low, n = 0.9 * avg + 0.1 * v, max(high, v), min(low, v), n + (v > most)
        want[name] = (round(avg, 8), round(high, 8), round(low, 8), n)
    got = {r.name: (round(r.avg_value, 8), round(r.max_value, 8), round(r.min_value, 8), r.violations) for r in learning.constraint_statistics(df, checks, ["episode_id", "step"], block).collect()}
    assert got == want


def test_constraint_statistics_stay_in_the_jvm_and_number_states_once(spark):
    states = "episode_id long, step long, speed double"
    df = spark.createDataFrame([(i % 7, i, float(i)) for i in range(50)] + [(8, 0, float("nan")), (9, 0, None)], states)
    checks = [(str(t), F.col("speed"), float(t)) for t in range(20)]
    made = learning.constraint_statistics(df, checks, ["episode_id", "step"])
    assert "InArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name: r.violations for r in made.collect()} == {str(t): 49 - t for t in range(20)}
    assert learning.constraint_statistics(df.limit(0), checks, ["episode_id", "step"]).count() == 0


def controlled(values, target, most, max_scale, least=0.5, alpha=0.2, step=0.1):
    ewma, skip, scale, out = None, 0, max_scale, []
    for v in values:
        if v is not None:
            ewma = v if ewma is None else alpha * v + (1 - alpha) * ewma
            if ewma > target:
                skip, scale = max(skip, min(int(ewma / target), most)), max(least, scale - step)
            elif ewma <= 0.8 * target:
                skip, scale = max(skip - 1, 0), min(max_scale, scale + step)
        out.append((ewma, skip, scale))
    return out


@pytest.mark.parametrize(("block", "max_scale"), [(None, 1.0), (40, 1.0), (40, 0.8)])
def test_frame_control_equals_the_loop(spark, block, max_scale):
    rng = np.random.default_rng(4)
    series = {k: [None if i % 13 == 0 else float(abs(rng.normal(33, 40))) for i in range(n)] for k, n in ((1, 600), (2, 5), (3, 300))}
    df = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "stream_id long, seq long, latency_ms double").repartition(3)
    got = rounded((r.stream_id, r.seq, r.ewma, r.skip, r.scale) for r in learning.frame_control(df, block=block, max_scale=max_scale).collect())
    want = [(k, i, *o) for k, s in series.items() for i, o in enumerate(controlled(s, 33.3, 4, max_scale))]
    assert got == rounded(want)
    assert max(r[4] for r in got) <= max_scale


def test_frame_control_refuses_settings_and_latencies_out_of_range(spark):
    df = spark.createDataFrame([(1, 1, -1.0)], "stream_id long, seq long, latency_ms double")
    with pytest.raises(Exception, match="below 0"):
        learning.frame_control(df).collect()
    with pytest.raises(ValueError, match="out of range"):
        learning.frame_control(df, least_scale=0.9, max_scale=0.8)
