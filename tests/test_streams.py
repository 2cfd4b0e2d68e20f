"""Folds over streams: the same rows as over the whole table, batch after batch."""

import pytest

from percepta.operators import fusion, kalman, learning

POSITIONS = "track_id long, frame_id long, x double, y double"
LATENCIES = "stream_id long, seq long, latency_ms double"
EVENTS = "vehicle_id string, seq long, kind string, t double, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double, alt double, speed double, heading double, accuracy double"


def streamed(spark, folder, batches, schema, operator):
    """What the operator appends for the batches, each a file that is read alone, in order."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(schema).parquet(str(folder / "in"))
        query = operator(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def as_rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)  # a table's folds may add in another order


def event(v, s):
    if s % 3:
        return (v, s, "imu", s * 0.1, 0.5, 0.1 * s, -0.2, 0.01, 0.02, 0.03 * s, *[None] * 6)
    return (v, s, "gps", s * 0.1, *[None] * 6, 0.001 * s, 0.002 * s, 3.0, float(s % 2), 30.0, None)


CASES = {
    "kalman": (POSITIONS, lambda: [(t, f, None if (f + t) % 4 == 0 else 1.5 * f, float(f * t)) for t in (1, 2, 3) for f in range(9)], kalman.filter_tracks),
    "fusion": (EVENTS, lambda: [event(v, s) for v in ("a", "b") for s in range(9)], fusion.fused),
    "frames": (LATENCIES, lambda: [(i, s, None if s == 4 else 20.0 + 17 * ((s * i) % 5)) for i in (1, 2) for s in range(9)], lambda d: learning.frame_control(d, gated=True)),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_table(spark, tmp_path, name):
    schema, made, operator = CASES[name]
    rows = made()
    batches = [[r for r in rows if r[1] // 3 == k] for k in range(3)]
    got = streamed(spark, tmp_path / name, batches, schema, operator)
    want = operator(spark.createDataFrame(rows, schema))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert as_rows(got) == as_rows(want) and len(rows) == want.count()


def test_late_null_and_repeated_rows(spark, tmp_path):
    batches = [[(1, 5, 20.0), (1, 3, 40.0), (None, 1, 1.0), (1, None, 1.0)], [(1, 4, 1.0), (1, 5, 1.0)], [(1, 6, 30.0), (1, 6, 30.0), (2, 1, 9.0)]]
    got = streamed(spark, tmp_path / "late", batches, LATENCIES, learning.frame_control)
    want = learning.frame_control(spark.createDataFrame([(1, 3, 40.0), (1, 5, 20.0), (1, 6, 30.0), (1, 6, 30.0), (2, 1, 9.0)], LATENCIES))
    assert as_rows(got) == as_rows(want)


def test_a_stream_has_no_end_to_begin_at(spark, tmp_path):
    schema = "episode_id long, step long, reward double, v double"
    spark.createDataFrame([(1, 1, 1.0, 1.0)], schema).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="no last row"):
        learning.advantages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "v")


TIMED = "stream_id long, seq long, latency_ms double, ts timestamp, reset boolean"


def timed(rows):
    """(stream, seq, latency[, reset]), a second for each seq."""
    from datetime import datetime, timedelta

    return [(k, s, v, datetime(2026, 1, 1) + timedelta(seconds=s), bool(more and more[0])) for k, s, v, *more in rows]


def test_a_shuffled_stream_equals_the_table(spark, tmp_path):
    """Rows come up to 40 seconds late, over batches; the last batch only moves the watermark past all others."""
    import random

    rows = [(i, s, None if s % 7 == 0 else 20.0 + 17 * ((s * i) % 5)) for i in (1, 2) for s in range(60)]
    shuffled = sorted(rows, key=lambda r: r[1] + random.Random(f"{r}").random() * 30)
    assert [r[1] for r in shuffled] != sorted(r[1] for r in shuffled)
    batches = [timed(shuffled[k : k + 30]) for k in range(0, 120, 30)] + [timed([(9, 1000, 1.0)])]
    for gated in (True, False):
        got = streamed(spark, tmp_path / f"late-{gated}", batches, TIMED, lambda d, g=gated: learning.frame_control(d.withWatermark("ts", "40 seconds"), gated=g, time="ts"))
        want = learning.frame_control(spark.createDataFrame(timed(rows), TIMED), gated=gated)
        assert as_rows(got.filter("stream_id < 9")) == as_rows(want)


def keys_held(spark, folder):
    """Keys in the state store after the last batch."""
    return spark.read.format("statestore").load(str(folder / "cp")).count()


def test_resets_end_keys_and_shrink_the_state(spark, tmp_path):
    batches = [timed([(k, s, 50.0) for k in range(6) for s in (1, 2)]), timed([(k, 3, None, True) for k in range(4)]), timed([(0, 4, 10.0), (0, 5, 90.0), (5, 3, 50.0)])]
    held = []
    for n in (1, 2, 3):
        folder = tmp_path / f"reset-{n}"
        got = streamed(spark, folder, batches[:n], TIMED, lambda d: learning.frame_control(d, reset="reset"))
        held.append(keys_held(spark, folder))
    assert held == [6, 2, 3]
    want = learning.frame_control(spark.createDataFrame([r for b in batches for r in b], TIMED), reset="reset")
    assert as_rows(got) == as_rows(want)
    assert {(r.seq, r.ewma) for r in got.filter("stream_id = 0").collect()} == {(1, 50.0), (2, 50.0), (4, 10.0), (5, 26.0)}


def test_silent_keys_expire_by_the_watermark(spark, tmp_path):
    batches = [timed([(k, s, 50.0) for k in range(6) for s in (1, 2)]), timed([(0, 500, 10.0)]), timed([(0, 501, 10.0)]), timed([(0, 900, 10.0), (1, 901, 7.0)]), timed([(0, 1900, 1.0)])]
    folder = tmp_path / "silent"
    got = streamed(spark, folder, batches, TIMED, lambda d: learning.frame_control(d.withWatermark("ts", "1 second"), time="ts", expire_ms=60_000))
    assert keys_held(spark, folder) <= 2
    assert {(r.seq, r.ewma) for r in got.filter("stream_id = 1").collect()} == {(1, 50.0), (2, 50.0), (901, 7.0)}


DETECTIONS = "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, confidence double, reset boolean"


def test_track_ids_restart_after_a_reset(spark, tmp_path):
    from percepta.streaming.tracks import track_stream

    seen = lambda f: [(1, f, d, 100.0 * d, 0.0, 100.0 * d + 40, 60.0, 0.9, False) for d in (0, 1)]
    reset = [(1, 3, None, None, None, None, None, None, True)]
    batches = [seen(1) + seen(2), reset, seen(4)[1:] + seen(5)]
    got = streamed(spark, tmp_path / "tracks", batches, DETECTIONS, lambda d: track_stream(d, reset="reset"))
    assert as_rows(got) == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 0, 1), (1, 2, 1, 2), (1, 4, 1, 1), (1, 5, 0, 2), (1, 5, 1, 1)]
    folder = tmp_path / "ended"
    streamed(spark, folder, batches[:2], DETECTIONS, lambda d: track_stream(d, reset="reset"))
    assert keys_held(spark, folder) == 0


def test_pattern_states_of_a_stream_and_removed_tracks(spark, tmp_path):
    from percepta.operators import motion

    schema = "track_id long, frame_id long, pattern string, confidence double, reset boolean"
    names = ["a", "a", "a", "b", "b", "b", "b", "a", "c", "c"]
    rows = [(t, f, names[(f + t) % 10], f / 10, False) for t in (1, 2) for f in range(10)]
    batches = [[r for r in rows if r[1] // 4 == k] for k in range(3)]
    got = streamed(spark, tmp_path / "patterns", batches, schema, motion.pattern_stream)
    want = motion.pattern_states(spark.createDataFrame(rows, schema))
    assert as_rows(got.select(want.columns)) == as_rows(want)
    again = [(1, 20, None, None, True), (1, 21, "a", 0.5, False)]
    folder = tmp_path / "removed"
    got = streamed(spark, folder, [*batches, again[:1], again[1:]], schema, lambda d: motion.pattern_stream(d, reset="reset"))
    last = got.filter("track_id = 1 and frame_id = 21").first()
    assert (last.frame_count, last.pattern_start, keys_held(spark, folder)) == (1, 21, 2)
