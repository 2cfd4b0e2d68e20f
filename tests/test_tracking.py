"""The assignment against all permutations, and trackers in batch and as a stream."""

from itertools import permutations

import numpy as np
import pytest

from percepta.operators import tracking
from percepta.streaming.tracks import track_stream

SCHEMA = "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, confidence double"


def box(stream, frame, det, x, score=0.9):
    return (stream, frame, det, float(x), 0.0, float(x) + 40, 60.0, score)


def ids(df):
    return {(r.stream_id, r.frame_id, r.det_idx): r.track_id for r in df.collect()}


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6), (4, 5)])
def test_assignment_is_least(shape):
    rng = np.random.default_rng(7)
    for k in range(40):
        cost = rng.random(shape) * 100 if k % 2 else rng.integers(0, 4, shape).astype(float)
        got = tracking.assign(cost)
        assert len(got) == min(shape) == len({r for r, _ in got}) == len({c for _, c in got})
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(len(c))) for p in permutations(range(c.shape[1]), len(c)))
        assert sum(cost[r, c] for r, c in got) == pytest.approx(best)


def test_occlusion_and_death(spark):
    rows = [box(1, 1, 0, 0), box(1, 1, 1, 500), box(1, 2, 0, 3), box(1, 5, 0, 6), box(1, 9, 0, 9), box(2, 1, 0, 0), box(2, 2, 0, 2)]
    got = ids(tracking.identified(spark.createDataFrame(rows, SCHEMA), max_age=3))
    assert got == {(1, 1, 0): 1, (1, 1, 1): 2, (1, 2, 0): 1, (1, 5, 0): 1, (1, 9, 0): 3, (2, 1, 0): 1, (2, 2, 0): 1}


def test_two_stages(spark):
    rows = [box(1, 1, 0, 0, 0.9), box(1, 1, 1, 500, 0.3), box(1, 2, 0, 3, 0.2), box(1, 3, 0, 4, 0.05), box(1, 4, 0, 5, None)]
    assert ids(tracking.identified(spark.createDataFrame(rows, SCHEMA), high=0.5)) == {(1, 1, 0): 1, (1, 2, 0): 1, (1, 4, 0): 1}


def test_nulls_and_empty(spark):
    rows = [box(1, 1, 0, 0), (1, 1, 1, None, 0.0, 1.0, 1.0, 1.0), (None, 1, 0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(tracking.identified(df)) == {(1, 1, 0): 1}
    assert tracking.histories(tracking.identified(df.limit(0))).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [box(s, f, d, 100 * d + f % 5) for s in (1, 2) for f in range(1, 9) for d in range(3) if (f + d) % 4]
    for k, some in enumerate(([r for r in rows if r[1] <= 4], [r for r in rows if r[1] > 4])):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = track_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(tracking.identified(spark.createDataFrame(rows, SCHEMA)))


def test_sparse_assignment_equals_that_of_the_matrix():
    rng = np.random.default_rng(11)
    for k in range(400):
        gate, most, span = (0.3, 0.1, 0.0)[k % 3], (100.0, 5.0)[k % 2], (15, 60, 600)[k % 3 if k % 7 else 2]
        made = []
        for _ in range(2):
            at = rng.uniform(0, span, (int(rng.integers(1, 12)) if k % 20 else 80, 2))
            made.append(np.concatenate([at, at + rng.uniform(5, 40, at.shape) * 2.0 ** rng.integers(-2, 6, (len(at), 1))], 1))
        c = tracking.costs(*made, gate, most)
        assert tracking.matches(*made, gate, most) == [p for p in tracking.assign(c) if c[p] < most]


def test_a_large_frame_makes_no_matrix(monkeypatch):
    def refused(*_):
        raise AssertionError("a matrix of all pairs")

    monkeypatch.setattr(tracking, "costs", refused)
    at = np.arange(20_000) * 10.0  # a chain: each box overlaps its neighbours beyond the gate
    boxes = np.stack([at, at * 0, at + 40, at * 0 + 60], 1)
    assert tracking.matches(boxes, boxes + 1) == [(i, i) for i in range(20_000)]


@pytest.mark.parametrize(("high", "reset"), [(None, False), (0.5, False), (None, True)])
def test_trackers_step_large_frames_without_a_matrix(monkeypatch, high, reset):
    import pyarrow as pa

    def refused(*_):
        raise AssertionError("a matrix of all pairs")

    monkeypatch.setattr(tracking, "costs", refused)
    n, frames = 5000, []
    for frame in (1, 2, 3):
        at = np.arange(n) * 10.0 + frame
        score = np.where(np.arange(n) % 2, 0.3 if frame > 1 else 0.9, 0.9)
        columns = [np.full(n, 1), np.full(n, 1), np.full(n, frame), np.arange(n), at, at * 0, at + 40, at * 0 + 60, score, np.zeros(n, bool)]
        if reset and frame == 3:
            columns = [np.insert(c, 0, True if c.dtype == bool else c[0]) for c in columns]
        frames.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefghij")))
    got = [i for b in tracking._identified(8, high, 0.1)(frames) for i in b.column(4).to_pylist()]
    assert got == list(range(1, n + 1)) * 3


def test_a_frame_over_several_batches_and_columns_that_come_along():
    import pyarrow as pa

    rng, rows = np.random.default_rng(5), []
    for stream in (1, 2):
        for frame in range(1, 30):
            rows += [(stream, stream, frame, d, 100.0 * d + rng.integers(0, 9), 0.0, 100.0 * d + 60, 60.0, float(rng.choice([0.05, 0.3, 0.9])), False, f"{stream}-{frame}-{d}") for d in range(30) if rng.random() < 0.6]
            if frame % 10 == 0:
                rows.append((stream, stream, frame, 99, 9e6 + 500 * frame, 0.0, 9e6 + 500 * frame + 40, 60.0, 0.9, False, f"{stream}-{frame}-99"))
    names = [*"abcdefghij", "kept"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    for high in (None, 0.5):
        run = lambda parts: [r for b in tracking._identified(3, high, 0.1)(parts) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]  # noqa: E731, B023
        want = run([whole])
        assert want == run([whole.slice(k, 7) for k in range(0, len(whole), 7)])
        assert all(r[5] == f"{r[1]}-{r[2]}-{r[3]}" for r in want) and len({r[4] for r in want}) > 30


def test_rows_of_a_frame_that_share_a_number_keep_their_own_columns(spark):
    rows = [box(1, f, 0, x, c) for f in (1, 2, 3) for x, c in ((0, 0.9), (500, 0.8))]
    got = tracking.live_tracks(spark.createDataFrame(rows, SCHEMA), max_age=3).select("frame_id", "track_id", "x1", "confidence").collect()
    assert len(got) == 6 and len({(r.track_id, r.x1, r.confidence) for r in got}) == 2


@pytest.mark.parametrize("name", ["sva_02_tracked_arrays", "trk_06_tracks_by_frame", "trk_08_counts", "trk_09_track_by_id"])
def test_queries_without_states_run_no_filter_and_join_no_boxes(spark, monkeypatch, name):
    from percepta import plans

    def refused(*_, **__):
        raise AssertionError("a filter whose states nobody reads")

    monkeypatch.setattr(tracking, "filter_tracks", refused)
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert len([line for line in plan.splitlines() if " Join " in line]) <= (2 if name.startswith("sva") else 1)
