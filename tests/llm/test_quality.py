"""The quality classifier against a fit of its own in plain NumPy, over all documents of a small table."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from percepta.llm import quality, queries

DATA = "/root/testdata/sf0.001"


def plain_isotonic(x, y):
    """The isotonic fit by its max-min formula: each level is the largest, over starts, of the least mean that begins there."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    total = np.concatenate([[0.0], y.cumsum()])
    means = np.array([[(total[b + 1] - total[a]) / (b + 1 - a) if b >= a else np.inf for b in range(len(y))] for a in range(len(y))])
    return x, np.array([max(means[a, i:].min() for a in range(i + 1)) for i in range(len(y))])


def test_isotonic_equals_the_max_min_formula():
    rng = np.random.default_rng(4)
    x = rng.permutation(60) / 7.0
    y = (rng.random(60) < x / x.max()).astype(float)
    steps, levels = quality.isotonic(x, y)
    at, want = plain_isotonic(x, y)
    pools = np.unique(want)
    assert levels == pytest.approx(pools) and steps == pytest.approx([at[want == p].mean() for p in pools])


def test_scores_equal_a_plain_fit(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    labels = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{DATA}/labels.parquet' WHERE quality IS NOT NULL GROUP BY 1").fetchall())
    stats = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs}
    assert len(stats) == len(docs)
    ids = [i for i in stats if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    folds = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("f")).collect()}
    x, y, fold = np.array([stats[i] for i in ids]), np.array([labels[i] for i in ids], float), np.array([folds[i] for i in ids])
    assert 0 < y.sum() < len(y) and 0 < fold.sum() < len(fold)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(8)
    turn, shift = rng.standard_normal((x.shape[1], 256)) / 3.0, rng.uniform(0, 2 * np.pi, 256)

    def features(s):
        waves = np.sqrt(2 / 256) * np.cos(np.clip((s - centre) / spread, -6, 6) @ turn + shift)
        return np.hstack([waves, np.ones((len(s), 1))])

    def ridge(rows):
        # The same minimum as a least-squares problem with the penalty as further rows.
        strength = np.sqrt(1e-3 * rows.sum() * np.r_[np.ones(256), 1e-6])
        return np.linalg.lstsq(np.vstack([features(x[rows]), np.diag(strength)]), np.r_[y[rows], np.zeros(257)], rcond=None)[0]

    out = np.where(fold == 0, features(x) @ ridge(fold == 1), features(x) @ ridge(fold == 0))
    model = quality.QualityModel(centre, spread, turn, shift, ridge(np.ones(len(y), bool)), *quality.isotonic(out, y))
    want = dict(zip(stats, model.score(np.array(list(stats.values()))), strict=True))
    got = {r.doc_id: r for r in queries.queries()["op8_quality_classifier"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert [got[i].score for i in want] == pytest.approx(list(want.values()), abs=1e-5)
