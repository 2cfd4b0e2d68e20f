"""Queries on tables beyond the caps of their operators, and trackers and clouds whose work must grow with their rows."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from percepta import plans, shared
from percepta.operators import grids, neighbours, spatial


def test_an_episode_of_a_long_buffer_is_kept(spark, tmp_path):
    n = 330_000  # 110,000 transitions in each of three buffers
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 33_000).alias("o_custkey"), F.timestamp_seconds(F.col("id") * 60).alias("o_orderdate"), F.lit(5.0).alias("o_totalprice"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, plans.queries()["iml_03_episode"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(duck.sql(plans.oracle_sql()["iml_03_episode"]).fetchall()) and len(got) == 30


def test_stencils_cross_blocks_and_shuffle_cells_once(spark):
    rng = np.random.default_rng(5)
    n = 300  # three blocks a side
    cells = {(c, int(x), int(y)): float(v) for c in (1, 2) for (x, y), v in zip(np.concatenate([rng.integers(0, n, (400, 2)), rng.integers(120, 136, (900, 2)), rng.integers(n - 9, n, (200, 2))]), rng.uniform(0.1, 2, 1500), strict=True)}
    df = spark.createDataFrame([(*k, None if k[1:] == (128, 128) else v) for k, v in cells.items()], "cloud_id long, gx int, gy int, value double").repartition(3)
    cells = {k: None if k[1:] == (128, 128) else v for k, v in cells.items()}
    for k in (3, 5):
        off, grid = spatial.offsets(k), grids.Grid(float(n), 1.0)
        wide: dict = {}
        for (c, x, y), v in cells.items():
            for i, j in ((x + i, y + j) for i in off for j in off):
                if 0 <= i < n and 0 <= j < n:
                    wide.setdefault((c, i, j), []).append(v)
        most = {p: max((v for v in vs if v is not None), default=None) for p, vs in wide.items()}
        made = grids.dilated(df, grid, k)
        assert {(r.cloud_id, r.gx, r.gy): r.value for r in made.collect()} == most
        least = {}
        for c, x, y in {(c, x - i, y - j) for c, x, y in most for i in off for j in off}:
            around = [(c, x + i, y + j) for i in off for j in off if 0 <= x + i < n and 0 <= y + j < n]
            if 0 <= x < n and 0 <= y < n and all(p in most for p in around):
                if there := [most[p] for p in around if most[p] is not None]:
                    least[c, x, y] = min(1.0, *there)
        narrow = grids.eroded(made, grid, k)
        assert {(r.cloud_id, r.gx, r.gy): r.value for r in narrow.collect()} == least and len(least) > 300
        # Cells aren't copied for each of their neighbours.
        assert "sx" not in narrow._jdf.queryExecution().optimizedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 1, (60, 3)))], "cloud_id long, pt_idx long, x double, y double, z double")
    for made in (spatial.near_pairs(p, 0.3), spatial.clusters(p, 0.3, 3), neighbours.nearest(p, 3), neighbours.normals(p, 3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        last = [line for line in plan.splitlines() if "Join" in line][0]
        assert "SortMergeJoin" in last and made.count()


def test_near_pairs_of_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(-9, 9, (900, 3)), rng.normal(0, 0.4, (500, 3)), rng.integers(-9, 9, (300, 3)).astype(float), [[1.0, 1.0, 1.0]] * 3])
    df = spark.createDataFrame([(k, i, *map(float, v)) for k in (1, 2) for i, v in enumerate(p + k)], "cloud_id long, pt_idx long, x double, y double, z double").repartition(3)
    for rows, share in ((256, 2048), (256, 40), (0, 2048), (10_000, 2048)):  # some, some and cells dealt, all and no blocks by cells
        got = [(r.cloud_id, r.a, r.b) for r in spatial.near_pairs(df, 1.0, share, rows).collect()]
        want = set()
        for k in (1, 2):
            q = p + k
            d = np.sqrt(((q[:, None] - q[None]) ** 2).sum(2))
            want |= {(k, int(a), int(b)) for a, b in zip(*np.nonzero((d > 0) & (d < 1.0)), strict=True) if a < b}
        assert len(got) == len(set(got)) and set(got) == want


def test_sparse_clouds_cross_about_three_times(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i % 20, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 40, (6000, 3)))], "cloud_id long, pt_idx long, x double, y double, z double")
    join = spatial.near_pairs(p, 1.0)._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    of = spark._jvm.org.apache.spark.sql.classic.Dataset
    rows = [of.ofRows(spark._jsparkSession, join.children().apply(k)).count() for k in (0, 1)]
    assert rows[0] == 6000 and rows[1] < 3 * 6000


def _lookup_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_beyond_the_bound_is_merged_and_repeated_for_crowded_keys_only(spark, monkeypatch):
    table = shared.written(spark.range(300).select(F.when(F.col("id") < 299, F.col("id")).alias("k"), (F.col("id") * 2).alias("v")), "table")
    left = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 400)).cast("long").alias("k"), F.col("id").alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(F.broadcast(table), "k", how).fillna(-1).collect()))
        plain = shared.lookup_join(left, table, ["k"], how, most_rows=10)
        assert "Broadcast" not in _lookup_plan(plain) and sorted(map(tuple, plain.fillna(-1).collect())) == want
        with monkeypatch.context() as m:
            m.setattr(shared, "CROWD", 100)
            dealt = shared.lookup_join(left, table, ["k"], how, most_rows=10)
            assert "SortMergeJoin" in _lookup_plan(dealt) and sorted(map(tuple, dealt.fillna(-1).collect())) == want
            # Key 5 alone is in 32 shares.
            known = shared.lookup_join(left, table, ["k"], how, most_rows=10, crowded=spark.createDataFrame([(5,)], "k long"))
            assert sorted(map(tuple, known.fillna(-1).collect())) == want
            rows = []
            monkeypatch.setattr(shared, "large", lambda d: rows.append(d) or d.hint("merge"))
            shared.lookup_join(left, table, ["k"], how, most_rows=10)
            shares = {r.k: r.n for r in rows[-1].groupBy("k").agg(F.countDistinct("salt").alias("n")).collect()}
            assert shares[5] == 32 and shares[None] == 32 and max(n for k, n in shares.items() if k not in (5, None)) == 1


def test_components_and_leaves_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """With a bound of no rows nothing that grows goes through the driver."""
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(1 + i % 2, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 1, (400, 3)))], "cloud_id long, pt_idx long, x double, y double, z double")
    edges = spark.createDataFrame([(int(a), int(a) - int(rng.integers(1, 4))) for a in range(4, 300)], "a long, b long")
    want_near, want_parts = (sorted(map(tuple, d.collect())) for d in (neighbours.nearest(p, 3, 16), shared.connected_components(edges)))
    plans_of, write = [], shared.written
    monkeypatch.setattr(shared, "fits", lambda *_: False)
    for module in (shared, neighbours):
        monkeypatch.setattr(module, "written", lambda d, *a: plans_of.append(_lookup_plan(d)) or write(d, *a))
    assert sorted(map(tuple, neighbours.nearest(p, 3, 16).collect())) == want_near
    assert sorted(map(tuple, shared.connected_components(edges).collect())) == want_parts
    assert len(plans_of) > 10 and not any("Broadcast" in x for x in plans_of)


def test_verdicts_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """op7: neither rules nor verdicts, which grow with the URLs, go through the driver."""
    from percepta.llm import url_rules

    rules = spark.createDataFrame([("com", "/en/", "block"), ("a.com", "/en/7", "allow")], "host string, path string, verdict string")
    urls = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 3 > 0, "a.com/en/7").otherwise(F.concat(F.lit("h"), F.col("id"), F.lit(".com/en/")))).alias("url"))
    want = sorted(map(tuple, url_rules.filter_urls(urls, rules).collect()))
    monkeypatch.setattr(shared, "CROWD", 100)
    got = url_rules.filter_urls(urls, rules, most_rules=0, most_verdicts=0)
    plan = _lookup_plan(got)
    # Only the crowded keys are sent.
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= 2
    assert sorted(map(tuple, got.collect())) == want and {r[-1] for r in want} == {"allow", "block"}


def test_normals_and_clusters_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 1, (90, 3)))], "cloud_id long, pt_idx long, x double, y double, z double")
    plans_of, write = [], shared.written
    monkeypatch.setattr(shared, "fits", lambda *_: False)
    for module in (shared, neighbours, spatial):
        monkeypatch.setattr(module, "written", lambda d, *a: plans_of.append(_lookup_plan(d)) or write(d, *a))
    for make in (lambda: neighbours.normals(p, 4), lambda: spatial.clusters(p, 0.2, 3)):
        made, found = make(), [*plans_of]
        assert len(found) > 5 and not any("Broadcast" in x for x in [*found, _lookup_plan(made)]) and made.count()
        plans_of.clear()


def test_components_of_detections_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """The nodes of a gate, chained over 200 frames in each of two streams."""
    node = lambda f: F.struct((F.col("id") % 2).alias("stream_id"), f.alias("frame_id"), F.lit(0).alias("det_idx"))
    step = F.floor(F.col("id") / 2)
    edges = spark.range(400).select(node(step + 1).alias("a"), node(step).alias("b")).repartition(8)
    plans_of, write = [], shared.written
    monkeypatch.setattr(shared, "fits", lambda *_: False)
    monkeypatch.setattr(shared, "written", lambda d, name, *a: plans_of.append((name, _lookup_plan(d))) or write(d, name, *a))
    got = {tuple(r.node): tuple(r.component) for r in shared.connected_components(edges, "gate").collect()}
    assert got == {(s, f, 0): (s, 0, 0) for s in (0, 1) for f in range(201)}
    assert sum(name == "gate-labels" for name, _ in plans_of) > 1 and not any("Broadcast" in x for _, x in plans_of)
