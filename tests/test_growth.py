"""What must not grow with the size of a graph or of its coordinates: jobs, tasks' memory, shuffles; and the results that go with it."""

import numpy as np
from pyspark.sql import functions as F

from meshlark.operators import hierarchy


def _jobs(spark, f):
    group = f"jobs-{id(f)}"
    spark.sparkContext.setJobGroup(group, "count")
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


def test_balls_take_no_job_for_each_step(spark):
    e = spark.range(1, 200).selectExpr("id as src", "id + 1 as dst", "cast(1 + id % 3 as double) as w")
    s = spark.range(1, 201, 20).selectExpr("id as s").union(spark.createDataFrame([(999,)], "s bigint"))  # one without edges
    near, jobs = _jobs(spark, lambda: {tuple(r) for r in hierarchy.within(e, s, 64.0).collect()})
    assert near == {(a, v) for a in range(1, 201, 20) for v in range(1, 201) if abs(a - v) <= 64} | {(999, 999)}
    assert jobs < 30
    at = np.concatenate([[0.0, 0.0], np.cumsum(1 + np.arange(1, 200) % 3)])
    near = {tuple(r) for r in hierarchy.within(e, s, 30.5, weighted=True).collect()}
    assert near == {(a, v) for a in range(1, 201, 20) for v in range(1, 201) if abs(at[a] - at[v]) <= 30.5} | {(999, 999)}


def test_balls_are_halved_where_they_are_large(spark, monkeypatch):
    from meshlark.operators import paths

    monkeypatch.setattr(paths, "TASK_CELLS", 50)
    a = np.arange(39)
    src, dst = np.concatenate([a, a + 1]), np.concatenate([a + 1, a])
    order = np.lexsort((dst, src))
    start, to = np.searchsorted(src[order], np.arange(41)), dst[order]
    cell = paths._ball(start, to, np.ones(len(to)), np.arange(0, 40, 3), 10.0)
    assert {(c // 40 * 3, c % 40) for c in cell.tolist()} == {(s, v) for s in range(0, 40, 3) for v in range(40) if abs(s - v) <= 10}


def test_long_edges_are_not_spread_over_cells(spark, monkeypatch):
    from meshlark.operators import quality

    written, before = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, what, *a: written.append(what) or before(df, what, *a))
    monkeypatch.setattr(quality, "STRIPE_EDGES", 100, raising=False)
    rng, n = np.random.default_rng(3), 150
    x = {s: np.concatenate([rng.normal(size=(n - 20, 2)), rng.integers(0, 3, size=(20, 2))]) for s in (1, 2)}  # some points coincide or lie on a line
    e = [(i, i + k) for i in range(n) for k in (1, 7) if i + k < n] + [(5, 5), (9, 8)]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = {}
    for s, p in x.items():
        o = lambda a, b, c: turn(p[a], p[b], p[c])  # noqa: B023, E731
        far = [((a, b), (c, d)) for k, (a, b) in enumerate(e) for c, d in e[:k] if not {a, b} & {c, d}]
        want[s] = sum(all(abs(y) > 1e-12 for y in (o(a, b, c), o(a, b, d), o(c, d, a), o(c, d, b))) and (o(a, b, c) > 0) != (o(a, b, d) > 0) and (o(c, d, a) > 0) != (o(c, d, b) > 0) for (a, b), (c, d) in far)
    c = spark.createDataFrame([(s, v, p.tolist()) for s, y in x.items() for v, p in enumerate(y)], "seed int, v bigint, x array<double>")
    edges = spark.createDataFrame(e, "src bigint, dst bigint")
    assert {r.seed: r.edge_crossings for r in quality.crossings(edges, c, ("seed",)).collect()} == want
    assert quality.crossings(edges, c.where("seed = 1")).first()[0] == want[1]
    assert "cells" not in written


def test_lattice_regions_follow_from_runs(spark):
    from meshlark.operators import triangulated

    # Two rings apart, the outer of more points; rows are cut into several runs, and the inner ring goes.
    keep = lambda x, y: ((x * x + y * y <= 1) & (x * x + y * y >= 0.6)) | ((x * x + y * y <= 0.3) & (x * x + y * y >= 0.1))
    e, c = triangulated.lattice_region(spark, (-1.0, 1.0, -1.0, 1.0), 1 / 12, keep)
    points = {r.v: tuple(r.x) for r in c.collect()}
    s, high = 1 / 12, 1 / 12 * 3**0.5 / 2
    every = [(-1 - s + s * (i + 0.5 * (r % 2)), -1 - high + high * r) for r in range(60) for i in range(40)]
    want = [p for p in every if p[1] <= 1 + high and 0.6 <= p[0] ** 2 + p[1] ** 2 <= 1]
    assert sorted(points) == list(range(1, len(want) + 1))
    np.testing.assert_allclose([points[v] for v in sorted(points)], want, atol=1e-12)
    x = np.array([points[v] for v in sorted(points)])
    near = {(i + 1, j + 1) for i, j in np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) < 1.2 * s).tolist() if i < j}
    assert {(min(r.src, r.dst), max(r.src, r.dst)) for r in e.collect()} == near and e.count() == len(near)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_cube_surfaces_have_the_sizes_of_other_lattices():
    from meshlark.operators import families

    assert {p.name: p for p in families.FAMILIES["cube_surface"].params}["side"].check(6005) == 6005


def test_edges_are_shuffled_as_often_in_large_tables_as_in_small_ones():
    from meshlark.operators import quality

    assert quality._edge_stripes(40_000) == quality._edge_stripes(400_000) == quality._edge_stripes(3_000_000)
    assert quality._edge_stripes(1) == 1


def test_meetings_run_side_by_side_and_by_matchings(spark):
    from meshlark.operators import mds

    rng, n, cut = np.random.default_rng(5), 90, 40
    i, j = (c.ravel() for c in np.triu_indices(n, 1))
    i, j = np.concatenate([i, i[:7], j[:3]]), np.concatenate([j, j[:7], i[:3]])  # some pairs come again, also with their ends changed
    order = np.lexsort((np.maximum(i, j), np.minimum(i, j)))
    i, j = i[order], j[order]
    z = rng.normal(size=(n, 3))
    t, w = np.sqrt(((z[i] - z[j]) ** 2).sum(axis=1)), np.full(len(i), 0.05)
    order, starts = mds.matchings(n, cut, i, j, rng)
    assert sorted(order.tolist()) == list(range(len(i))) and len(starts) < len(i) / 8
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        ends = np.concatenate([i[order[a:b]], j[order[a:b]]])
        assert len(set(ends.tolist())) == len(ends)
    x = z + 0.01 * rng.random((n, 3))
    y = x.tolist()
    mds.sgd_runs(x, order, starts, i, j, t, w, w, rng)
    mds.sgd_pass(y, order.tolist(), i.tolist(), j.tolist(), t.tolist(), w.tolist(), w.tolist(), rng)
    np.testing.assert_allclose(x, y, atol=1e-12)
    same = np.zeros((n, 2))  # all at one point: each pair goes apart by a drawn direction
    mds.sgd_runs(same, order, starts, i, j, t, w, w, rng)
    assert np.isfinite(same).all() and len(np.unique(same, axis=0)) == n

    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    p = spark.createDataFrame([(a, b, float(d[a, b])) for a in range(n) for b in range(a)], "i bigint, j bigint, d double")
    spark.sparkContext.setJobGroup("meetings", "count")
    got, _, _ = mds.sgd_tables(p, 2, mds.SgdControl(epochs=2), blocks=6, traced=False)
    spark.sparkContext.setJobGroup("rest", "rest")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for k in tracker.getJobIdsForGroup("meetings") for s in tracker.getJobInfo(k).stageIds}
    assert got.count() == n
    assert [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)].count(12) >= 2 * 5  # of each round
    c, (i, j) = mds.SgdControl(epochs=12), np.triu_indices(n, 1)
    kernel, _ = mds.sgd_kernel(n, i, j, d[i, j], np.ones(len(i)), np.ones(len(i)), 2, c)
    mine = np.array([r.x for r in mds.sgd_tables(p, 2, c, blocks=2, traced=False)[0].orderBy("v").collect()])
    stress = [1 - (o @ d[i, j]) ** 2 / (o @ o) / (d[i, j] @ d[i, j]) for o in (np.sqrt(((q[i] - q[j]) ** 2).sum(axis=1)) for q in (mine, kernel.coords))]
    assert stress[0] <= 1.1 * stress[1]


def test_nearest_rows_are_found_once_and_rows_assigned_once(spark, monkeypatch):
    from meshlark.operators import blocks, knn

    found, calls, searched, assigned = [], [], blocks.searched, blocks.assigned
    monkeypatch.setattr(blocks, "searched", lambda *a, **k: found.append(searched(*a, **k)) or found[-1])
    monkeypatch.setattr(blocks, "assigned", lambda *a: calls.append(1) or assigned(*a))
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(60, 2)), np.concatenate([rng.normal(size=(100, 2)), np.zeros((300, 2))])  # 300 copies
    s, t = (spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "v bigint, x array<double>") for x in (a, b))
    got = {r.v: r.d for r in knn.nearest(s, t, block=64).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    np.testing.assert_allclose([got[k] for k in range(60)], want, atol=1e-12)
    assert found[0].groupBy("v").count().agg({"count": "max"}).first()[0] <= blocks.STRIPES  # one of a pair of stripes, whatever ties
    assert len(calls) == 2


def test_pairs_of_blocks_come_to_a_task_few_at_a_time(spark, monkeypatch):
    from meshlark.operators import blocks, quality

    sizes, calls, before, assigned = [], [], quality.materialize, blocks.assigned

    def watched(df, what, *a, **k):
        if what == "surface":
            seen = before(df.sparkSession.range(0, 500, 1, 1).mapInPandas(lambda parts: (p.assign(id=len(p)) for p in parts), "id bigint"), "seen", *a, **k)
            sizes.append(seen.agg({"id": "max"}).first()[0])
        return before(df, what, *a, **k)

    monkeypatch.setattr(quality, "materialize", watched)
    monkeypatch.setattr(blocks, "assigned", lambda *a: calls.append(1) or assigned(*a))
    rng = np.random.default_rng(9)
    x, tri = rng.normal(size=(50, 3)), rng.normal(size=(40, 3, 3))
    p = spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "id bigint, x array<double>")
    got = {r.id: r.d for r in quality.surface_distance(p, quality.face_table(spark, tri), block=8).collect()}
    np.testing.assert_allclose([got[k] for k in range(50)], quality.point_triangle(x, tri), atol=1e-12)
    assert sizes == [quality.PAIR_ROWS] and len(calls) == 2

def test_crossings_of_runs_do_not_depend_on_the_number_of_edges(spark):
    from meshlark.operators import compare

    n = 501  # rungs of a ladder: two long edges of each run cross, and there are more than 1000 edges
    e = [(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(n)] + [(2000, 2001), (2002, 2003)]
    x = [(i, [float(i), 0.0]) for i in range(n + 1)] + [(1000 + i, [float(i), 9.0]) for i in range(n + 1)] + [(2000, [0.0, 3.0]), (2001, [9.0, 6.0]), (2002, [0.0, 6.0]), (2003, [9.0, 3.0])]
    layouts = spark.createDataFrame([("a", 1, "ok", None, v, p) for v, p in x], "candidate string, seed int, status string, error_message string, v bigint, x array<double>")
    pairs = spark.createDataFrame([(0, 5, 5.0), (3, 1003, 9.0)], "i bigint, j bigint, d double")
    edges = spark.createDataFrame(e, "src bigint, dst bigint")
    assert len(e) > 1000 and compare.score_runs(layouts, edges, pairs, pairs.select("i", "j")).first()["edge_crossings"] == 1
    assert compare.score_runs(layouts, edges, pairs, pairs.select("i", "j"), count_crossings=False).first()["edge_crossings"] is None


def test_kernels_take_a_task_each_and_graphs_of_any_size(spark):
    from meshlark.operators import layout
    from meshlark.operators.layout import AdjacencyIndex

    assert not hasattr(layout, "MAX_KERNEL_VERTICES")
    e = spark.range(1, 12).selectExpr("id as src", "id + 1 as dst")
    x = layout.multiscale(e, spark.range(1, 13).withColumnRenamed("id", "v"), [{"rounds": 2, "final": 3, "seed": k} for k in range(3)])
    tasks = [r[0] for r in x.selectExpr("spark_partition_id() as task", "run").distinct().select("task").collect()]
    assert len(tasks) == len(set(tasks)) == 3
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 60, size=(2, 90))
    near = AdjacencyIndex(60, u, v, np.ones(90))  # rings of hops are what lengths of 1 give
    want = np.arange(60) % 3 == 0
    for root in range(60):
        assert near.near(root, False, 3.0) == near.near(root, True, 3.0)
        assert near.near(root, False, want=want, count=4) == near.near(root, True, want=want, count=4)


def test_layouts_of_neighbour_graphs_take_all_rounds():
    import inspect

    from meshlark import registry

    assert "rounds" not in inspect.getsource(registry.QUERIES["multiscale_layout_knn"])


def test_farthest_landmarks_may_weigh_ids_by_steps(spark):
    from meshlark.operators import pivots

    d = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3000, 7), (1, 3001, 7), (2, 10, 4), (2, 20, 4)], "s bigint, v bigint, d int")
    assert {r.s: r.v for r in pivots.farthest_landmarks(d, 1).collect()} == {1: 3000, 2: 10}
    assert {r.s: r.v for r in pivots.farthest_landmarks(d, 1, steps=1000).collect()} == {1: 2, 2: 10}  # 5000 - 2 is more than 7000 - 3000


def test_path_counts_are_whole_numbers(spark):
    from math import comb

    from meshlark.operators import generators, paths

    e = generators.mesh(spark, 60, 6).withColumn("w", F.lit(1.0))
    got = {r.v: r.paths for r in paths.path_counts(e, paths.distances(e, spark.createDataFrame([(1,)], "s bigint"))).collect()}
    assert got == {i * 6 + j + 1: float(comb(i + j, j)) for i in range(60) for j in range(6)}


def _leafy(spark):
    """A ring of six with a chord, two leaves on one of its vertices and one on another; ids are not in the order of the ring. With distances by Floyd and Warshall."""
    e = [(3, 9, 1.0), (9, 4, 2.0), (4, 12, 1.5), (12, 7, 1.0), (7, 5, 0.5), (5, 3, 2.0), (3, 12, 4.0), (9, 1, 0.25), (9, 30, 0.75), (7, 2, 3.0)]
    ids = sorted({v for a, b, _ in e for v in (a, b)})
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in e:
        d[ids.index(a), ids.index(b)] = d[ids.index(b), ids.index(a)] = w
    for k in range(len(ids)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return spark.createDataFrame(e, "src bigint, dst bigint, w double"), spark.createDataFrame([(v,) for v in ids], "v bigint"), ids, d


def test_all_pairs_are_not_stored(spark, monkeypatch):
    from meshlark.operators import paths

    e, v, ids, d = _leafy(spark)
    written, before = [], paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, what, *a: written.append(what) or before(df, what, *a))
    got = paths.all_pairs(e, v)
    assert {(r.i, r.j): r.d for r in got.collect()} == {(a, b): d[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b}
    assert written == ["packed"] and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert paths.diameter_of(e, v).first()[0] == d.max()
    two = spark.createDataFrame([(8, 5, 2.0)], "src bigint, dst bigint, w double")
    assert [tuple(r) for r in paths.all_pairs(two, two.selectExpr("explode(array(src, dst)) as v")).collect()] == [(5, 8, 2.0)]
    for more in (v.union(spark.createDataFrame([(99,)], "v bigint")), v.unionByName(two.selectExpr("explode(array(src + 100, dst + 100)) as v"))):
        with np.testing.assert_raises(ValueError):
            paths.all_pairs(e.union(two.selectExpr("src + 100", "dst + 100", "w")) if more.count() > 10 else e, more)


def test_landmarks_centring_and_smacof_of_rows_in_tasks(spark):
    from meshlark.operators import mds, paths, pivots

    e, v, ids, d = _leafy(spark)
    p = paths.all_pairs(e, v)
    rows = p.selectExpr("i as s", "j as v", "d").union(p.select("j", "i", "d")).union(v.selectExpr("v", "v", "0.0D"))
    want = pivots.landmark_pairs(rows, pivots.farthest_landmarks(rows, 1), 3)
    assert {tuple(r) for r in pivots.landmark_pairs_of(e, v, 3).collect()} == {tuple(r) for r in want.collect()}
    b = {(r.r, r.c): r.b for r in mds.double_centred_of(e, v).collect()}
    assert b.keys() == {(i, j) for i in ids for j in ids}
    assert all(abs(b[r.r, r.c] - r.b) < 1e-9 for r in mds.double_centred(p, v).collect())
    x = spark.createDataFrame([(i, [float(i % 4), float(i % 3)]) for i in ids[2:]], "v bigint, x array<double>")  # not all have coordinates, and some coincide
    want = {r.v: r.x for r in mds.smacof_step(p, x).collect()}
    got = {r.v: r.x for r in mds.smacof_step_of(e, v, x).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_sgd_of_all_pairs_has_no_limit(spark, monkeypatch):
    from meshlark import registry
    from meshlark.operators import mds

    monkeypatch.setattr(mds, "MAX_KERNEL_PAIRS", 10)
    assert [tuple(r) for r in registry.QUERIES["metric_mds_sgd"](spark, "/root/testdata/sf0.001").collect()] == [(True, 28)]
