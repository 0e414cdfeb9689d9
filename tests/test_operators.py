import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import catalogue, compare, generators, graph, hierarchy, knn, layout, mds, objectives, paths, pivots, quality
from meshlark.plans import shared
from meshlark.sources import readers


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src bigint, dst bigint, w double")


def coords(spark, x):
    return spark.createDataFrame([(k + 1, [float(c) for c in p]) for k, p in enumerate(x)], "v bigint, x array<double>")


def test_pivots_of_weighted_path(spark):
    e = edges(spark, [(k + 1, k + 2, w) for k, w in enumerate([1, 2, 1, 3, 2, 1])])
    d = {(r.pivot, r.v): r.d for r in pivots.graph_distances(e, pivots.pivot_table(spark, [6, 2])).collect()}
    at = np.cumsum([0, 1, 2, 1, 3, 2, 1])
    assert d == {(p, v): float(abs(at[p - 1] - at[v - 1])) for p in (6, 2) for v in range(1, 8)}


def test_region_ties_go_to_the_first_pivot(spark):
    e = generators.cycle(spark, 4).withColumn("w", F.lit(1.0))
    r = {x.v: x.owner for x in pivots.regions(pivots.graph_distances(e, pivots.pivot_table(spark, [3, 1]))).collect()}
    assert [r[k] for k in range(1, 5)] == [1, 3, 3, 3]


def test_long_edge_keeps_its_length(spark):
    e = edges(spark, [(1, 2, 1), (1, 3, 9), (2, 3, 1)])
    d = pivots.graph_distances(e, pivots.pivot_table(spark, [1, 2, 3]))
    c = {(r.i, r.j): r for r in pivots.constraints(e, d).collect()}
    assert c[1, 3].target == 9.0 and len(c) == 3 and c[1, 3].count_i == 1.0


def test_all_pivots_give_all_pairs(spark):
    e = generators.cycle(spark, 6).withColumn("w", F.lit(1.0))
    c = pivots.constraints(e, pivots.graph_distances(e, pivots.pivot_table(spark, [1, 2, 3, 4, 5, 6])))
    assert c.count() == 15 and c.where("count_i <> 1 or count_j <> 1").count() == 0
    with pytest.raises(ValueError):
        pivots.pivot_table(spark, [1, 1])


def test_crossing_and_scale_invariant_stress(spark):
    x = coords(spark, [(0, 0), (1, 1), (0, 1), (1, 0)])
    assert quality.crossings(edges(spark, [(1, 2, 1), (3, 4, 1)]), x).first()[0] == 1
    p = coords(spark, [(i, math.sin(i)) for i in range(1, 9)])
    d = spark.createDataFrame([(i, j, float(j - i)) for i in range(1, 9) for j in range(i + 1, 9)], "i bigint, j bigint, d double")
    s = [quality.sampled_stress(d.select("i", "j"), d, c).first()[0] for c in (p, p.select("v", F.transform("x", lambda a: a * 7.5).alias("x")))]
    assert abs(s[0] - s[1]) < 1e-12


def test_bad_graphs_are_refused(spark):
    bad = [[(0, 1, 1)], [(1, 1, 1)], [(1, 2, 0)], [(1, 2, math.inf)], [(1, 9, 1)]]
    for rows in bad:
        with pytest.raises(ValueError):
            graph.Graph.build(edges=edges(spark, rows), n=5)
    with pytest.raises(ValueError):
        graph.Graph.build()
    adj = spark.createDataFrame([(1, [(2, 1.0)]), (2, [(1, 2.0)])], "v bigint, nbrs array<struct<u: bigint, w: double>>")
    with pytest.raises(ValueError, match="lengths"):
        graph.Graph.build(adj=adj)
    with pytest.raises(ValueError, match="limit"):
        shared.guard_all_pairs(10**6)


def test_sgd_step_by_hand():
    x = np.array([(0.0, 0, 1), (4, 2, 3), (1, -2, 4)])
    y = x.copy()
    mds.sgd_epoch(y, np.array([0, 1]), np.array([1, 2]), np.array([2.0, 3]), np.array([0.0, 3]), np.array([0.2, 1]), 0.5, None)
    z = x.copy()
    for a, b, t, wi, wj in ((0, 1, 2.0, 0.0, 0.2), (1, 2, 3.0, 3.0, 1.0)):
        g = z[a] - z[b]
        d = np.linalg.norm(g)
        u, m = g / d, (d - t) / 2
        z[a] -= min(0.5 * wi, 1) * m * u
        z[b] += min(0.5 * wj, 1) * m * u
    assert np.allclose(y, z) and (y[0] == x[0]).all()


def test_continuation_equals_one_run():
    i, j = np.triu_indices(8, 1)
    t, w = np.abs(i - j).astype(float), np.ones(len(i))
    c = mds.SgdControl(epochs=12)
    whole, why = mds.sgd_kernel(8, i, j, t, w, w, 2, c)
    half, _ = mds.sgd_kernel(8, i, j, t, w, w, 2, c, upto=5)
    rest, _ = mds.sgd_kernel(8, i, j, t, w, w, 2, c, state=mds.SgdState.load(half.dump()))
    assert (whole.coords == rest.coords).all() and why == "iteration_limit" and len(rest.trace) == 12
    with pytest.raises(ValueError):
        mds.SgdState.load(half.dump().replace('"version": 1', '"version": 2'))


def numeric(energy, x, h=1e-6):
    g = np.zeros_like(x)
    for k in np.ndindex(*x.shape):
        a, b = x.copy(), x.copy()
        a[k] += h
        b[k] -= h
        g[k] = (energy(a) - energy(b)) / (2 * h)
    return g


def test_gradients_and_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 2))
    u, v, w = np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 5]), np.array([1.0, 2, 1, 1.5, 1])
    far = (np.array([0, 1, 2]), np.array([3, 4, 5]))
    paths_ = layout.PathTable(np.array([3.0, 3.5]), np.array([0, 2, 4]), np.array([0, 1, 1, 2]), np.array([1, 2, 2, 3]), np.ones(4))
    for energy, gradient, *_ in (
        layout.edge_objective(u, v, w, np.ones(5), 1.0), layout.edge_objective(u, v, w, np.ones(5)), layout.geodesic_objective(paths_), layout.repulsive_objective(u, v, w, *far, 0.3),
        layout.repulsive_objective(u, v, w, *far, 0.3, power=2.0), layout.gram_objective(u[1:], u[:-1], v[1:], w[1:], w[:-1], np.full(4, 0.3), np.ones(4)),
    ):
        assert np.allclose(gradient(x), numeric(energy, x), atol=1e-4)
        _, trace, _ = layout.armijo(x, energy, gradient, 20)
        assert all(b <= a for a, b in zip(trace, trace[1:], strict=False))


def test_edge_energy_matches_kernel(spark):
    x = np.random.default_rng(1).normal(size=(5, 2))
    rows = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 5, 1.5)]
    e = objectives.edge_energy(edges(spark, rows), coords(spark, x)).first()
    u, v, w = (np.array(c) for c in zip(*rows, strict=True))
    energy, _ = layout.edge_objective(u - 1, v - 1, w, np.ones(4))
    assert abs(e.energy - energy(x)) < 1e-9


def test_procrustes_and_surface(spark):
    x = np.array([(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3)], float)
    z = 2 * x @ np.diag([-1.0, 1, 1]) + [3, 4, 5]
    r = quality.score_coordinates(coords(spark, x), coords(spark, z)).first()
    assert abs(r.scale - 0.5) < 1e-9 and r.rmse < 1e-6
    assert quality.score_coordinates(coords(spark, x), coords(spark, z), reflection=False).first().rmse > 0.1
    assert abs(quality.score_coordinates(coords(spark, x), coords(spark, x + 1), "none").first().rmse - math.sqrt(3)) < 1e-9
    with pytest.raises(ValueError):
        quality.align(coords(spark, x), coords(spark, x * 0), "similarity")
    tri = np.array([[(0, 0, 0), (1, 0, 0), (0, 1, 0)]], float)
    got = quality.point_triangle(np.array([(0.2, 0.3, 2), (0.8, 0.8, 0), (-1, -1, 0), (0.5, -1, 1), (0, 0, 0)], float), tri)
    assert np.allclose(got, [2, math.sqrt(0.18), math.sqrt(2), math.sqrt(2), 0])
    with pytest.raises(ValueError):
        quality.check_mesh(np.zeros((3, 3)), np.array([[1, 1, 2]]))


def test_tie_average_of_a_square(spark):
    e = generators.cycle(spark, 4).withColumn("w", F.lit(1.0))
    s = spark.createDataFrame([(1,), (3,)], "s bigint")
    c = paths.tie_average(e, paths.distances(e, s), spark.createDataFrame([(1, 3)], "i bigint, j bigint"))
    assert sorted((r.u, r.v, r.coeff) for r in c.collect()) == [(1, 2, 0.5), (1, 4, 0.5), (2, 3, 0.5), (3, 4, 0.5)]


def test_small_hierarchy_has_one_level(spark):
    m = hierarchy.misf(generators.path(spark, 5).withColumn("w", F.lit(1.0)), spark.range(1, 6).withColumnRenamed("id", "v"), 8)
    assert {r.level for r in m.collect()} == {0}


def test_layout_repeats_and_improves():
    ids = np.arange(20)
    e = np.array([(k, k + 1) for k in range(19)])
    p = layout.LayoutParams.of(rounds=10, final=60, num_init=6)
    a, b = (layout.layout_graph(ids, e, np.ones(19), p) for _ in range(2))
    assert (a == b).all() and np.isfinite(a).all()
    i, j = np.triu_indices(20, 1)
    assert np.corrcoef(np.linalg.norm(a[i] - a[j], axis=1), j - i)[0, 1] > 0.8
    two = layout.layout_graph(np.arange(8), np.array([(0, 1), (1, 2), (3, 4), (5, 6)]), np.ones(4), p)
    assert two.shape == (8, 2) and np.isfinite(two).all()
    with pytest.raises(ValueError):
        layout.LayoutParams.of(preset="nope")


def test_search_grid_and_ranking(spark):
    c = compare.expand_search("mesh", {"preset": "mesh"}, {"final": [96, 128], "num_nbrs": [16, 20], "repulsion": [1, 1.5]})
    assert len(c) == 8 and all(k.startswith("mesh.search") for k in c)


def test_sequential_pruning_keeps_the_graph_together():
    e = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.9), (3, 4, 5.0)]
    assert knn.prune_geometric_sequential(e, 0.2, 0.5) == [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 5.0)]


def test_readers_and_catalogue(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 3 5\n1 2 1\n2 1 1\n3 3 4\n2 3 1\n2 3 -1\n")
    assert [tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()] == [(1, 2)]
    (tmp_path / "e.tsv").write_text("vertex_id\tx\ty\nv2\t2\t0\nv1\t1\t0\nv3\t3\t0\n")
    d, key = readers.read_embedding(spark, str(tmp_path / "e.tsv"))
    v = spark.createDataFrame([(1, "v1"), (2, "v2"), (3, "v3")], "v bigint, name string")
    assert catalogue.best_key(v, d.select(F.col(key).alias("id")), ["v", "name"]) == "name"
    assert [r.x for r in catalogue.align_embedding(v, d, "name", key).orderBy("v").collect()] == [1.0, 2.0, 3.0]
    names = spark.createDataFrame([("HB/a", "a"), ("HB/b", "b"), ("X/b", "b")], "id string, name string")
    assert catalogue.resolve(names, "a").first().id == "HB/a"
    for wrong in ("b", "zzz"):
        with pytest.raises(ValueError):
            catalogue.resolve(names, wrong)
    with pytest.raises(ValueError):
        catalogue.validate(spark.createDataFrame([("x",), ("x",)], "layout_id string"))


def test_classical_mds_by_power_iteration_equals_the_kernel(spark):
    v = spark.range(1, 21).withColumnRenamed("id", "v")
    rows = [(i, j, float(min(j - i, 20 - j + i))) for i in range(1, 21) for j in range(i + 1, 21)]
    cycle = spark.createDataFrame(rows, "i bigint, j bigint, d double")
    small, large = (mds.classical(cycle, v, driver_limit=n) for n in (3000, 5))
    assert np.allclose(small[1], large[1], rtol=1e-5)
    a, b = ({(r.i, r.j): r.o for r in objectives.observed(cycle, x).collect()} for x, _ in (small, large))
    assert all(abs(a[k] - b[k]) < 1e-3 for k in a)
    two = spark.createDataFrame([(i, j, 1.0 if (i + j) % 2 else 2.0) for i, j, _ in rows], "i bigint, j bigint, d double")
    x, val = mds.classical(two, v, driver_limit=5)  # the eigenvalue of greatest magnitude is -13, the greatest is 2
    assert np.allclose(val, [2, 2], atol=1e-4)
    line = spark.createDataFrame([(i, j, float(j - i)) for i, j, _ in rows], "i bigint, j bigint, d double")
    x, val = mds.classical(line, v, driver_limit=5)
    assert abs(val[0] - 665) < 1e-3 and all(abs(r.o - r.d) < 1e-4 for r in objectives.observed(line, x).collect())
