"""Components that end, searches in pruned block pairs, trees, pruning in rounds, SGD by strata, layouts on tables: each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import blocks, components, generators, knn, layout, layout_tables, mds, quality


def coords(spark, x):
    return spark.createDataFrame([(k + 1, r) for k, r in enumerate(np.asarray(x, float).tolist())], "v bigint, x array<double>")


def clustered(seed=1, copies=20):
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + rng.normal(size=(30, 4)) for c in rng.normal(size=(10, 4)) * 20])
    return np.round(np.concatenate([x, x[:copies]]), 2)


def roots(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {a: find(a) for a in root}


@pytest.mark.parametrize("order", ["by id", "shuffled"])
def test_long_chains_end_in_few_levels(spark, monkeypatch, order):
    monkeypatch.setattr(components, "TASK_EDGES", 500)
    n = 60_000
    e = spark.range(1, n + 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    e = e.orderBy(F.xxhash64("a")) if order == "shuffled" else e
    got, levels = components.contraction(e)
    assert got.agg(F.count(F.lit(1)), F.max("component")).first()[:2] == (n + 1, 1)
    assert levels <= 20


def test_every_shape_of_component(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 5)
    rng = random.Random(5)
    e = [(k, k + 1) for k in range(300) if k % 100 != 99] + [(1000, k) for k in range(1001, 1090)] + [(k, 3000) for k in range(2000, 2040)]
    e += [(rng.randrange(4000, 4060), rng.randrange(4000, 4060)) for _ in range(50)] + [(9, 9), (None, 4), (5001, 5000), (5000, 5001)]
    rng.shuffle(e)
    got = components.components(spark.createDataFrame(e, "a bigint, b bigint").repartition(6))
    assert {r.id: r.component for r in got.collect()} == roots(e)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_components_are_numbered_by_their_smallest_vertex(spark):
    v = spark.range(1, 501).withColumnRenamed("id", "v")
    e = spark.createDataFrame([(3, 9, 1.0), (9, 400, 1.0), (7, 8, 1.0)], "src bigint, dst bigint, w double")
    got = {r.v: r.component for r in components.numbered(v, e).collect()}
    first = sorted({min(k for k in got if got[k] == c) for c in got.values()})
    assert got == {k: first.index(3 if k in (3, 9, 400) else 7 if k in (7, 8) else k) + 1 for k in range(1, 501)}
    assert sorted(r.v for r in components.largest(v, e).collect()) == [3, 9, 400]


@pytest.mark.parametrize(("metric", "block"), [("linf", 25), ("euclid", 512)])
def test_neighbours_come_from_fewer_block_pairs(spark, monkeypatch, metric, block):
    monkeypatch.setattr(blocks, "CELL_ROWS", 20)
    x, k = clustered(), 5
    got = {}
    for r in knn.knn(coords(spark, x), k, metric, block).collect():
        got.setdefault(r.v, []).append((r.rank, r.d, r.u))
    d = blocks.pairwise(x, x, metric)
    for i in range(len(x)):
        assert [q[1:] for q in sorted(got[i + 1])] == sorted((d[i, j], j + 1) for j in range(len(x)) if j != i)[:k]
    pairs, packed, _ = knn.knn_pairs(coords(spark, x), k, metric, block)
    assert pairs.count() < 0.6 * packed.count() ** 2
    with pytest.raises(ValueError, match="less than"):
        knn.knn(coords(spark, x[:3]), 3)


def tree_of(d):
    n, out, root = len(d), set(), list(range(len(d) + 1))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for _, a, b in sorted((d[i, j], i + 1, j + 1) for i in range(n) for j in range(i + 1, n)):
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            out.add((a, b))
    return out


def test_observation_tree_is_the_tree_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_ROWS", 25)
    x = clustered(3)
    c = coords(spark, x)
    near = knn.knn(c, 3, "euclid").select("v", "u", "d")
    got = {(r.src, r.dst) for r in knn.observation_tree(c, near, "euclid").collect()}
    assert got == tree_of(blocks.pairwise(x, x, "euclid"))


def test_repair_joins_the_parts_of_a_neighbour_graph(spark):
    x = np.unique(clustered(4, 0), axis=0)
    g = knn.connected_knn_graph(coords(spark, x), 3)
    assert components.numbered(coords(spark, x), g).agg(F.max("component")).first()[0] == 1
    assert 9 <= g.where("added").count() < len(x)
    with pytest.raises(ValueError, match="not connected"):
        knn.connected_knn_graph(coords(spark, x), 3, connect="none")


@pytest.mark.parametrize("seed", [0, 1])
def test_pruning_in_rounds_equals_one_edge_after_another(spark, seed):
    r = np.random.default_rng(seed)
    p = r.random((25, 2))
    e = [(i + 1, j + 1, float(np.round(np.hypot(*(p[i] - p[j])), 1)) + 0.1) for i in range(25) for j in range(i + 1, 25) if r.random() < 0.3]  # many equal lengths
    df = spark.createDataFrame(e, "src bigint, dst bigint, w double")
    got = sorted(map(tuple, knn.prune_geometric_rounds(df, 0.1, 0.3).collect()))
    assert got == knn.prune_geometric_sequential(e, 0.1, 0.3)
    assert len(got) < len(e)
    assert knn.prune_geometric_rounds(df.limit(0)).collect() == []


def test_surface_distances_over_many_faces(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_ROWS", 30)
    rng = np.random.default_rng(2)
    tri = rng.normal(size=(300, 3, 3)) * 0.3 + rng.normal(size=(300, 1, 3)) * 6
    tri[:3] = tri[3:6]  # repeated faces
    tri[7, 1] = tri[7, 0]  # a face without an area
    p = np.concatenate([rng.normal(size=(100, 3)) * 6, tri[:5, 0]])
    got = {r.id: r.d for r in quality.surface_distance(coords(spark, p).withColumnRenamed("v", "id"), quality.face_table(spark, tri), block=20).collect()}
    assert np.allclose([got[k + 1] for k in range(len(p))], quality.point_triangle(p, tri))


# SGD by strata ---------------------------------------------------------------------------------------------------------


def test_rounds_deal_every_meeting_once():
    for n in (2, 4, 6, 10):
        for r in range(n - 1):
            met = [(n - 1) if b == r else r if b == n - 1 else (2 * r - b) % (n - 1) for b in range(n)]
            assert all(met[met[b]] == b and met[b] != b for b in range(n))
        rounds = {(lo, hi): lo if hi == n - 1 else (lo + hi) * (n // 2) % (n - 1) for hi in range(n) for lo in range(hi)}
        for (lo, hi), r in rounds.items():
            assert hi == ((n - 1) if lo == r else (2 * r - lo) % (n - 1)) or lo == ((n - 1) if hi == r else (2 * r - hi) % (n - 1)) or (lo == r and hi == n - 1)


def stress_of(x, d):
    i, j = np.triu_indices(len(d), 1)
    o = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
    return 1 - (o @ d[i, j]) ** 2 / (o @ o) / (d[i, j] @ d[i, j])


def pair_table(spark, d):
    return spark.createDataFrame([(i + 1, j + 1, float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))], "i bigint, j bigint, d double")


def test_strata_reach_the_kernels_stress_in_no_single_group(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    p, c = pair_table(spark, d), mds.SgdControl(epochs=12)
    k = {r.v: r.x for r in mds.sgd(p, 1, 2, c).collect()}
    table = mds.strata(mds._as_constraints(p), 6)
    rows = table.collect()
    assert len(rows) == 15 and sum(len(r.body) for r in rows) == 40 * p.count()
    assert max(len(r.body) for r in rows) < 20 * p.count()
    for r in range(5):
        assert sorted(b for q in rows if q["round"] == r for b in (q.lo, q.hi)) == list(range(6))
    got, trace, why = mds.sgd_tables(p, 2, c, blocks=6)
    y = {r.v: r.x for r in got.collect()}
    mine, kernels = (stress_of(np.array([q[v + 1] for v in range(50)]), d) for q in (y, k))
    assert mine <= 1.1 * kernels
    assert why == "iteration_limit" and len(trace) == 12
    i, j = np.triu_indices(50, 1)
    assert np.isclose(min(t["profiled_stress"] for t in trace), mine * (d[i, j] ** 2).sum(), rtol=1e-6)


def test_one_meeting_is_the_sequential_pass(spark):
    """Two blocks meet once an epoch, so an epoch is the kernel's pass in the order that was drawn for the meeting."""
    x = np.random.default_rng(3).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) * 1.5
    p = pair_table(spark, d)
    got, _, _ = mds.sgd_tables(p, 2, mds.SgdControl(epochs=1), 7, coords(spark, x), blocks=2, traced=False)
    i, j = np.triu_indices(12, 1)
    block = {r.v: r.b for r in coords(spark, x).select("v", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(2)).alias("b")).collect()}
    order = np.random.default_rng([7 * 1_000_003, 0, 1]).permutation(len(i)).tolist()
    y = x.tolist()
    mds.sgd_pass(y, order, i.tolist(), j.tolist(), d[i, j].tolist(), [1.0] * len(i), [1.0] * len(i), np.random.default_rng(0))
    assert set(block.values()) == {0, 1}
    assert np.allclose([r.x for r in got.orderBy("v").collect()], y)


def test_failed_starts_are_rows(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(12, 2))
    p = pair_table(spark, np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    real = mds.sgd_tables

    def sometimes(pairs, dim, control, seed, **kw):
        if seed == 2:
            raise ValueError("no luck")
        return real(pairs, dim, control, seed, **kw)

    monkeypatch.setattr(mds, "sgd_tables", sometimes)
    best, table = mds.multistart(p, [1, 2, 3], 2, mds.SgdControl(epochs=2))
    rows = table.orderBy("start").collect()
    assert [r.status for r in rows] == ["iteration_limit", "failed", "iteration_limit"]
    assert rows[1].message == "no luck" and rows[1].profiled_stress is None
    assert best.count() == 12
    with pytest.raises(RuntimeError, match="every start"):
        mds.multistart(p, [2], 2)
    with pytest.raises(ValueError, match="at least 0"):
        real(p.withColumn("d", -F.col("d")))


# Layouts on tables -----------------------------------------------------------------------------------------------------


def test_nearest_members_are_the_nearest(spark):
    e, v = generators.mesh(spark, 5, 6).withColumn("w", F.lit(1.0)), spark.range(1, 31).withColumnRenamed("id", "v")
    at = lambda a: ((a - 1) // 6, (a - 1) % 6)
    got = {}
    for r in layout_tables.nearest_members(e, v.where("v % 4 = 0"), 3).collect():
        got.setdefault(r.v, []).append((r.d, r.s))
    for a in range(1, 31):
        assert sorted(got[a]) == sorted((float(abs(at(a)[0] - at(b)[0]) + abs(at(a)[1] - at(b)[1])), b) for b in range(4, 31, 4))[:3]


def test_pushes_of_single_bodies_are_exact_and_of_cells_exclude_oneself():
    x = np.random.default_rng(1).normal(size=(20, 2))
    gap = x[:, None] - x[None]
    d2 = (gap**2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    exact = (gap / d2[..., None]).sum(axis=1)
    alone = {"axes": 0, "lo": [0, 0], "wide": [1, 1], "ids": np.arange(20), "n": np.ones(20), "sums": x}
    assert np.allclose(layout_tables.pushes(x, alone), exact)
    one = {"axes": 1, "lo": [x[:, 0].min(), x[:, 1].min()], "wide": [np.ptp(x[:, 0]), np.ptp(x[:, 1])], "ids": np.array([0]), "n": np.array([20.0]), "sums": x.sum(axis=0)[None]}
    others = (x.sum(axis=0) - x) / 19
    away = x - others
    assert np.allclose(layout_tables.pushes(x, one), 19 * away / (away**2).sum(axis=1)[:, None])


def test_layout_of_two_components(spark):
    e = generators.mesh(spark, 4, 5).withColumn("w", F.lit(1.0)).union(spark.createDataFrame([(31, 32, 1.0), (32, 33, 1.0)], "src bigint, dst bigint, w double"))
    v = spark.range(1, 21).union(spark.range(31, 35)).withColumnRenamed("id", "v")
    trace = []
    p = layout.LayoutParams.of(rounds=3, final=8, num_init=6)
    got = {r.v: np.array(r.x) for r in layout_tables.multiscale_tables(e, v, p, trace).collect()}
    assert set(got) == {*range(1, 21), 31, 32, 33, 34} and all(np.isfinite(x).all() for x in got.values())
    assert {t[0] for t in trace} == {"insertion", "refinement"} and trace[-1][1:3] == (0, 8)
    near = np.mean([np.linalg.norm(got[a] - got[a + 1]) for a in range(1, 20) if a % 5])
    far = np.mean([np.linalg.norm(got[a] - got[b]) for a in range(1, 6) for b in range(16, 21)])
    assert far > 1.5 * near


def test_long_meshes_lie_unfolded_after_few_rounds():
    rows = 60
    i, j = np.divmod(np.arange(7 * rows), 7)
    e = np.array([(a, a + 1) for a in range(7 * rows) if j[a] < 6] + [(a, a + 7) for a in range(7 * (rows - 1))])
    a, b = np.triu_indices(7 * rows, 1)
    d = np.hypot(i[a] - i[b], j[a] - j[b])
    for given in ({}, {"dim": 3, "placement": "least_squares"}):
        x = layout.layout_graph(np.arange(7 * rows), e, np.ones(len(e)), layout.LayoutParams.of(rounds=15, final=80, **given))
        assert np.corrcoef(d, np.linalg.norm(x[a] - x[b], axis=1))[0, 1] > 0.95


# Pivots, preparation, order checks -----------------------------------------------------------------------------------------


def one_by_one(x, count, metric):
    d, chosen = blocks.pairwise(x, x, metric), [0]
    while len(chosen) < min(count, len(x)):
        near = d[:, chosen].min(axis=1)
        near[chosen] = -1
        chosen.append(int(np.flatnonzero(near == near.max())[0]))
    return [k + 1 for k in chosen]


@pytest.mark.parametrize(("metric", "batch"), [("euclid", 40), ("linf", 7)])
def test_pivots_in_batches_are_those_of_one_job_each(spark, monkeypatch, metric, batch):
    from meshlark.operators import pivots

    monkeypatch.setattr(pivots, "BATCH_PIVOTS", batch)
    x = clustered(7, 15)
    jobs, real = [], pivots._to_chosen
    monkeypatch.setattr(pivots, "_to_chosen", lambda *a: (jobs.append(1), real(*a))[1])
    assert pivots._farthest(coords(spark, x), 60, metric, batch) == one_by_one(x, 60, metric)
    assert len(jobs) < (12 if batch == 40 else 40)
    assert pivots.select_pivots(coords(spark, x[:4]), 9, "farthest", metric) == one_by_one(x[:4], 9, metric)


def test_preparation_refuses_and_searches_in_components(spark):
    from meshlark.operators import pivots

    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6))  # two components hold all variance
    o = coords(spark, x)
    with pytest.raises(ValueError, match="more than the 1000"):
        pivots.sparse_preparation(o, 3, 4, allowance=1000)
    with pytest.raises(ValueError, match="Euclidean"):
        pivots.sparse_preparation(o, 3, 4, "linf", pca_share=0.9)
    with pytest.raises(ValueError, match="more than other"):
        pivots.sparse_preparation(o, 40, 4)
    with pytest.raises(ValueError, match="are equal"):
        pivots.sparse_preparation(coords(spark, np.concatenate([x, x[:1]])), [1, 5], 4, "linf")
    for d in (0.0, -1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="row 3 "):
            pivots.check_pivot_distances(spark.createDataFrame([(1, 2, 2, 0.0), (1, 2, 3, d)], "k int, pivot bigint, v bigint, d double"))
    edges = lambda p: {(r.src, r.dst): round(r.w, 8) for r in p["edges"].collect()}
    plain, found = pivots.sparse_preparation(o, 3, 4), pivots.sparse_preparation(o, 3, 4, pca_share=0.999)
    assert edges(plain) == edges(found)
    assert plain["constraints"].count() == found["constraints"].count() > 0


def test_groups_agree_and_orders_break(spark):
    from meshlark.operators import pivots

    rows = spark.createDataFrame([(1, 2, 5.0, 3), (1, 2, 5.0 + 1e-12, 1), (2, 3, 1.0, 2)], "i int, j int, t double, n int")
    assert sorted((r.i, r.j, r.n) for r in pivots.agreed(rows, ["i", "j"], "t", ["n"]).collect()) == [(1, 2, 1), (2, 3, 2)]
    with pytest.raises(ValueError, match=r"\(1, 2\)"):
        pivots.agreed(rows.withColumn("t", F.col("t") + F.col("n")), ["i", "j"], "t", ["n"])
    x = [(k, k // 3, k % 3) for k in range(50)]
    assert pivots.order_breaks(spark.createDataFrame(x, "p int, a int, b int").repartition(5), "p", ["a", "b"]).first().breaks == 0
    x[20], x[40] = (20, 0, 0), (40, *x[39][1:])
    assert pivots.order_breaks(spark.createDataFrame(x, "p int, a int, b int").repartition(5), "p", ["a", "b"]).first().breaks == 2


# Comparison, level-by-level fits, families ------------------------------------------------------------------------------------


def crossed(e, x):
    turn = lambda a, b, c: (x[b][0] - x[a][0]) * (x[c][1] - x[a][1]) - (x[b][1] - x[a][1]) * (x[c][0] - x[a][0])
    return sum(1 for k, (a, b) in enumerate(e) for c, d in e[:k] if not {a, b} & {c, d} and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0)


@pytest.mark.parametrize(("cells", "split"), [(None, 512), (3, 4), (40, 512)])
def test_crossings_of_many_runs(spark, monkeypatch, cells, split):
    monkeypatch.setattr(quality, "SPLIT_EDGES", split)
    rng = np.random.default_rng(5)
    e = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(1, 31, size=(80, 2)) if a != b})
    xs = {s: {k + 1: tuple(p) for k, p in enumerate(rng.integers(0, 20 * s, size=(30, 2)))} for s in (1, 7)}
    c = spark.createDataFrame([(s, v, [float(a) for a in p]) for s, x in xs.items() for v, p in x.items()], "seed int, v bigint, x array<double>")
    got = {r.seed: r.edge_crossings for r in quality.crossings(spark.createDataFrame(e, "src bigint, dst bigint"), c, ("seed",), cells).collect()}
    assert got == {s: crossed(e, x) for s, x in xs.items()}


def test_comparison_has_crossings_clusters_and_errors(spark):
    from meshlark.operators import compare, paths

    e, v = generators.mesh(spark, 3, 4).withColumn("w", F.lit(1.0)), spark.range(1, 13).withColumnRenamed("id", "v")
    d = paths.hops(e, v.select(F.col("v").alias("s"))).where("s < v").select(F.col("s").alias("i"), F.col("v").alias("j"), F.col("d").cast("double").alias("d"))
    good, bad = {"rounds": 1, "final": 2, "num_init": 12}, {"preset": "none such"}
    got = {r.candidate: r for r in compare.compare(e, v, {"good": good, "bad": bad}, [1, 2], d, d.select("i", "j"), v.withColumn("cluster", (F.col("v") > 6).cast("string")), "tables").collect()}
    assert (got["good"].n_ok, got["good"].n_fail, got["bad"].n_ok, got["bad"].n_fail) == (2, 0, 0, 2)
    assert got["good"].edge_crossings_mean is not None and got["good"].cluster_separation_mean > 0
    assert got["good"]["rank"] == 1


def test_level_by_level_geodesic_fit(spark):
    from meshlark.operators import misf_fits

    e, v = generators.mesh(spark, 5, 5).withColumn("w", F.lit(1.0)), spark.range(1, 26).withColumnRenamed("id", "v")
    fit, table = misf_fits.misf_geodesic(e, v, 2, num_init=10, near_k=6, landmarks=2, restarts=2, max_iter=3)
    rows = table.orderBy(F.desc("level")).collect()
    assert rows[-1].level == 0 and rows[-1].vertices == 25 and rows[0].vertices <= 10
    assert all(r.energy <= r.start_energy for r in rows)
    x = {r.v: np.array(r.x) for r in fit.coords.collect()}
    at = lambda a: np.array([(a - 1) // 5, (a - 1) % 5])
    o, g = zip(*((np.linalg.norm(x[a] - x[b]), np.abs(at(a) - at(b)).sum()) for a in range(1, 26) for b in range(a + 1, 26)), strict=True)
    assert len(x) == 25 and np.corrcoef(o, g)[0, 1] > 0.9
    with pytest.raises(ValueError, match="not connected"):
        misf_fits.misf_geodesic(e.where("src > 5 and dst > 5"), v, 2, num_init=25)


def test_polyhedra_close(spark):
    from meshlark.operators import triangulated

    for base, faces in (("tetrahedron", 4), ("octahedron", 8), ("icosahedron", 20)):
        b = triangulated.polyhedron(spark, base, 2, surface="inflated", a=1.0)
        n, m = b.coords.count(), b.edges.count()
        assert (n, m) == (faces * 16 // 2 + 2, faces * 16 * 3 // 2)  # a closed surface without holes
        assert b.coords.where(F.abs(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)) - 1) > 1e-9).isEmpty()
        assert components.numbered(b.coords, b.edges).agg(F.max("component")).first()[0] == 1
    with pytest.raises(ValueError, match="radius"):
        triangulated.polyhedron(spark, "octahedron", 1, surface="inflated", a=-9.0)
    with pytest.raises(ValueError, match="annulus"):
        triangulated.annulus(spark, 12, 1.0, 0.95)


def test_irregular_points_lie_on_their_surfaces(spark):
    norm = lambda f, **kw: [np.linalg.norm(r.x) for r in generators.irregular_points(spark, f, 300, **kw).collect()]
    assert np.allclose(norm("sphere"), 1)
    assert max(norm("ball")) <= 1 and min(norm("shell")) >= 0.5
    ring = np.array([r.x for r in generators.irregular_points(spark, "torus", 300).collect()])
    assert np.allclose((np.hypot(ring[:, 0], ring[:, 1]) - 2) ** 2 + ring[:, 2] ** 2, 0.36)
    u = np.array([r.x[2] for r in generators.irregular_points(spark, "sphere", 4000).collect()])
    assert abs(u.mean()) < 0.05 and abs((u < 0).mean() - 0.5) < 0.03  # uniform by area
    assert norm("sphere", seed=2)[0] == pytest.approx(1)


def test_update_trace_keeps_within_its_budget(spark):
    x = np.random.default_rng(1).normal(size=(9, 2))
    p = pair_table(spark, np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    c = mds.SgdControl(epochs=2)
    rows = mds.update_trace(p, 10, 1 << 20, 2, c, seed=3).collect()
    steps = sorted({(r.frame, r.epoch, r.update_in_epoch, r.pair_updates) for r in rows})
    assert steps == [(0, 0, 0, 0), *((1 + k, 1, u, u) for k, u in enumerate((10, 20, 30, 36))), *((5 + k, 2, u, 36 + u) for k, u in enumerate((10, 20, 30, 36)))]
    end = {r.v: r.x for r in rows if r.frame == 8}
    state, _ = mds.sgd_kernel(9, *np.triu_indices(9, 1), np.array([r.d for r in p.orderBy("i", "j").collect()]), np.ones(36), np.ones(36), 2, c, 3)
    assert np.allclose([end[v + 1] for v in range(9)], state.coords)  # the kernel's run, cut into frames
    with pytest.raises(ValueError, match="more than the 2000"):
        mds.update_trace(p, 10, 2000, 2, c)
    with pytest.raises(ValueError, match="whole number"):
        mds.update_trace(p, 0, 1 << 20, 2, c)


def test_catalogue_of_families_checks_values(spark):
    from meshlark.operators import families

    t = families.table(spark).collect()
    assert {r.family for r in t} == set(families.FAMILIES) and all(r.kind in ("int", "float", "choice") for r in t)
    assert families.presets(spark).where("family = 'mesh' and preset = 'ripple'").count() == 4
    b = families.build(spark, "mesh", "paraboloid", h=4, w=5)
    assert b.edges.count() == 31 and all(abs(r.x[2] - 0.55 * (r.x[0] ** 2 + r.x[1] ** 2)) < 1e-9 for r in b.coords.collect())
    for bad in ({"h": 1}, {"h": 2.5}, {"surface": "cube"}, {"nonsense": 1}, {"a": "x"}):
        with pytest.raises(ValueError):
            families.build(spark, "mesh", **bad)
    with pytest.raises(ValueError, match="preset"):
        families.build(spark, "mesh", "none")
    with pytest.raises(ValueError, match="unknown"):
        families.build(spark, "klein_bottle")
