"""Fits against numpy kernels, traces, readers, ranks, components, masks, presets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import catalogue, components, fits, generators, knn, layout, paths, pivots, quality, traces
from meshlark.plans import shared
from meshlark.sources import readers


def coords(spark, x):
    return spark.createDataFrame([(k + 1, [float(a) for a in row]) for k, row in enumerate(x)], "v bigint, x array<double>")


def array(df):
    return np.array([r.x for r in df.orderBy("v").collect()])


def test_edge_fit_equals_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 2))
    e = [(a, a % 12 + 1, 1.0 + a % 3) for a in range(1, 13)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in e], "src bigint, dst bigint, w double")
    fit = fits.edge_kk(edges, coords(spark, x), (0.0,), "identity", max_iter=4)
    u, v, w = (np.array(c) for c in zip(*e, strict=True))
    energy, gradient = layout.edge_objective(u - 1, v - 1, w, np.ones(12), 1.0)
    y, trace, _ = layout.armijo(x, energy, gradient, 4)
    assert np.allclose(fit.trace, trace) and np.allclose(array(fit.coords), y)
    assert fit.summary().first().steps == 4 and "energy" in repr(fit)


def test_fits_lower_their_energies(spark):
    rng = np.random.default_rng(2)
    x = coords(spark, rng.normal(size=(10, 2)))
    edges = generators.cycle(spark, 10).withColumn("w", F.lit(1.0))
    pairs = spark.createDataFrame([(1, 6), (2, 7), (3, 9)], "i bigint, j bigint")
    for fit in (
        fits.landmark_geodesic_kk(edges, x.select("v"), x, 2, 1, max_iter=3), fits.kernel_gram_gkk(edges, coords(spark, [[np.cos(k), np.sin(k)] for k in range(10)]), x, max_iter=3),
        fits.repulsive_stage(pairs, x, max_iter=2), fits.edge_repulsive_stage(edges, pairs, x, kind="upper_barrier", eps_plus=50.0, max_iter=3), fits.edge_kk(edges, x, (0.0, 1.0), "fixed_initial", max_iter=2),
    ):
        assert len(fit.trace) > 1 and fit.trace[-1] < fit.trace[0]
        assert abs(array(fit.coords).mean(axis=0)).max() < 1e-9
    p, q = fits.full_preparation(edges, x.select("v"))
    assert p.count() == 45 and q.groupBy("i", "j").agg(F.sum("coeff").alias("n")).join(p, ["i", "j"]).where("n <> g").isEmpty()


def test_path_counts_do_not_overflow(spark):
    """A chain of diamonds doubles its paths each time."""
    n = 1100
    e = [x for k in range(n) for x in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))][: 4 * 12]
    edges = spark.createDataFrame([(a + 1, b + 1, 1.0) for a, b in e], "src bigint, dst bigint, w double")
    d = paths.distances(edges, spark.createDataFrame([(1,)], "s bigint"))
    got = {r.v: r.log_paths for r in paths.path_counts(edges, d).collect()}
    assert all(abs(got[3 * k + 1] - k * np.log(2)) < 1e-9 for k in range(13))
    rows = spark.createDataFrame([(1, 900.0), (1, 900.0)], "v bigint, l double")
    assert abs(paths.log_sum_exp(rows, rows.groupBy("v").agg(F.max("l").alias("m")), ["v"]).first().log_paths - 900 - np.log(2)) < 1e-9


def test_components_take_several_levels(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 7)
    rng = random.Random(3)
    e = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(e, "a bigint, b bigint").repartition(16)).collect()}
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in e:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {a: find(a) for a in root}


def test_landmarks_nearest_ranks_and_hot_joins(spark):
    rng = np.random.default_rng(4)
    d = rng.uniform(1, 9, size=(7, 7))
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0)
    dist = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(7) for j in range(7)], "s bigint, v bigint, d double")
    got = {}
    for r in pivots.farthest_landmarks(dist, 3).collect():
        got.setdefault(r.s, set()).add(r.v)
    for s in range(7):
        score, picked = d[s].copy(), []
        for _ in range(3):
            b = max((v for v in range(7) if v != s and v not in picked), key=lambda v: (score[v], -v))
            picked.append(b)
            score = np.minimum(score, d[b])
        assert got[s] == set(picked)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(40, 3))
    near = {r.v: r.d for r in knn.nearest(coords(spark, a), coords(spark, b), block=9).collect()}
    assert np.allclose([near[k + 1] for k in range(30)], np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1))
    x = [3, 1, 3, 2, 3, 1]
    ranks = {r.a: r.rank for r in shared.average_ranks(spark.createDataFrame([(v,) for v in x], "a int"), "a").collect()}
    assert ranks == {1: 1.5, 2: 3.0, 3: 5.0}
    rows = spark.createDataFrame([(k % 5 if k % 3 else 0, k) for k in range(300)], "k int, x int")
    values = rows.groupBy("k").agg(F.max("x").alias("m"), F.count(F.lit(1)).alias("count"))
    for total in (300, 10**7):
        assert shared.join_counted(rows, values, ["k"], total).where("m >= x").count() == 300
    c = quality.correlations(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, float("nan")), (4.0, 9.0)], "a double, b double"), "a", "b").first()
    assert abs(c.spearman - 1) < 1e-12 and c.pearson < 1
    assert quality.correlations(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double"), "a", "b").first().pearson is None
    tri = rng.normal(size=(30, 3, 3))
    p = rng.normal(size=(25, 3))
    points = coords(spark, p).withColumnRenamed("v", "id")
    got = {r.id: r.d for r in quality.surface_distance(points, quality.face_table(spark, tri), block=7).collect()}
    assert np.allclose([got[k + 1] for k in range(25)], quality.point_triangle(p, tri))


def test_matrix_market_and_projects(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate real symmetric\n% note\n6 6 6\n2 1 1.5\n3 2 2\n3 2 -2\n5 4 1\n1 1 4\n3 1 2\n"
    (tmp_path / "m.mtx").write_text(text)
    path, sha = f"file://{tmp_path}/m.mtx", hashlib.sha256(text.encode()).hexdigest()
    edges = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert edges(readers.read_matrix_market(spark, path, sha)) == [(1, 2), (1, 3), (4, 5)]
    assert edges(readers.read_matrix_market(spark, path, largest=True)) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError, match="SHA-256"):
        readers.read_matrix_market(spark, path, "0" * 64)
    for k, bad in enumerate(("1 1 1\n1 1 1\n", text.replace("6 6 6", "6 6 7"), text.replace("6 6 6", "6 5 6"), text.replace("5 4 1", "9 4 1"))):
        (tmp_path / f"bad{k}.mtx").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_matrix_market(spark, f"file://{tmp_path}/bad{k}.mtx")
    e, v = generators.path(spark, 4), spark.range(1, 5).withColumnRenamed("id", "v")
    layouts = spark.createDataFrame([("a", "c1", 1, "", "p.html"), ("b", "c2", 2, "x", "")], "`Layout ID` string, candidate string, seed int, coords_path string, html_path string")
    readers.write_project(f"file://{tmp_path}/project", e, v, layouts, "# Notes\nmore")
    got = readers.read_project(spark, f"file://{tmp_path}/project")
    assert got["notes"].strip() == "# Notes\nmore" and edges(got["edges"]) == edges(e)
    assert {r.layout_id: r.availability for r in got["layouts"].collect()} == {"a": "artifact-only", "b": "interactive"}
    with pytest.raises(ValueError):
        catalogue.layout_coordinates(coords(spark, [[1.0], [2.0]]))
    with pytest.raises(ValueError):
        catalogue.layout_coordinates(coords(spark, [[1.0, float("nan")]]))
    assert catalogue.layout_coordinates(fits.Fit(coords(spark, [[1.0, 2.0]]))).count() == 1


def test_feature_graph(spark):
    rng = np.random.default_rng(6)
    rows = [(s, f"f{f}", float(n)) for s in range(40) for f, n in enumerate(rng.poisson(20, size=12)) if n] + [(99, "rare", 3.0), (99, "f1", 5.0)]
    edges, x = readers.feature_graph(spark.createDataFrame(rows, "sample bigint, feature string, n double"), dims=4, k=3, prevalence=0.1, min_reads=50)
    kept = {r.v for r in x.collect()}
    assert 3 < len(kept) <= 40 and 99 not in kept and len(x.first().x) == 4
    assert edges.select(F.explode(F.array("src", "dst")).alias("v")).where(~F.col("v").isin(list(kept))).isEmpty()


def test_traces_and_presets(spark):
    edges = [(a, a + 1, 1.0) for a in range(1, 30)]
    p = layout.LayoutParams.of(rounds=4, final=6, num_init=5)
    meta, frames = traces.trace(spark, list(range(1, 31)), edges, p, every=3)
    full, _ = traces.trace(spark, list(range(1, 31)), edges, p)
    assert 3 < meta.count() < full.count() and frames.select("frame").distinct().count() == meta.count()
    s = traces.stages(meta, True).orderBy("stage").collect()
    assert s[0].kind == "top_level" and s[-1].kind == "final_polish" and {r.kind for r in s} == {"top_level", "insertion", "refinement", "final_polish"}
    e = spark.createDataFrame(edges, "src bigint, dst bigint, w double")
    target = coords(spark, [[float(k), 0.5 * (k % 2)] for k in range(30)])
    d = traces.diagnostics(frames, e, "light", target=target).orderBy("frame").collect()
    assert d[-1].active_vertices == 30 and d[-1].active_edges == 29 and d[-1].procrustes_rmse < 1
    assert traces.diagnostics(frames, e, "none") is None
    x = traces.layout_graph(e, spark.range(1, 31).withColumnRenamed("id", "v"), polish_rounds=1, rounds=4, final=6)
    assert x.count() == 30
    tree = layout.LayoutParams.of(preset="tree", dim=3)
    assert (tree.placement, tree.repulsion, tree.num_nbrs) == ("barycenter", 0.0, 8) and layout.LayoutParams.of(preset="tree").placement == "circle"
    assert layout.LayoutParams.of(preset="mesh", rounds=7) == layout.LayoutParams(preset="mesh", rounds=7, final=128, num_init=12, num_nbrs=20, r=0.10, s=4.5, repulsion=1.5)
    with pytest.raises(ValueError):
        layout.LayoutParams.of(preset="sphere")


def test_masks_refuse_what_they_cannot_be(spark):
    for bad in (lambda: generators.mask_cross(4), lambda: generators.mask_corner(3, 4), lambda: generators.mask_asymmetric_holes(5, 2), lambda: generators.mask_corner(corner="middle"), lambda: generators.mask_channel_network(5, 1, 1), lambda: generators.mask_triangle("center")):
        with pytest.raises(ValueError):
            bad()
    assert len(generators.mask_border(3, 2)) == 9 and generators.mask_cross(3, 1).kept == generators.MASKS["vicsek"]().kept
    keep = generators.keep_periodic_holes(9, 9, hole_period=2, hole_height=3)  # holes overlap
    assert {(r.i, r.j) for r in generators._grid(spark, 9, 9).where(~keep).collect()} == {(i, j) for i in range(1, 8) for j in range(1, 8)}
