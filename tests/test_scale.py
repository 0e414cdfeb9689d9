"""What tables of the large runs have and those of the other tests do not."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import blocks, generators, knn, mds, paths, pivots


def _line(spark, n):
    return generators.path(spark, n).withColumn("w", F.lit(1.0))


def _single(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "s bigint")


def test_long_graphs_take_no_round_for_each_step(spark):
    e = _line(spark, 300)
    d = paths.distances(e, _single(spark, 1, 300), rounds=2)
    assert {(r.s, r.v): r.d for r in d.collect()} == {(s, v): float(abs(s - v)) for s in (1, 300) for v in range(1, 301)}
    assert paths.path_counts(e, d, rounds=2).where("paths = 1").count() == 600


def test_all_pairs_of_more_than_five_thousand_vertices(spark):
    e = _line(spark, 5001)
    assert paths.all_pairs(e, spark.range(1, 5002).withColumnRenamed("id", "v")).agg(F.sum("d")).first()[0] == 5000 * 5001 * 5002 / 6
    with pytest.raises(ValueError):
        paths.all_pairs(e, spark.range(1, 5002).withColumnRenamed("id", "v"), most=5000)


def test_searches_and_rounds_agree(spark, monkeypatch):
    e = generators.mesh(spark, 6, 5).withColumn("w", 1.0 + F.col("src") % 3).union(spark.createDataFrame([(90, 91, 2.0)], "src bigint, dst bigint, w double"))
    s = _single(spark, 3, 17, 90, 77)

    def rows():
        d = paths.distances(e, s)
        got = [d, paths.hops(e, s), paths.hops(e, s, limit=2), paths.hops(e, s, above=True), paths.distances(e, s, above=True)]
        counts = {(r.s, r.v): r.log_paths for r in paths.path_counts(e, d).collect()}
        return [sorted(map(tuple, x.select("s", "v", "d").collect())) for x in got], counts

    held, counts = rows()
    monkeypatch.setattr(paths, "TASK_CELLS", 40)
    monkeypatch.setattr(paths, "STEP_EDGES", 5)
    assert rows()[0] == held
    monkeypatch.setattr(paths, "TASK_EDGES", 0)
    apart, other = rows()
    assert apart == held and counts.keys() == other.keys()
    assert all(math.isclose(counts[k], other[k], abs_tol=1e-12) for k in counts)


def test_regions_weigh_the_place_of_a_pivot(spark):
    d = spark.createDataFrame([(1, 5, 7, 0.3000004), (2, 6, 7, 0.3), (1, 5, 8, 0.300002), (2, 6, 8, 0.3)], "k int, pivot bigint, v bigint, d double")
    assert {r.v: r.owner for r in pivots.regions(d, 1_000_000).collect()} == {7: 5, 8: 6}
    assert {r.v: r.owner for r in pivots.regions(d).collect()} == {7: 6, 8: 6}


def test_copies_on_a_line(spark):
    x = spark.createDataFrame([(1, [0.0]), (2, [2.0]), (3, [5.0]), (4, [2.0]), (5, [9.0]), (6, [2.0])], "v bigint, x array<double>")
    assert sorted(map(tuple, knn.line_tree(x).collect())) == [(1, 2, 2.0), (2, 4, 0.0), (3, 5, 4.0), (3, 6, 3.0), (4, 6, 0.0)]
    e = knn.connected_knn_graph(x, 2, copies=True)
    assert e.where("w = 0").count() == 3 and not e.where("added").count()


def test_update_trace_of_more_suppliers(spark, tmp_path):
    from meshlark import registry

    n = 6000  # 660 vertices
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(700).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 2)).cast("array<float>").alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["update_trace"](spark, str(tmp_path))
    m = 660 * 659 // 2
    assert got.count() == 1 + 2 * -(-m // 1000) and got.where("placed <> 660").isEmpty()


def test_a_block_goes_to_no_task_for_each_block_it_meets(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_ROWS", 10)
    monkeypatch.setattr(blocks, "STRIPES", 2)
    x = np.random.default_rng(4).normal(size=(300, 16))
    o = spark.createDataFrame([(i + 1, r) for i, r in enumerate(x.tolist())], "v bigint, x array<double>")
    pairs, packed, p = knn.knn_pairs(o, 3, "linf", 10)
    found = blocks.searched(pairs, packed, packed, p, 3)
    assert found.count() <= 2 * 3 * 300 < pairs.count()  # three of each stripe, not of each block
    d = blocks.pairwise(x, x, "linf")
    np.fill_diagonal(d, np.inf)
    got = {(r.v, r["rank"]): r.d for r in knn.knn(o, 3, "linf", 10).collect()}
    assert got == {(i + 1, k + 1): q for i in range(300) for k, q in enumerate(np.sort(d[i])[:3])}


@pytest.mark.parametrize("side", [1, 2, 3, 5])
def test_cube_surface_forms_its_vertices_only(spark, side):
    ids = {(x, y, z): (x * side + y) * side + z + 1 for x in range(side) for y in range(side) for z in range(side) if {x, y, z} & {0, side - 1}}
    want = sorted((v, ids[t]) for (x, y, z), v in ids.items() for t in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)) if t in ids)
    e = generators.cube_surface(spark, side)
    assert sorted(map(tuple, e.collect())) == want
    assert "Join" not in e._jdf.queryExecution().toString() and generators.cube_surface(spark, 36_005).limit(1).count() == 1


def test_classical_mds_of_points_stores_no_pairs(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 2)) * [5.0, 1.0]
    points = spark.createDataFrame([(3 * k, r) for k, r in enumerate(x.tolist())], "v bigint, x array<double>")
    written, real = [], mds.materialize
    monkeypatch.setattr(mds, "materialize", lambda df, what, *a, **k: (written.append((what, (out := real(df, what, *a, **k)).count())), out)[1])
    monkeypatch.setattr(mds, "POINT_ROWS", 7)
    y, val = mds.classical_of(points, driver_limit=10)
    got = np.array([r.x for r in y.orderBy("v").collect()])
    gaps = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    assert np.allclose(gaps(got), gaps(x), atol=1e-9) and val[0] > val[1] > 0
    assert max(n for _, n in written) <= 60  # points and blocks, not pairs
    monkeypatch.setattr(mds, "TILE_ROWS", 16)
    d = gaps(x)
    pairs = spark.createDataFrame([(3 * a, 3 * b, float(d[a, b])) for a in range(60) for b in range(a + 1, 60)], "i bigint, j bigint, d double")
    z, _ = mds.classical(pairs, points.select("v"), driver_limit=10)
    assert np.allclose(gaps(np.array([r.x for r in z.orderBy("v").collect()])), d, atol=1e-9)
    with pytest.raises(Exception, match="every pair"):
        mds.classical(pairs.where("i + j <> 9"), points.select("v"), driver_limit=10)
