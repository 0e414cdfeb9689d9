"""Queries of components, searches, layouts on tables and triangulated families, each with its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators import catalogue, compare, components, families, generators, knn, layout, layout_tables, mds, misf_fits, pivots, quality, triangulated
from meshlark.plans.shared import materialize
from meshlark.registry import KNN5, LEVELS, OBS, RING, SIDE, SUPPLIERS, XY, depth, load, observations, plane, query, r6, ring, rounded, side, suppliers

# The orders of a customer in the order of their keys are a chain: there are as many components as customers with two orders or more.


@query("components_orders", """WITH o AS (SELECT o_custkey AS c, o_orderkey::BIGINT AS id FROM orders), n AS (SELECT c, min(id) AS component, count(*) AS n FROM o GROUP BY c)
SELECT id, component FROM o JOIN n USING (c) WHERE n > 1""")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = load(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("a"), F.lag("o_orderkey").over(w).cast("bigint").alias("b")).where("b is not null")
    return components.components(e)


@query("component_numbers", """WITH o AS (SELECT o_custkey AS c, o_orderkey::BIGINT AS v FROM orders), m AS (SELECT c, min(v) AS m FROM o GROUP BY c) SELECT v, (dense_rank() OVER (ORDER BY m))::INTEGER AS component FROM o JOIN m USING (c)""")
def _(s, d):
    o = load(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("v"), "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("v")
    return components.numbered(o.select("v"), o.select(F.lag("v").over(w).alias("src"), F.col("v").alias("dst")).where("src is not null"))


# Observations on a line: their tree joins those that are next to each other.
LINE = "ln AS (SELECT vec_id + 1 AS v, embedding[1]::DOUBLE AS x FROM embeddings), nx AS (SELECT least(v, lead(v) OVER w) AS src, greatest(v, lead(v) OVER w) AS dst, lead(x) OVER w - x AS w FROM ln WINDOW w AS (ORDER BY x))"


@query("observation_tree_line", f"WITH {LINE} SELECT src, dst, round(w, 6) AS w FROM nx WHERE src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL")
def _(s, d):
    return rounded(knn.line_tree(plane(s, d, 1)))


@query("connected_line", f"""WITH {LINE}, pd AS (SELECT a.v AS v, b.v AS u, abs(a.x - b.x) AS d FROM ln a JOIN ln b ON a.v <> b.v), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, u) AS r FROM pd) WHERE r <= 3),
e AS (SELECT least(v, u) AS src, greatest(v, u) AS dst, min(d) AS w FROM nn GROUP BY ALL) SELECT src, dst, round(w, 6) AS w, false AS added FROM e
UNION ALL SELECT src, dst, round(w, 6), true FROM nx WHERE w IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = nx.src AND e.dst = nx.dst)""")
def _(s, d):
    return rounded(knn.connected_knn_graph(plane(s, d, 1), 3, copies=True))


# Chords of a ring are long enough or not for the seven short edges beside them to replace them.
CHORDS = f"{XY}, {RING}, e AS (SELECT src, dst, CASE WHEN dst - src = 1 THEN 1.0 ELSE 6 + (src % 4) / 4.0 END::DOUBLE AS w FROM ring)"


@query("geometric_prune_ring", f"WITH {CHORDS} SELECT src, dst, w FROM e WHERE w = 1 OR 1.1 * w < 7")
def _(s, d):
    e = ring(s, d).withColumn("w", F.when(F.col("dst") - F.col("src") == 1, 1.0).otherwise(6 + (F.col("src") % 4) / 4.0))
    return knn.prune_geometric_rounds(e, 0.1, 0.1)


# A surface over a grid of the parts, with their sizes as heights, and the embeddings' first three components as points.
WIDE = 40
MESH = f"""gp AS (SELECT p_partkey // {WIDE} AS i, p_partkey % {WIDE} AS j, p_size / 25.0::DOUBLE AS z FROM part),
g AS (SELECT i, j, i / 10.0::DOUBLE - 2 AS x, j / 10.0::DOUBLE - 2 AS y, z FROM gp),
f AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.i = a.i AND c.j = a.j + 1
 UNION ALL SELECT a.x, a.y, a.z, b.x, b.y, b.z, c.x, c.y, c.z FROM g a JOIN g b ON b.i = a.i - 1 AND b.j = a.j JOIN g c ON c.i = a.i AND c.j = a.j - 1)"""


def _to_segment(a: str, b: str) -> str:
    """The squared distance of (x, y, z) to the segment between two corners."""
    n = lambda c, k: f"{c}{'_' if c == 'b' and k == 'y' else ''}{k}"
    dd = " + ".join(f"({n(b, k)} - {n(a, k)}) ** 2" for k in "xyz")
    t = f"least(1, greatest(0, ({' + '.join(f'({k} - {n(a, k)}) * ({n(b, k)} - {n(a, k)})' for k in 'xyz')}) / ({dd})))"
    return " + ".join(f"({k} - {n(a, k)} - {t} * ({n(b, k)} - {n(a, k)})) ** 2" for k in "xyz")


# Barycentric places of a point's foot in a face: the foot is inside where all three are at least 0.
FOOT = """u AS (SELECT *, bx - ax AS ux, b_y - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, x - ax AS wx, y - ay AS wy, z - az AS wz FROM pf),
n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM u),
m AS (SELECT *, nx * nx + ny * ny + nz * nz AS nn, nx * wx + ny * wy + nz * wz AS h FROM n),
q AS (SELECT *, ((uy * wz - uz * wy) * nx + (uz * wx - ux * wz) * ny + (ux * wy - uy * wx) * nz) / nn AS g, ((wy * vz - wz * vy) * nx + (wz * vx - wx * vz) * ny + (wx * vy - wy * vx) * nz) / nn AS b FROM m)"""


@query("surface_distance_parts", f"""WITH {XY}, {MESH}, pf AS (SELECT v AS id, xy.x, xy.y, xy.z, ax, ay, az, bx, b_y, bz, cx, cy, cz FROM xy, f), {FOOT},
e AS (SELECT id, least({_to_segment('a', 'b')}, {_to_segment('b', 'c')}, {_to_segment('c', 'a')}, CASE WHEN g >= 0 AND b >= 0 AND g + b <= 1 THEN h * h / nn END) AS d2 FROM q)
SELECT id, round(sqrt(min(d2)), 6) AS d FROM e GROUP BY id""")
def _(s, d):
    p = load(s, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("z"))
    i, j = F.floor(F.col("p") / WIDE).cast("bigint"), (F.col("p") % WIDE).cast("bigint")
    g = materialize(p.select(i.alias("i"), j.alias("j"), F.array(i / 10.0 - 2, j / 10.0 - 2, F.col("z") / 25.0).alias("x")), "grid")
    faces = None
    for k, way in enumerate((1, -1)):
        b = g.select((F.col("i") - way).alias("i"), "j", F.col("x").alias("b"))
        c = g.select("i", (F.col("j") - way).alias("j"), F.col("x").alias("c"))
        t = g.join(b, ["i", "j"]).join(c, ["i", "j"]).select(((F.col("i") * WIDE + F.col("j")) * 2 + k).alias("f"), F.col("x").alias("a"), "b", "c")
        faces = t if faces is None else faces.union(t)
    return rounded(quality.surface_distance(observations(s, d).select(F.col("v").alias("id"), F.slice("x", 1, 3).alias("x")), materialize(faces, "faces")))


# A way on the ring from v to a member m takes chords and then short edges, forward or back.
@query("nearest_members_ring", f"""WITH {XY}, h AS (SELECT a.v, b.v AS s, abs(a.v - b.v) AS k FROM xy a JOIN xy b ON b.v % 10 = 0), g AS (SELECT v, s, least(k // 7 + k % 7, k // 7 + 1 + 7 - k % 7)::DOUBLE AS d FROM h)
SELECT v, s, d FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, s) AS r FROM g) WHERE r <= 3 AND v BETWEEN 11 AND (SELECT max(v) FROM xy) - 10""")
def _(s, d):
    v = observations(s, d).select("v")
    n = v.agg(F.max("v")).first()[0]
    return layout_tables.nearest_members(ring(s, d), v.where("v % 10 = 0"), 3).where((F.col("v") >= 11) & (F.col("v") <= n - 10))


_P = layout.LayoutParams.of()
_PUSH, _PULL = _P.coarse_repulsion * layout.REPULSION_UNIT * layout.EDGE**2, _P.repulsion * layout.REPULSION_UNIT * layout.EDGE**2
_AXES = int(math.sqrt(layout_tables.CELLS))


# A round of the finest level: edges pull, neighbours repel, and the cells of the grid push with what they hold besides the vertex.
@query("layout_round_knn", f"""WITH {KNN5}, {XY}, st AS (SELECT v, 100 * x AS x, 100 * y AS y FROM xy), e AS (SELECT DISTINCT least(v, u) AS src, greatest(v, u) AS dst FROM nn), ad AS (SELECT src AS s, dst AS v FROM e UNION ALL SELECT dst, src FROM e),
ge AS (SELECT ad.s, b.x - a.x AS gx, b.y - a.y AS gy FROM ad JOIN st a ON a.v = ad.s JOIN st b ON b.v = ad.v), gr AS (SELECT nn.v AS s, b.x - a.x AS gx, b.y - a.y AS gy FROM nn JOIN st a ON a.v = nn.v JOIN st b ON b.v = nn.u),
p AS (SELECT s, (gx * gx + gy * gy) / {layout.EDGE ** 2} * gx AS px, (gx * gx + gy * gy) / {layout.EDGE ** 2} * gy AS py FROM ge UNION ALL SELECT s, -{_PULL} / greatest(gx * gx + gy * gy, 1e-9) * gx, -{_PULL} / greatest(gx * gx + gy * gy, 1e-9) * gy FROM gr),
bx AS (SELECT min(x) AS x0, max(x) - min(x) AS xw, min(y) AS y0, max(y) - min(y) AS yw, count(*) AS m FROM st),
c AS (SELECT v, x, y, m, least(floor((x - x0) / xw * {_AXES}), {_AXES - 1}) * {_AXES} + least(floor((y - y0) / yw * {_AXES}), {_AXES - 1}) AS cell FROM st, bx),
cl AS (SELECT cell, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM c GROUP BY cell),
w AS (SELECT c.v, c.x, c.y, m, n - (c.cell = cl.cell)::INT AS k, sx - (c.cell = cl.cell)::INT * c.x AS tx, sy - (c.cell = cl.cell)::INT * c.y AS ty FROM c, cl),
a AS (SELECT v, m, k, x - tx / k AS ax, y - ty / k AS ay FROM w WHERE k > 0),
q AS (SELECT v AS s, {_PUSH} / m * k / greatest(ax * ax + ay * ay, 1e-9) * ax AS px, {_PUSH} / m * k / greatest(ax * ax + ay * ay, 1e-9) * ay AS py FROM a WHERE ax * ax + ay * ay > 0),
t AS (SELECT s AS v, sum(px) AS px, sum(py) AS py FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY s), z AS (SELECT *, sqrt(px * px + py * py) AS n FROM t),
u AS (SELECT v, px, py, CASE WHEN round(n) <> 0 THEN least({layout.EDGE / _P.tinit_factor}, n) / n ELSE 0 END AS f FROM z)
SELECT v, round(x + px * f, 6) + 0.0 AS x0, round(y + py * f, 6) + 0.0 AS x1 FROM st JOIN u USING (v)""")
def _(s, d):
    near = materialize(knn.knn(observations(s, d), 5), "near")
    e = near.select(F.least("v", "u").alias("src"), F.greatest("v", "u").alias("dst")).distinct()
    one = F.lit(1.0).alias("d")
    pulls = e.select(F.col("src").alias("s"), F.col("dst").alias("v"), F.lit("edge").alias("kind"), one).union(e.select("dst", "src", F.lit("edge"), one)).union(near.select("v", "u", F.lit("rep"), one))
    state = materialize(layout_tables._fresh(plane(s, d).select("v", F.transform("x", lambda c: 100 * c).alias("x")), _P), "state")
    n = state.count()
    moved = layout_tables.layout_round(state, pulls, _P, layout_tables.grid_of(state, 2, n, 0), n)
    return moved.select("v", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(1))).alias("x1"))


# All principal components are a rotation, so neighbours in them are those of the vectors.
@query("pca_search_edges", f"""WITH {OBS}, pd AS (SELECT a.v AS v, b.v AS u, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2))) AS d FROM obs a JOIN obs b ON a.v <> b.v),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, u) AS r FROM pd) WHERE r <= 4) SELECT least(v, u) AS src, greatest(v, u) AS dst, round(min(d), 6) AS w FROM nn GROUP BY ALL""")
def _(s, d):
    return rounded(pivots.sparse_preparation(observations(s, d), 3, 4, "euclid", pca_share=1.0, allowance=1 << 34)["edges"])


# Triangulated and irregular families, of a size that follows the suppliers.
LATTICE = """n AS (SELECT (count(*) // 10 + 4)::INTEGER AS res FROM supplier), k AS (SELECT {outer}::DOUBLE AS ro, {outer}::DOUBLE / res AS sp, {outer}::DOUBLE / res * sqrt(3::DOUBLE) / 2 AS dy FROM n),
l AS (SELECT r, c, -ro - sp + sp * (c + 0.5 * (r % 2)) AS x, -ro - dy + dy * r AS y FROM k, range(5000) a(r), range(5000) b(c) WHERE r <= floor((2 * ro + 2 * dy) / dy + 1e-10) AND c < ceil(2 * ro / sp) + 4),
g AS (SELECT row_number() OVER (ORDER BY r, c) AS v, r, c, x, y FROM l WHERE {keep}),
e AS (SELECT a.v AS src, b.v AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 {lift}) AS w FROM g a JOIN g b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND (b.c = a.c OR b.c = a.c + CASE WHEN a.r % 2 = 0 THEN -1 ELSE 1 END)))"""
PANTS = "x * x + y * y <= 1.1 * 1.1 AND (x + 0.38) * (x + 0.38) + (y - 0.18) * (y - 0.18) >= 0.24 * 0.24 AND (x - 0.38) * (x - 0.38) + (y - 0.18) * (y - 0.18) >= 0.24 * 0.24"


def _resolution(s, d) -> int:
    return load(s, d, "supplier").count() // 10 + 4


@query("gen_triangulated", f"WITH {LATTICE.format(outer=1, keep='x * x + y * y <= 1 AND x * x + y * y >= 0.45 * 0.45', lift='')} SELECT src, dst, round(w / (SELECT median(w) FROM e), 6) AS w FROM e")
def _(s, d):
    return rounded(triangulated.annulus(s, _resolution(s, d)).edges.select("src", "dst", "w"))


@query("gen_triangulated_pants", f"WITH {LATTICE.format(outer=1.1, keep=PANTS, lift='')}, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM g), q AS (SELECT v, x, y, (x - mx) AS cx, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM g, m) SELECT v, round(x, 6) + 0.0 AS x0, round(y, 6) + 0.0 AS x1, round(0.6 * abs(cx / (SELECT max(r) FROM q)), 6) AS x2 FROM q")
def _(s, d):
    c = triangulated.pair_of_pants(s, _resolution(s, d), surface="folded").coords
    return c.select("v", *(r6(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(3)))


# An octahedron's vertices are the points of whole numbers whose sizes sum to the number of parts; edges join those that are nearest.
@query("gen_triangulated_polyhedron", """WITH n AS (SELECT (2 ** floor(log2(count(*)) / 2))::INTEGER AS s FROM supplier), r AS (SELECT unnest(range(-s, s + 1)) AS k, s FROM n),
p AS (SELECT a.k AS x, b.k AS y, c.k AS z, a.s FROM r a, r b, r c WHERE abs(a.k) + abs(b.k) + abs(c.k) = a.s),
e AS (SELECT sqrt(2::DOUBLE) / p.s AS w, p.x / p.s::DOUBLE AS px, p.y / p.s::DOUBLE AS py, p.z / p.s::DOUBLE AS pz, q.x / q.s::DOUBLE AS qx, q.y / q.s::DOUBLE AS qy, q.z / q.s::DOUBLE AS qz FROM p JOIN p q ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 = 2 AND (p.x, p.y, p.z) < (q.x, q.y, q.z))
SELECT round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py, round(pz, 6) + 0.0 AS pz, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy, round(qz, 6) + 0.0 AS qz, round(w, 6) AS w FROM e""")
def _(s, d):
    b = triangulated.polyhedron(s, "octahedron", int(math.log2(load(s, d, "supplier").count()) // 2), by="none")
    p, q = (b.coords.select(F.col("v").alias(n), F.transform("x", lambda c: F.round(c, 6) + 0.0).alias(f"x_{n}")) for n in ("src", "dst"))
    e = b.edges.join(p, "src").join(q, "dst").select(F.least("x_src", "x_dst").alias("a"), F.greatest("x_src", "x_dst").alias("b"), "w")
    return e.select(*(F.get(c, F.lit(k)).alias(f"{n}{x}") for n, c in (("p", "a"), ("q", "b")) for k, x in enumerate("xyz")), r6("w").alias("w"))


def _draw_sql(k: int, seed: int = 1) -> str:
    m, mix = 1 << 32, lambda h: f"((xor({h}, {h} >> 16) * 73244475) % {1 << 32})"
    h = mix(mix(f"((v * 1103515245 + {k * 362437 + seed * 8675309}) % {m})"))
    return f"(xor({h}, {h} >> 16) / {float(m)}::DOUBLE)"


POINTS = "ids AS (SELECT unnest(range(1, (SELECT count(*) FROM supplier) + 1))::BIGINT AS v)"
SPHERE = f"{POINTS}, d AS (SELECT v, 2 * pi() * {_draw_sql(1)} AS t, 2 * {_draw_sql(3)} - 1 AS z FROM ids), pt AS (SELECT v, sqrt(1 - z * z) * cos(t) AS x, sqrt(1 - z * z) * sin(t) AS y, z FROM d)"


@query("gen_irregular", f"""WITH {SPHERE}, pd AS (SELECT a.v AS v, b.v AS u, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pt a JOIN pt b ON a.v <> b.v),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, u) AS r FROM pd) WHERE r <= 6), e AS (SELECT least(v, u) AS src, greatest(v, u) AS dst, min(d) AS w FROM nn GROUP BY ALL) SELECT src, dst, round(w / (SELECT median(w) FROM e), 6) AS w FROM e""")
def _(s, d):
    return rounded(generators.irregular(s, "sphere", load(s, d, "supplier").count(), 6).edges.select("src", "dst", "w"))


@query("gen_irregular_shell", f"WITH {POINTS}, d AS (SELECT v, 2 * pi() * {_draw_sql(1)} AS t, 2 * {_draw_sql(3)} - 1 AS z, cbrt(0.125 + 0.875 * {_draw_sql(0)}) AS r FROM ids) SELECT v, round(r * sqrt(1 - z * z) * cos(t), 6) + 0.0 AS x0, round(r * sqrt(1 - z * z) * sin(t), 6) + 0.0 AS x1, round(r * z, 6) + 0.0 AS x2 FROM d")
def _(s, d):
    return generators.irregular_points(s, "shell", load(s, d, "supplier").count()).select("v", *(r6(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(3)))


@query("gen_sampled_rectangle", f"""WITH {POINTS}, d AS (SELECT v, 2 * {_draw_sql(1)} - 1 AS a, 2 * {_draw_sql(2)} - 1 AS b FROM ids), pt AS (SELECT v, a AS x, b AS y, 0.5 * (a * a - b * b) AS z FROM d),
pd AS (SELECT a.v AS v, b.v AS u, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pt a JOIN pt b ON a.v <> b.v), nn AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, u) AS r FROM pd),
kk AS (SELECT unnest([3, 5]) AS k), st AS (SELECT k, v, u, d FROM nn, kk WHERE r <= k UNION ALL SELECT k, v, v, 0 FROM ids, kk)
SELECT a.k::INTEGER AS k, a.v AS src, b.v AS dst, round(min(a.d + b.d), 6) AS w FROM st a JOIN st b ON a.k = b.k AND a.u = b.u AND a.v < b.v GROUP BY ALL""")
def _(s, d):
    out = None
    for b in generators.sampled_rectangles(s, load(s, d, "supplier").count(), [3, 5]):
        e = rounded(b.edges).select(F.lit(b.attrs["k"]).alias("k"), "src", "dst", "w")
        out = e if out is None else out.union(e)
    return out


@query("agreed_targets", """SELECT i, j, target, o FROM (SELECT l_suppkey::BIGINT AS i, l_partkey::BIGINT AS j, p_size::DOUBLE AS target, l_orderkey::BIGINT AS o, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS r
FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE r = 1""")
def _(s, d):
    l = load(s, d, "lineitem").join(load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    l = l.select(F.col("l_suppkey").cast("bigint").alias("i"), F.col("l_partkey").cast("bigint").alias("j"), F.col("p_size").cast("double").alias("target"), F.col("l_orderkey").cast("bigint").alias("o"), "l_linenumber")
    return pivots.agreed(l, ["i", "j"], "target", ["o", "l_linenumber"]).drop("l_linenumber")


@query("order_breaks", "SELECT count(*) FILTER (WHERE (c, s) <= (pc, ps)) AS breaks FROM (SELECT o_custkey AS c, o_orderkey AS s, lag(o_custkey) OVER (ORDER BY o_orderkey) AS pc, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS ps FROM orders) WHERE pc IS NOT NULL")
def _(s, d):
    return pivots.order_breaks(load(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey", "o_orderkey"])


# Every third vertex is placed; each other one lies between two of these and starts from their mean, weighted by 1 / d^2, and one descent.
@query("misf_insertion", f"""WITH {XY}, a AS (SELECT v, s, abs(v - s)::DOUBLE AS g FROM xy, (VALUES (0), (3)) t(k), LATERAL (SELECT v - v % 3 + k AS s) WHERE v % 3 <> 0 AND v > 3 AND v - v % 3 + 3 <= (SELECT max(v) FROM xy)),
p AS (SELECT a.v, g, 1 / (g * g) AS w, xy.x, xy.y FROM a JOIN xy ON xy.v = a.s), z AS (SELECT v, sum(w * x) / sum(w) AS zx, sum(w * y) / sum(w) AS zy, sum(w) AS sw FROM p GROUP BY v),
q AS (SELECT v, zx, zy, sw, w, g, zx - x AS dx, zy - y AS dy, greatest(sqrt((zx - x) ** 2 + (zy - y) ** 2), 1e-12) AS l FROM p JOIN z USING (v))
SELECT v, round(zx - sum(w * (l - g) / l * dx) / sw, 6) + 0.0 AS x0, round(zy - sum(w * (l - g) / l * dy) / sw, 6) + 0.0 AS x1 FROM q GROUP BY v, zx, zy, sw""")
def _(s, d):
    c = plane(s, d)
    n = c.agg(F.max("v")).first()[0]
    new = c.where((F.col("v") % 3 != 0) & (F.col("v") > 3) & (F.col("v") - F.col("v") % 3 + 3 <= n)).select("v")
    a = new.select("v", F.explode(F.array(F.col("v") - F.col("v") % 3, F.col("v") - F.col("v") % 3 + 3)).alias("s")).withColumn("d", F.abs(F.col("v") - F.col("s")).cast("double"))
    return misf_fits.inserted(a, c.where("v % 3 = 0"), 2, 1).select("v", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(1))).alias("x1"))


# Two runs, the first two and the next two components, over a ring with longer chords.
RUNS = """rn AS (SELECT 1 AS seed, v, x, y, cluster FROM xy UNION ALL SELECT 2, vec_id + 1, embedding[3]::DOUBLE, embedding[4]::DOUBLE, label::VARCHAR FROM embeddings)"""


@query("score_runs", f"""WITH {XY}, {RING}, {RUNS}, pr AS (SELECT v AS i, v + k AS j, (k // 7 + k % 7)::DOUBLE AS d FROM xy, (VALUES (1), (4), (15)) t(k) WHERE v + k <= (SELECT max(v) FROM xy)),
o AS (SELECT seed, i, j, d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS o FROM pr JOIN rn a ON a.v = i JOIN rn b USING (seed) WHERE b.v = j),
st AS (SELECT seed, sqrt(greatest(0, sum(o * o) - sum(o * d) ** 2 / sum(d * d)) / sum(o * o)) AS s, min(o) FILTER (WHERE j - i NOT IN (1, 7)) AS gap FROM o GROUP BY seed),
el AS (SELECT seed, src, dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM ring JOIN rn a ON a.v = src JOIN rn b USING (seed) WHERE b.v = dst),
le AS (SELECT seed, median(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2)) AS m, stddev_samp(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2)) / avg(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2)) AS cv FROM el GROUP BY seed),
cr AS (SELECT p.seed, count(*) AS n FROM el p JOIN el q ON p.seed = q.seed AND (p.src, p.dst) < (q.src, q.dst) AND p.src NOT IN (q.src, q.dst) AND p.dst NOT IN (q.src, q.dst)
 WHERE ((p.bx - p.ax) * (q.ay - p.ay) - (p.b_y - p.ay) * (q.ax - p.ax)) * ((p.bx - p.ax) * (q.b_y - p.ay) - (p.b_y - p.ay) * (q.bx - p.ax)) < 0 AND ((q.bx - q.ax) * (p.ay - q.ay) - (q.b_y - q.ay) * (p.ax - q.ax)) * ((q.bx - q.ax) * (p.b_y - q.ay) - (q.b_y - q.ay) * (p.bx - q.ax)) < 0 GROUP BY p.seed),
ce AS (SELECT seed, cluster, avg(x) AS x, avg(y) AS y FROM rn GROUP BY ALL), wi AS (SELECT seed, avg(d) AS w FROM (SELECT rn.seed, cluster, avg(sqrt((rn.x - ce.x) ** 2 + (rn.y - ce.y) ** 2)) AS d FROM rn JOIN ce USING (seed, cluster) GROUP BY ALL) GROUP BY seed),
be AS (SELECT a.seed, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS b FROM ce a JOIN ce b ON a.seed = b.seed AND a.cluster < b.cluster GROUP BY a.seed)
SELECT 'plane' AS candidate, seed::INTEGER AS seed, round(s, 6) AS sampled_stress, round(m, 6) AS median_edge_length, round(cv, 6) AS edge_length_cv, round(gap / m, 6) AS sampled_nonedge_sep_ratio, coalesce(n, 0) AS edge_crossings, round(b / w, 6) AS cluster_separation
FROM st JOIN le USING (seed) JOIN wi USING (seed) JOIN be USING (seed) LEFT JOIN cr USING (seed)""")
def _(s, d):
    o = observations(s, d)
    runs = None
    for seed, at in ((1, 1), (2, 3)):
        x = o.select(F.lit("plane").alias("candidate"), F.lit(seed).alias("seed"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_message"), "v", F.slice("x", at, 2).alias("x"))
        runs = x if runs is None else runs.union(x)
    n = o.agg(F.max("v")).first()[0]
    pairs = o.select(F.col("v").alias("i"), F.explode(F.array(*map(F.lit, (1, 4, 15)))).alias("k")).select("i", (F.col("i") + F.col("k")).alias("j"), (F.floor(F.col("k") / 7) + F.col("k") % 7).cast("double").alias("d")).where(F.col("j") <= n)
    x = compare.score_runs(materialize(runs, "runs"), ring(s, d), pairs, pairs.select("i", "j"), o.select("v", "cluster"), True)
    return rounded(x.select("candidate", "seed", *compare.SCORES))


# Graphs of the catalogue at the suppliers' size: what they must have of vertices and edges.
@query("family_catalogue", f"""WITH h AS (SELECT {SIDE} AS h, {SUPPLIERS} AS n, {LEVELS} + 2 AS l), t(id, n_vertices, n_edges) AS (
SELECT 'path', n, n - 1 FROM h UNION ALL SELECT 'cycle', n, n FROM h UNION ALL SELECT 'kary_tree', (3 ** (l + 1) - 1) // 2, (3 ** (l + 1) - 1) // 2 - 1 FROM h UNION ALL SELECT 'mesh', h * 10, h * 9 + (h - 1) * 10 FROM h
UNION ALL SELECT 'cylinder', h * 12, h * 12 + (h - 1) * 12 FROM h UNION ALL SELECT 'torus', h * 12, h * 24 FROM h UNION ALL SELECT 'sphere', (h - 2) * 10 + 2, (h - 2) * 10 + (h - 3) * 10 + 20 FROM h
UNION ALL SELECT 'cube_surface', h ** 3 - (h - 2) ** 3, 12 * (h - 1) + 12 * (h - 1) * (h - 2) FROM h UNION ALL SELECT 'triangulated_polyhedron', 2 + 4 * 4 ** l, 12 * 4 ** l FROM h)
SELECT id, id AS name, id AS family, n_vertices::BIGINT AS n_vertices, n_edges::BIGINT AS n_edges, 1::BIGINT AS n_components FROM t""")
def _(s, d):
    h, n, l = side(s, d), suppliers(s, d), depth(s, d) + 2
    sizes = {"path": {"n": n}, "cycle": {"n": n}, "kary_tree": {"depth": l}, "mesh": {"h": h, "w": 10}, "cylinder": {"h": h}, "torus": {"h": h}, "sphere": {"h": h}, "cube_surface": {"side": h}, "triangulated_polyhedron": {"level": l}}
    out = None
    for f, p in sizes.items():
        b = families.build(s, f, **p)
        row = catalogue.graph_row(s, f, f, b.edges, b.coords.select("v"))
        out = row if out is None else out.union(row)
    return catalogue.check_catalogue(out)


# Frames of an update trace: one after every thousand updates and at the end of each epoch.
@query("update_trace", f"""WITH {XY}, p AS (SELECT count(*) AS n FROM xy a JOIN xy b ON a.v < b.v WHERE a.v <= 60 + (SELECT count(*) FROM supplier) // 10 AND b.v <= 60 + (SELECT count(*) FROM supplier) // 10), e AS (SELECT unnest([1, 2]) AS epoch),
f AS (SELECT epoch, u * 1000 AS update_in_epoch FROM e, p, LATERAL (SELECT unnest(range(1, n // 1000 + 1)) AS u) UNION SELECT epoch, n FROM e, p), k AS (SELECT 0 AS epoch, 0 AS update_in_epoch, 0 AS pair_updates UNION ALL SELECT epoch, update_in_epoch, (epoch - 1) * n + update_in_epoch FROM f, p)
SELECT (row_number() OVER (ORDER BY pair_updates) - 1)::INTEGER AS frame, epoch::INTEGER AS epoch, update_in_epoch::BIGINT AS update_in_epoch, pair_updates::BIGINT AS pair_updates, 60 + (SELECT count(*) FROM supplier) // 10 AS placed FROM k""")
def _(s, d):
    x = observations(s, d).where(F.col("v") <= 60 + suppliers(s, d) // 10).select("v", "x")
    a, b = (x.select(F.col("v").alias(i), F.col("x").alias(f"x{i}")) for i in ("i", "j"))
    pairs = a.join(b, F.col("i") < F.col("j")).select("i", "j", V.euclid("xi", "xj").alias("d"))
    n, c = x.count(), mds.SgdControl(epochs=2)
    m = n * (n - 1) // 2
    budget = max(1 << 22, 40 * m, mds.trace_bytes(n, 2, m, c.epochs, 1000))  # follows the suppliers, as the vertices do
    frames = mds.update_trace(pairs, every=1000, max_bytes=budget, control=c)
    return frames.groupBy("frame", "epoch", "update_in_epoch", "pair_updates").agg(F.count(F.lit(1)).alias("placed"))
