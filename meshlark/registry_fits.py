"""Queries of the layout refinements: one accepted step of each descent, and its SQL twin that tries the same step sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.operators import catalogue, fits, misf_fits, quality, traces
from meshlark.registry import GEO, PAIRS, RING, STARS, XY, _pairs, _ring_w, geo_tree, load, observations, plane, query, r6, ring, rounded, vertices_of
from meshlark.sources import readers


def _len(s: str = "s") -> str:
    return f"sqrt(((a.x - {s} * a.gx) - (b.x - {s} * b.gx)) ** 2 + ((a.y - {s} * a.gy) - (b.y - {s} * b.gy)) ** 2)"


def step_sql(ctes: str, pulls: str, energies: list[str]) -> str:
    """``pulls``: rows (v, gx, gy); ``energies``: queries of (s, e) over the step sizes k, coordinates st (v, x, y, gx, gy) and items. Step size 0 is the start."""
    return f"""WITH {ctes}, gr AS (SELECT v, sum(gx) AS gx, sum(gy) AS gy FROM ({pulls}) GROUP BY v), st AS (SELECT xy.v, x, y, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy FROM xy LEFT JOIN gr USING (v)),
k AS (SELECT 0.0::DOUBLE AS s UNION ALL SELECT pow(0.5, n) FROM range(0, 8) t(n)), ek AS (SELECT s, sum(e) AS e FROM ({" UNION ALL ".join(energies)}) GROUP BY s),
best AS (SELECT max(s) AS s FROM ek WHERE s > 0 AND e <= (SELECT e FROM ek WHERE s = 0) - 0.0001 * s * (SELECT sum(gx * gx + gy * gy) FROM st)), n AS (SELECT v, x - s * gx AS x, y - s * gy AS y FROM st, best)
SELECT v, round(x - avg(x) OVER (), 6) + 0.0 AS x0, round(y - avg(y) OVER (), 6) + 0.0 AS x1 FROM n"""


def _coords(fit: fits.Fit):
    return fit.coords.select("v", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(1))).alias("x1"))


EDGES = f"{XY}, {RING}, ed AS (SELECT src, dst, (dst - src)::DOUBLE AS w FROM ring), q AS (SELECT src, dst, w, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS l FROM ed JOIN xy a ON a.v = src JOIN xy b ON b.v = dst)"
EDGE_PULLS = "SELECT src AS v, (l - w) / l * dx AS gx, (l - w) / l * dy AS gy FROM q UNION ALL SELECT dst, -(l - w) / l * dx, -(l - w) / l * dy FROM q"
EDGE_ENERGY = f"SELECT s, 0.5 * sum(({_len()} - w) ** 2) AS e FROM ed JOIN st a ON a.v = src JOIN st b ON b.v = dst, k GROUP BY s"
APART = "SELECT i AS v, -{w} / (o * o + 0.000001) * dx AS gx, -{w} / (o * o + 0.000001) * dy AS gy FROM rp UNION ALL SELECT j, {w} / (o * o + 0.000001) * dx, {w} / (o * o + 0.000001) * dy FROM rp"
APART_ENERGY = "SELECT s, {w} * sum(-0.5 * ln(LEN * LEN + 0.000001)) AS e FROM pr JOIN st a ON a.v = i JOIN st b ON b.v = j, k GROUP BY s".replace("LEN", _len())
REPEL = f"{PAIRS}, rp AS (SELECT i, j, o, a.x - b.x AS dx, a.y - b.y AS dy FROM pr JOIN xy a ON a.v = i JOIN xy b ON b.v = j)"


@query("edge_kk_step", step_sql(EDGES, EDGE_PULLS, [EDGE_ENERGY]))
def _(s, d):
    return _coords(fits.edge_kk(_ring_w(s, d), plane(s, d), (0.0,), "identity", max_iter=1))


# The stiffness 1 / w^2 of level-by-level fits: relative errors of all lengths count alike.
@query("misf_refine_step", step_sql(
    EDGES,
    "SELECT src AS v, (l - w) / (l * w * w) * dx AS gx, (l - w) / (l * w * w) * dy AS gy FROM q UNION ALL SELECT dst, -(l - w) / (l * w * w) * dx, -(l - w) / (l * w * w) * dy FROM q",
    [f"SELECT s, 0.5 * sum((({_len()} - w) / w) ** 2) AS e FROM ed JOIN st a ON a.v = src JOIN st b ON b.v = dst, k GROUP BY s"],
))
def _(s, d):
    return _coords(misf_fits.refine(_ring_w(s, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("d")), plane(s, d), max_iter=1))


@query("repulsive_stage_step", step_sql(f"{XY}, {REPEL}", APART.format(w=0.5), [APART_ENERGY.format(w=0.5)]))
def _(s, d):
    return _coords(fits.repulsive_stage(_pairs(s, d), plane(s, d), 0.5, max_iter=1))


@query("edge_repulsive_stage_step", step_sql(
    f"{EDGES}, {REPEL}",
    "SELECT src AS v, (l / w - 1) / (w * l) * dx AS gx, (l / w - 1) / (w * l) * dy AS gy FROM q UNION ALL SELECT dst, -(l / w - 1) / (w * l) * dx, -(l / w - 1) / (w * l) * dy FROM q UNION ALL " + APART.format(w=0.1),
    [f"SELECT s, sum(0.5 * ({_len()} / w - 1) ** 2) AS e FROM ed JOIN st a ON a.v = src JOIN st b ON b.v = dst, k GROUP BY s", APART_ENERGY.format(w=0.1)],
))
def _(s, d):
    return _coords(fits.edge_repulsive_stage(_ring_w(s, d), _pairs(s, d), plane(s, d), 0.1, max_iter=1))


@query("geodesic_kk_step", step_sql(
    f"""{XY}, p AS (SELECT v AS i, v + 2 AS j FROM xy WHERE v + 2 <= (SELECT max(v) FROM xy)),
h AS (SELECT i, j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 1e-16) AS l, sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2 + 1e-16) AS m, a.x - b.x AS ax, a.y - b.y AS ay, b.x - c.x AS bx, b.y - c.y AS b_y FROM p JOIN xy a ON a.v = i JOIN xy b ON b.v = i + 1 JOIN xy c ON c.v = j),
f AS (SELECT sum((l + m) / 2) / count(*) AS sc FROM h), q AS (SELECT *, 0.25 * (l + m - 2 * sc) AS o FROM h, f)""",
    "SELECT i AS v, o / l * ax AS gx, o / l * ay AS gy FROM q UNION ALL SELECT i + 1, -o / l * ax + o / m * bx, -o / l * ay + o / m * b_y FROM q UNION ALL SELECT j, -o / m * bx, -o / m * b_y FROM q",
    [f"SELECT s, 0.5 * (sum(0.25 * h * h) - sum(0.5 * h) ** 2 / count(*)) AS e FROM (SELECT s, p.i, sqrt({_len()} ** 2 + 1e-16) + sqrt({_len().replace('a.', 'c.')} ** 2 + 1e-16) AS h FROM p JOIN st a ON a.v = p.i JOIN st b ON b.v = p.i + 1 JOIN st c ON c.v = p.j, k) GROUP BY s"],
))
def _(s, d):
    n = load(s, d, "embeddings").count()
    p = s.range(1, n - 1).select(F.col("id").alias("i"), (F.col("id") + 2).alias("j"), F.lit(2.0).alias("g"))
    e = p.select("i", "j", F.explode(F.array(F.struct(F.col("i").alias("u"), (F.col("i") + 1).alias("v")), F.struct((F.col("i") + 1).alias("u"), F.col("j").alias("v")))).alias("q"), F.lit(1.0).alias("coeff")).select("i", "j", "q.u", "q.v", "coeff")
    return _coords(fits.geodesic_kk(p, e, plane(s, d), max_iter=1))


_MOVED = "({0}.{1} - s * {0}.g{1})"
_VEC = lambda n, c: f"({_MOVED.format(n, c)} - {_MOVED.format('c', c)})"


@query("kernel_gram_step", step_sql(
    STARS.removeprefix("WITH ") + f""", ed AS (SELECT src, dst, w FROM l), q AS (SELECT src, dst, w, dx, dy, len AS l FROM l),
sq AS (SELECT center, neighbor_1, neighbor_2, w_1 * w_2 * cos_angle AS t, reliability * (1 - cos_angle) / 2 AS kk, a.x - c.x AS ax, a.y - c.y AS ay, b.x - c.x AS bx, b.y - c.y AS b_y FROM st_ JOIN xy c ON c.v = center JOIN xy a ON a.v = neighbor_1 JOIN xy b ON b.v = neighbor_2),
so AS (SELECT *, kk * (ax * bx + ay * b_y - t) AS f FROM sq)""",
    EDGE_PULLS + " UNION ALL SELECT neighbor_1, f * bx, f * b_y FROM so UNION ALL SELECT neighbor_2, f * ax, f * ay FROM so UNION ALL SELECT center, -f * (ax + bx), -f * (ay + b_y) FROM so",
    [EDGE_ENERGY, f"SELECT s, 0.5 * sum(kk * ({_VEC('a', 'x')} * {_VEC('b', 'x')} + {_VEC('a', 'y')} * {_VEC('b', 'y')} - t) ** 2) AS e FROM sq JOIN st c ON c.v = center JOIN st a ON a.v = neighbor_1 JOIN st b ON b.v = neighbor_2, k GROUP BY s"],
).replace("st AS (SELECT a.c AS center", "st_ AS (SELECT a.c AS center"))
def _(s, d):
    p = plane(s, d)
    return _coords(fits.kernel_gram_gkk(_ring_w(s, d), p, p, max_iter=1))


# Scores, sources and catalogues -----------------------------------------------------------------------------------------


RANKED = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query("classical_score", f"""WITH {XY}, {PAIRS}, r AS (SELECT o, d, {RANKED.format("o")} AS ro, {RANKED.format("d")} AS rd FROM pr)
SELECT count(*) AS n_pairs, round(sum((o - d) ** 2), 6) AS raw_stress, round(sqrt(sum((o - d) ** 2) / sum(d * d)), 6) AS stress, round(sqrt(avg((o - d) ** 2)), 6) AS rmse, round(avg(abs(o - d)), 6) AS mae,
round(avg(abs(o - d) / d), 6) AS mre, round(corr(d, o), 6) AS pearson, round(corr(rd, ro), 6) AS spearman FROM r""")
def _(s, d):
    return rounded(quality.classical_score(_pairs(s, d), plane(s, d)))


@query("order_correlation", f"""WITH o AS (SELECT o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b FROM orders), r AS (SELECT a, b, {RANKED.format("a")} AS ra, {RANKED.format("b")} AS rb FROM o)
SELECT round(corr(a, b), 6) + 0.0 AS pearson, round(corr(ra, rb), 6) + 0.0 AS spearman FROM r""")
def _(s, d):
    return rounded(quality.correlations(load(s, d, "orders").select(F.col("o_totalprice").cast("double").alias("a"), F.col("o_custkey").cast("double").alias("b")), "a", "b"))


#: In the plane the best turn (reflected or not) has a closed form: the sums of products of centred coordinates give its cosine part.
@query("target_alignment", f"""WITH {XY}, c AS (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM xy), n AS (SELECT x / max(sqrt(x * x + y * y)) OVER () AS a, y / max(sqrt(x * x + y * y)) OVER () AS b, y / max(sqrt(y * y + z * z)) OVER () AS p, z / max(sqrt(y * y + z * z)) OVER () AS q FROM c),
s AS (SELECT sum(a * p) AS ap, sum(a * q) AS aq, sum(b * p) AS bp, sum(b * q) AS bq, sum(a * a + b * b + p * p + q * q) AS ss, count(*) AS n FROM n)
SELECT round(sqrt((ss - 2 * greatest(sqrt((ap + bq) ** 2 + (bp - aq) ** 2), sqrt((ap - bq) ** 2 + (bp + aq) ** 2))) / n), 6) AS rmse FROM s""")
def _(s, d):
    x = observations(s, d)
    return rounded(quality.target_alignment(x.select("v", F.slice("x", 1, 2).alias("x")), x.select("v", F.slice("x", 2, 2).alias("x"))))


@query("feature_table", """WITH c AS (SELECT l_suppkey::BIGINT AS s, l_partkey::BIGINT AS f, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0), h AS (SELECT s, sum(n) AS had FROM c GROUP BY s),
f AS (SELECT f FROM c GROUP BY f HAVING count(*) >= 0.1 * (SELECT count(*) FROM h)), l AS (SELECT * FROM c WHERE f IN (FROM f)), t AS (SELECT s, sum(n) AS total FROM l GROUP BY s)
SELECT s AS sample, l.f AS feature, round(n / total, 6) AS p FROM l JOIN t USING (s) JOIN h USING (s) WHERE total >= 20 AND total >= 0.01 * had""")
def _(s, d):
    c = load(s, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("sample"), F.col("l_partkey").cast("bigint").alias("feature"), F.col("l_quantity").cast("double").alias("n"))
    return rounded(readers.feature_table(c, 0.1, 20, 0.01))


@query("graph_catalogue", f"""WITH RECURSIVE {GEO}, {XY}, {RING}, gv AS (SELECT DISTINCT src AS v FROM adj)
SELECT 'tables/geo' AS id, 'geo' AS name, 'tree' AS family, (SELECT count(*) FROM gv) AS n_vertices, (SELECT count(*) FROM geo) AS n_edges, (SELECT count(*) FROM gv) - (SELECT count(*) FROM geo) AS n_components
UNION ALL SELECT 'tables/ring', 'ring', 'circulant', (SELECT count(*) FROM xy), (SELECT count(*) FROM ring), 1""")
def _(s, d):
    g = geo_tree(s, d)
    c = catalogue.graph_row(s, "tables/geo", "tree", g, vertices_of(g)).union(catalogue.graph_row(s, "tables/ring", "circulant", ring(s, d), observations(s, d).select("v")))
    return catalogue.check_catalogue(c)


@query("attached_layouts", """WITH l AS (SELECT DISTINCT p_brand AS candidate, p_size::INTEGER AS seed FROM part), x AS (SELECT p_brand AS candidate, p_size::INTEGER AS seed, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
SELECT candidate, seed, coalesce(x.n, 0) AS n_coords, CASE WHEN x.n > 0 THEN 'interactive' ELSE 'summary-only' END AS availability, x.n IS NOT NULL AS viewable FROM l LEFT JOIN x USING (candidate, seed)""")
def _(s, d):
    p = load(s, d, "part").select(F.col("p_brand").alias("candidate"), F.col("p_size").cast("int").alias("seed"), F.col("p_partkey").alias("v"))
    return catalogue.attach_layouts(p.select("candidate", "seed").distinct(), p.where("seed % 2 = 0")).select("candidate", "seed", "n_coords", "availability", "viewable")


# A trace of three frames: frame k has the vertices up to (k + 1) / 3 of all, at k + 1 times their places.
FRAMES = f"{XY}, {RING}, fr AS (SELECT k AS frame, v, (k + 1) * x AS x, (k + 1) * y AS y FROM xy, range(3) t(k) WHERE 3 * v <= (k + 1) * (SELECT max(v) FROM xy))"


@query("trace_diagnostics", f"""WITH {FRAMES}, l AS (SELECT a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM ring JOIN fr a ON a.v = src JOIN fr b ON b.v = dst AND b.frame = a.frame),
e AS (SELECT frame, count(*) AS n, stddev_samp(len) / avg(len) AS cv, median(len) AS m FROM l GROUP BY frame), {PAIRS},
p AS (SELECT a.frame, i, j, d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS q FROM pr JOIN fr a ON a.v = i JOIN fr b ON b.v = j AND b.frame = a.frame),
s AS (SELECT frame, sqrt((sum(q * q) - sum(q * d) ** 2 / sum(d * d)) / sum(q * q)) AS stress FROM p GROUP BY frame), c AS (SELECT frame, min(q) AS q FROM p WHERE NOT EXISTS (SELECT 1 FROM ring WHERE src = i AND dst = j) GROUP BY frame)
SELECT frame::INTEGER AS frame, (SELECT count(*) FROM fr f WHERE f.frame = e.frame)::INTEGER AS active_vertices, n AS active_edges, round(cv, 6) AS edge_length_cv, round(m, 6) AS median_edge_length, round(c.q / m, 6) AS nonedge_sep_ratio, round(stress, 6) AS sampled_stress
FROM e JOIN s USING (frame) JOIN c USING (frame)""")
def _(s, d):
    x = plane(s, d)
    n = load(s, d, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    f = x.withColumn("frame", F.explode(F.array(*(F.lit(k) for k in range(3))))).where(3 * F.col("v") <= (F.col("frame") + 1) * n)
    f = f.select("frame", "v", F.transform("x", lambda a: a * (F.col("frame") + 1)).alias("x"))
    return rounded(traces.diagnostics(f, ring(s, d), "full", _pairs(s, d), _pairs(s, d)))
