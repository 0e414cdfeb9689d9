"""Energies, residual tables, gradients and stress summaries of given coordinates; every evaluation is one set-based aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.graph import edge_lengths


def observed(pairs: DataFrame, coords: DataFrame, distance=V.euclid) -> DataFrame:
    """pairs (i, j, ...) with ``o``, the distance of the coordinates."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"_{c}")) for c in ("i", "j"))
    return pairs.join(a, "i").join(b, "j").withColumn("o", distance("_i", "_j")).drop("_i", "_j")


def fit_scale(t: str | Column = "t", o: str | Column = "o", w: str | Column | None = None) -> Column:
    """Aggregate: the factor s that brings targets s*t nearest to o."""
    t, o = (F.col(c) if isinstance(c, str) else c for c in (t, o))
    w = F.lit(1.0) if w is None else F.col(w) if isinstance(w, str) else w
    return F.sum(w * o * t) / F.sum(w * t * t)


def stress(pairs: DataFrame, coords: DataFrame, weighting: str = "uniform") -> DataFrame:
    """raw, profiled, scale, normalized: sums over pairs (i, j, d) of w (o - d)^2, then with o rescaled by its best factor."""
    x = observed(pairs, coords).withColumn("w", F.lit(1.0) if weighting == "uniform" else 1 / (F.col("d") * F.col("d")))
    s = x.agg(
        F.sum(F.col("w") * F.pow(F.col("o") - F.col("d"), 2)).alias("raw"), F.sum(F.col("w") * F.col("o") * F.col("d")).alias("od"),
        F.sum(F.col("w") * F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("dd"),
    )
    scale = F.when(F.col("oo") > 0, F.col("od") / F.col("oo")).otherwise(F.lit(1.0))
    loss = F.greatest(F.lit(0.0), F.col("dd") - F.when(F.col("oo") > 0, F.col("od") * F.col("od") / F.col("oo")).otherwise(F.lit(0.0)))
    return s.select("raw", loss.alias("profiled"), scale.alias("scale"), F.sqrt(F.col("raw") / F.col("dd")).alias("normalized"), F.sqrt(loss / F.col("dd")).alias("stress1"))


def proxy_stress(constraints: DataFrame, coords: DataFrame) -> DataFrame:
    """Sparse stress with the mean of both ends' weights count / target^2."""
    x = observed(constraints, coords).withColumn("w", (F.col("count_i") + F.col("count_j")) / (2 * F.col("target") * F.col("target")))
    return x.agg(F.sum(F.col("w") * F.pow(F.col("o") - F.col("target"), 2)).alias("proxy"), F.sum((F.col("count_i") + F.col("count_j")) / 2).alias("count")).select("proxy", F.sqrt(F.col("proxy") / F.col("count")).alias("normalized_rmse"))


def weight_range(constraints: DataFrame) -> DataFrame:
    w = constraints.select(F.explode(F.array(*((F.col(c) / (F.col("target") * F.col("target"))) for c in ("count_i", "count_j")))).alias("w")).where("w > 0")
    return w.agg(F.min("w").alias("w_min"), F.max("w").alias("w_max"))


def update_residual(constraints: DataFrame, coords: DataFrame) -> DataFrame:
    """max over vertices of the length of the weighted mean of (o - target) along unit vectors; infinite where ends with a target coincide."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"x{c}")) for c in ("i", "j"))
    x = constraints.join(a, "i").join(b, "j").withColumn("o", V.euclid("xi", "xj"))
    w = lambda c: F.col(c) / (F.col("target") * F.col("target"))
    unit = lambda p, q: F.zip_with(p, q, lambda s, t: (s - t) / F.col("o") * (F.col("o") - F.col("target")))
    both = x.select(F.explode(F.array(F.struct(F.col("i").alias("v"), w("count_i").alias("w"), unit("xi", "xj").alias("g"), "o"), F.struct(F.col("j").alias("v"), w("count_j").alias("w"), unit("xj", "xi").alias("g"), "o"))).alias("e")).select("e.*").where("w > 0")
    axis = both.select("v", "w", "o", F.posexplode("g").alias("k", "g")).groupBy("v", "k").agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("g"), F.min("o").alias("o"))
    return axis.groupBy("v").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("r"), F.min("o").alias("o")).agg(F.max(F.when(F.col("o") == 0, F.lit(float("inf"))).otherwise(F.col("r"))).alias("residual"))


def centred_motion(before: DataFrame, after: DataFrame) -> DataFrame:
    """RMS displacement once the mean translation is taken off."""
    m = before.select("v", F.col("x").alias("a")).join(after.select("v", F.col("x").alias("b")), "v").select("v", F.posexplode(V.minus("b", "a")).alias("k", "d"))
    axis = m.groupBy("k").agg(F.sum(F.col("d") * F.col("d")).alias("ss"), F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    return axis.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))) / F.max("n")).alias("motion"))


def path_lengths(pairs: DataFrame, path_edges: DataFrame, coords: DataFrame, eps: float = 1e-8) -> DataFrame:
    """pairs (i, j, g) with ``h``, the embedded length of their retained paths (i, j, u, v, coeff)."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"_{c}")) for c in ("u", "v"))
    e = path_edges.join(a, "u").join(b, "v").withColumn("l", F.col("coeff") * V.soft_length("_u", "_v", eps))
    return pairs.join(e.groupBy("i", "j").agg(F.sum("l").alias("h")), ["i", "j"])


def geodesic_energy(pairs: DataFrame, path_edges: DataFrame, coords: DataFrame, k: float = 1.0, floor: float = 1e-8, scale: float | None = None) -> DataFrame:
    """energy and scale of half the sum of k / g^2 (h - scale g)^2; the scale is profiled if not given."""
    x = path_lengths(pairs, path_edges, coords).withColumn("w", F.lit(k) / F.pow(F.greatest("g", F.lit(floor)), 2))
    s = x.agg(fit_scale("g", "h", "w").alias("fit"), F.sum(F.col("w") * F.col("h") * F.col("h")).alias("hh"), F.sum(F.col("w") * F.col("h") * F.col("g")).alias("hg"), F.sum(F.col("w") * F.col("g") * F.col("g")).alias("gg"), F.count(F.lit(1)).alias("pairs"))
    l = F.col("fit") if scale is None else F.lit(float(scale))
    return s.select((0.5 * (F.col("hh") - 2 * l * F.col("hg") + l * l * F.col("gg"))).alias("energy"), l.alias("scale"), "pairs")


def edge_energy(edges: DataFrame, coords: DataFrame, scale: float | None = None) -> DataFrame:
    """Half the sum of k (len - s w)^2 over edges (k 1 unless a column)."""
    e = edge_lengths(edges, coords).withColumn("k", F.col("k") if "k" in edges.columns else F.lit(1.0))
    s = e.agg(fit_scale("w", "len", "k").alias("fit"), *(F.sum(F.col("k") * F.col(a) * F.col(b)).alias(n) for n, a, b in (("ll", "len", "len"), ("lw", "len", "w"), ("ww", "w", "w"))))
    c = F.col("fit") if scale is None else F.lit(float(scale))
    return s.select((0.5 * (F.col("ll") - 2 * c * F.col("lw") + c * c * F.col("ww"))).alias("energy"), c.alias("scale"))


def edge_gradient(edges: DataFrame, coords: DataFrame, scale: float = 1.0) -> DataFrame:
    """v, g: the gradient of ``edge_energy`` at a fixed scale, long by axis (v, axis, g)."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"x_{c}")) for c in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst").withColumn("len", V.euclid("x_src", "x_dst")).where("len > 0").withColumn("k", F.col("k") if "k" in edges.columns else F.lit(1.0))
    pull = F.col("k") * (F.col("len") - scale * F.col("w")) / F.col("len")
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("v"), V.minus("x_src", "x_dst").alias("d")), F.struct(F.col("dst").alias("v"), V.minus("x_dst", "x_src").alias("d")))).alias("q"), pull.alias("p"))
    return both.select("q.v", "p", F.posexplode("q.d").alias("axis", "d")).groupBy("v", "axis").agg(F.sum(F.col("p") * F.col("d")).alias("g"))


def length_stiffness(edges: DataFrame, mode: str = "power", power: float = -1.0, transform: str = "identity", mix: float = 1.0, low: float = 0.0, high: float = float("inf"), bandwidth: float | None = None) -> DataFrame:
    """src, dst, w, k: uniform, power (w / median)^p, or density (direct Gaussian sum) stiffness; transformed, mean one, mixed with 1, clipped, mean one again."""
    e = edges.select("src", "dst", "w")
    if mode == "uniform":
        e = e.withColumn("k", F.lit(1.0))
    elif mode == "power":
        e = e.crossJoin(F.broadcast(e.agg(F.percentile("w", F.lit(0.5)).alias("m")))).withColumn("k", F.pow(F.col("w") / F.col("m"), F.lit(power)))  # one row
    elif mode == "density":
        s = e.agg(F.stddev_samp("w").alias("sd"), (F.percentile("w", F.lit(0.75)) - F.percentile("w", F.lit(0.25))).alias("iqr"), F.count(F.lit(1)).alias("n")).first()
        h = bandwidth or 0.9 * min(x for x in (s.sd, s.iqr / 1.34) if x) * s.n**-0.2 if s.n > 1 and (s.sd or s.iqr) else 1.0
        lengths = e.groupBy(F.bround("w", 9).alias("at")).agg(F.count(F.lit(1)).alias("c"))  # distinct lengths
        grid = e.agg(F.min("w").alias("lo"), F.max("w").alias("hi")).select("lo", ((F.col("hi") - F.col("lo")) / 511).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(511))).alias("b"))
        grid = grid.select("lo", "step", "b", (F.col("lo") + F.col("b") * F.col("step")).alias("x"))
        dens = F.broadcast(grid).crossJoin(lengths).groupBy("lo", "step", "b").agg((F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("at")) / h, 2))) / (s.n * h * 2.5066282746310002)).alias("f"))  # 512 points of a grid
        dens = dens.groupBy("lo", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "f"))), lambda t: t["f"]).alias("f"))
        at = F.when(F.col("step") > 0, (F.col("w") - F.col("lo")) / F.col("step")).otherwise(F.lit(0.0))
        low_b = F.least(F.floor(at), F.lit(510)).cast("int")
        e = e.crossJoin(F.broadcast(dens)).withColumn("k", F.get("f", low_b) + (at - low_b) * (F.get("f", low_b + 1) - F.get("f", low_b)))
    else:
        raise ValueError(f"unknown stiffness {mode!r}")
    e = e.withColumn("k", V.stiffness(F.col("k"), transform))
    one = lambda d: d.crossJoin(F.broadcast(d.agg(F.avg("k").alias("mk")))).select("src", "dst", "w", F.when(F.col("mk") > 0, F.col("k") / F.col("mk")).otherwise(F.lit(1.0)).alias("k"))  # noqa: E731  one row
    e = one(e).withColumn("k", F.lit(1.0 - mix) + mix * F.col("k")).withColumn("k", F.least(F.greatest("k", F.lit(low)), F.lit(high)))
    return one(e)


def repulsion_cache(pairs: DataFrame, hop_min: int = 3, quantile: float = 0.60, target_quantile: float = 0.90, share: float = 0.20) -> DataFrame:
    """Pairs (i, j, g, hop) far enough to repel, and their target distance."""
    if hop_min < 2:
        raise ValueError("pairs within one hop are edges")
    p = pairs.where((F.col("g") > 0) & (F.col("hop") >= hop_min))
    q = p.agg(F.percentile("g", F.lit(quantile)).alias("lo"), F.percentile("g", F.lit(target_quantile)).alias("hi"))
    return p.crossJoin(F.broadcast(q)).where("g >= lo").select("i", "j", "g", (share * F.least("g", "hi")).alias("target"))  # one row


def repulsive_state(pairs: DataFrame, coords: DataFrame, weight: float = 1.0, delta: float = 1e-3, power: float = 0.0) -> DataFrame:
    return observed(pairs, coords).agg((weight * F.sum(V.repulsion_potential(F.col("o"), delta, power))).alias("energy"), F.min("o").alias("closest"))


def edge_repulsive_state(edges: DataFrame, pairs: DataFrame, coords: DataFrame, weight: float = 0.1, kind: str = "quadratic", beta: float = 1.0, eps_plus: float = 0.5, delta: float = 1e-3, power: float = 0.0) -> DataFrame:
    e = edge_lengths(edges, coords).agg(F.sum(V.edge_potential(F.col("len"), F.col("w"), kind, beta, eps_plus)).alias("edge_energy"))
    return e.crossJoin(repulsive_state(pairs, coords, weight, delta, power)).select("edge_energy", F.col("energy").alias("repulsion_energy"), (F.col("edge_energy") + F.col("energy")).alias("energy"))  # one row each


def star_pairs(edges: DataFrame, coords: DataFrame, q: float = 1.0) -> DataFrame:
    """center, neighbor_1, neighbor_2, w_1, w_2, cos_angle, reliability, angle_weight: each unordered pair of a vertex's neighbours."""
    from meshlark.operators.graph import adjacency

    x = adjacency(edges).join(coords.select(F.col("v").alias("dst"), F.col("x").alias("xn")), "dst").join(coords.select(F.col("v").alias("src"), F.col("x").alias("xc")), "src")
    a = x.select(F.col("src").alias("center"), F.col("dst").alias("n"), "w", V.minus("xn", "xc").alias("e"))
    l, r = a.alias("l"), a.alias("r")
    p = l.join(r, F.col("l.center") == F.col("r.center")).where("l.n < r.n").select("l.center", F.col("l.n").alias("neighbor_1"), F.col("r.n").alias("neighbor_2"), F.col("l.w").alias("w_1"), F.col("r.w").alias("w_2"), V.dot("l.e", "r.e").alias("dot"), (V.norm("l.e") * V.norm("r.e")).alias("len"))
    p = p.where("len > 0").withColumn("cos_angle", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("dot") / F.col("len")))).withColumn("reliability", F.least("w_1", "w_2") / F.greatest("w_1", "w_2"))
    return p.select("center", "neighbor_1", "neighbor_2", "w_1", "w_2", "cos_angle", "reliability", (F.col("reliability") * F.pow((1 - F.col("cos_angle")) / 2, F.lit(q))).alias("angle_weight"))


def gram_energy(stars: DataFrame, coords: DataFrame, scale: float = 1.0) -> DataFrame:
    """Half the sum of angle_weight (<a, b> - s^2 w1 w2 cos)^2."""
    c = [coords.select(F.col("v").alias(n), F.col("x").alias(f"x{k}")) for k, n in enumerate(("center", "neighbor_1", "neighbor_2"))]
    s = stars.join(c[0], "center").join(c[1], "neighbor_1").join(c[2], "neighbor_2")
    r = V.dot(V.minus("x1", "x0"), V.minus("x2", "x0")) - scale * scale * F.col("w_1") * F.col("w_2") * F.col("cos_angle")
    return s.agg((0.5 * F.sum(F.col("angle_weight") * r * r)).alias("energy"), F.count(F.lit(1)).alias("stars"))


def smoothness(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """Half the sum over vertices of |x - mean of neighbours|^2."""
    from meshlark.operators.graph import adjacency

    n = adjacency(edges).join(coords.select(F.col("v").alias("dst"), F.col("x").alias("xn")), "dst").select("src", F.posexplode("xn").alias("k", "m")).groupBy("src", "k").agg(F.avg("m").alias("m"))
    x = coords.select(F.col("v").alias("src"), F.posexplode("x").alias("k", "x"))
    return x.join(n, ["src", "k"]).agg((0.5 * F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("energy"))


def bending(stencils: DataFrame, coords: DataFrame) -> DataFrame:
    """Half the sum over stencils (a, b, c) of |x_a - 2 x_b + x_c|^2."""
    s = stencils
    for n in "abc":
        s = s.join(coords.select(F.col("v").alias(n), F.col("x").alias(f"x{n}")), n)
    return s.agg((0.5 * F.sum(V.dot(V.minus(V.minus("xa", "xb"), V.minus("xb", "xc")), V.minus(V.minus("xa", "xb"), V.minus("xb", "xc"))))).alias("energy"))


def anchor(coords: DataFrame, anchors: DataFrame, weight: float = 1.0) -> DataFrame:
    d = V.minus("x", "y")
    return coords.select("v", "x").join(anchors.select("v", F.col("x").alias("y")), "v").agg((0.5 * weight * F.sum(V.dot(d, d))).alias("energy"))
