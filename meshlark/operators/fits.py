"""Layout refinements as queries: gradient descent with Armijo backtracking over tables of coordinates.

A term has a table of items (edges, paths, star pairs, repelling pairs) and says what they add to the energy. A descent takes one job for the gradient, one for its
length, and one for the energies of several step sizes at once: moved coordinates are expressions over the joined row, so no step size is a job of its own. State goes to the
shared folder, and each step's predecessor is deleted. The energy never rises; a descent ends with ``gradient_tolerance``, ``minimum_step`` or ``iteration_limit``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.objectives import length_stiffness, star_pairs
from meshlark.plans.shared import discard, materialize

TRIES = 8


def moved(c: str, step: float) -> Column:
    return F.zip_with(f"{c}_x", f"{c}_g", lambda a, b: a - F.lit(float(step)) * b)


def ends(items: DataFrame, state: DataFrame, *names: str) -> DataFrame:
    """``items`` with the coordinates and gradients of the vertices in the named columns."""
    for n in names:
        items = items.join(state.select(F.col("v").alias(n), F.col("x").alias(f"{n}_x"), F.col("g").alias(f"{n}_g")), n)
    return items


def spread(rows: DataFrame, pulls: list[tuple[str, Column]], dim: int) -> DataFrame:
    """v, g: the sum of what the rows pull at each vertex; ``pulls`` are (vertex column, vector)."""
    both = rows.select(F.explode(F.array(*(F.struct(F.col(n).alias("v"), p.alias("g")) for n, p in pulls))).alias("e")).select("e.*")
    return both.groupBy("v").agg(F.array(*(F.sum(F.get("g", F.lit(k))) for k in range(dim))).alias("g"))


def times(c: Column, d: Column) -> Column:
    return F.transform(d, lambda a: c * a)


@dataclass
class Term:
    """``sums`` has one row of aggregates a step size; ``value`` makes (energy, scale) of them; ``gradient`` is at the present coordinates and scale."""

    weight: float = 1.0

    def sums(self, state: DataFrame, steps: list[float]) -> list[dict]:
        raise NotImplementedError

    def value(self, row: dict) -> tuple[float, float]:
        raise NotImplementedError

    def gradient(self, state: DataFrame, scale: float, dim: int) -> DataFrame:
        raise NotImplementedError


def _profiled(row: dict, scale: float | None) -> tuple[float, float]:
    """Half the sum of k (h - s g)^2 from its moments; s is the best one if not given."""
    s = scale if scale is not None else (row["hg"] / row["gg"] if row["gg"] else 1.0)
    return 0.5 * max(0.0, row["hh"] - 2 * s * row["hg"] + s * s * row["gg"]), s


def _moments(df: DataFrame, h: list[Column], g: Column, k: Column) -> list[dict]:
    cols = [F.sum(k * a * b).alias(f"{n}{i}") for i, x in enumerate(h) for n, a, b in (("hh", x, x), ("hg", x, g))]
    r = df.agg(F.sum(k * g * g).alias("gg"), *cols).first()
    return [{"gg": r["gg"] or 0.0, "hh": r[f"hh{i}"] or 0.0, "hg": r[f"hg{i}"] or 0.0} for i in range(len(h))]


@dataclass
class EdgeTerm(Term):
    """Half the sum of k (len - s w)^2 over edges (src, dst, w, k)."""

    edges: DataFrame = None
    scale: float | None = None

    def sums(self, state, steps):
        e = ends(self.edges, state, "src", "dst")
        return _moments(e, [V.euclid(moved("src", s), moved("dst", s)) for s in steps], F.col("w"), F.col("k"))

    def value(self, row):
        return _profiled(row, self.scale)

    def gradient(self, state, scale, dim):
        e = ends(self.edges, state, "src", "dst").withColumn("len", V.euclid("src_x", "dst_x")).where("len > 0")
        pull = F.col("k") * (F.col("len") - F.lit(scale) * F.col("w")) / F.col("len")
        return spread(e, [("src", times(pull, V.minus("src_x", "dst_x"))), ("dst", times(pull, V.minus("dst_x", "src_x")))], dim)


@dataclass
class PathTerm(Term):
    """Half the sum over pairs (i, j, g) of k / g^2 (h - s g)^2, where h is the embedded length of the pair's retained path (i, j, u, v, coeff)."""

    pairs: DataFrame = None
    path_edges: DataFrame = None
    k: float = 1.0
    floor: float = 1e-8
    eps: float = 1e-8
    scale: float | None = None

    def _weight(self) -> Column:
        return F.lit(self.k) / F.pow(F.greatest("g", F.lit(self.floor)), 2)

    def sums(self, state, steps):
        e = ends(self.path_edges.withColumnRenamed("v", "t"), state, "u", "t")
        h = e.groupBy("i", "j").agg(*(F.sum(F.col("coeff") * V.soft_length(moved("u", s), moved("t", s), self.eps)).alias(f"h{n}") for n, s in enumerate(steps)))
        return _moments(self.pairs.join(h, ["i", "j"]), [F.col(f"h{n}") for n in range(len(steps))], F.col("g"), self._weight())

    def value(self, row):
        return _profiled(row, self.scale)

    def gradient(self, state, scale, dim):
        e = ends(self.path_edges.withColumnRenamed("v", "t"), state, "u", "t").withColumn("l", V.soft_length("u_x", "t_x", self.eps))
        h = e.groupBy("i", "j").agg(F.sum(F.col("coeff") * F.col("l")).alias("h"))
        off = self.pairs.join(h, ["i", "j"]).select("i", "j", (self._weight() * (F.col("h") - F.lit(scale) * F.col("g"))).alias("off"))
        e = e.join(off, ["i", "j"])
        pull = F.col("off") * F.col("coeff") / F.col("l")
        return spread(e, [("u", times(pull, V.minus("u_x", "t_x"))), ("t", times(pull, V.minus("t_x", "u_x")))], dim)


@dataclass
class GramTerm(Term):
    """Half the sum over star pairs of angle_weight (<a, b> - s^2 w1 w2 cos)^2, a and b the vectors from the centre to its two neighbours."""

    stars: DataFrame = None
    scale: float = 1.0

    def _off(self, a: Column, b: Column) -> Column:
        return V.dot(a, b) - self.scale**2 * F.col("w_1") * F.col("w_2") * F.col("cos_angle")

    def sums(self, state, steps):
        e = ends(self.stars, state, "center", "neighbor_1", "neighbor_2")
        off = [self._off(V.minus(moved("neighbor_1", s), moved("center", s)), V.minus(moved("neighbor_2", s), moved("center", s))) for s in steps]
        r = e.agg(*(F.sum(F.col("angle_weight") * x * x).alias(f"e{n}") for n, x in enumerate(off))).first()
        return [{"e": r[f"e{n}"] or 0.0} for n in range(len(steps))]

    def value(self, row):
        return 0.5 * row["e"], self.scale

    def gradient(self, state, scale, dim):
        e = ends(self.stars, state, "center", "neighbor_1", "neighbor_2").withColumn("a", V.minus("neighbor_1_x", "center_x")).withColumn("b", V.minus("neighbor_2_x", "center_x"))
        f = F.col("angle_weight") * self._off(F.col("a"), F.col("b"))
        back = F.zip_with("a", "b", lambda p, q: -f * (p + q))
        return spread(e, [("neighbor_1", times(f, F.col("b"))), ("neighbor_2", times(f, F.col("a"))), ("center", back)], dim)


@dataclass
class RepulsionTerm(Term):
    """The sum over pairs (i, j) of -log(r^2 + delta^2) / 2, or (r^2 + delta^2)^(-power / 2)."""

    pairs: DataFrame = None
    delta: float = 1e-3
    power: float = 0.0

    def sums(self, state, steps):
        e = ends(self.pairs.select("i", "j"), state, "i", "j")
        r = e.agg(*(F.sum(V.repulsion_potential(V.euclid(moved("i", s), moved("j", s)), self.delta, self.power)).alias(f"e{n}") for n, s in enumerate(steps))).first()
        return [{"e": r[f"e{n}"] or 0.0} for n in range(len(steps))]

    def value(self, row):
        return row["e"], 1.0

    def gradient(self, state, scale, dim):
        e = ends(self.pairs.select("i", "j"), state, "i", "j").withColumn("q", F.pow(V.euclid("i_x", "j_x"), 2) + self.delta**2)
        f = -1 / F.col("q") if self.power == 0 else -self.power * F.pow("q", F.lit(-self.power / 2 - 1))
        return spread(e, [("i", times(f, V.minus("i_x", "j_x"))), ("j", times(f, V.minus("j_x", "i_x")))], dim)


@dataclass
class EdgePotentialTerm(Term):
    """The sum over edges of (len / w - 1)^2 / 2, with an upper barrier if asked; lengths past the barrier have infinite energy."""

    edges: DataFrame = None
    kind: str = "quadratic"
    beta: float = 1.0
    eps_plus: float = 0.5

    def sums(self, state, steps):
        e = ends(self.edges.select("src", "dst", "w"), state, "src", "dst")
        r = e.agg(*(F.sum(V.edge_potential(V.euclid(moved("src", s), moved("dst", s)), F.col("w"), self.kind, self.beta, self.eps_plus)).alias(f"e{n}") for n, s in enumerate(steps))).first()
        return [{"e": math.inf if r[f"e{n}"] is None else r[f"e{n}"]} for n in range(len(steps))]

    def value(self, row):
        return row["e"], 1.0

    def gradient(self, state, scale, dim):
        e = ends(self.edges.select("src", "dst", "w"), state, "src", "dst").withColumn("len", V.euclid("src_x", "dst_x")).where("len > 0")
        f = F.col("len") / F.col("w") - 1
        if self.kind == "upper_barrier":
            u = f / self.eps_plus
            f = f + F.when(u > 0, self.beta / self.eps_plus * (1 / (1 - u) - 1)).otherwise(F.lit(0.0))
        f = f / (F.col("w") * F.col("len"))
        return spread(e, [("src", times(f, V.minus("src_x", "dst_x"))), ("dst", times(f, V.minus("dst_x", "src_x")))], dim)


@dataclass
class Fit:
    """coords (v, x), the energies from the start on, why it ended, and the terms' last scales."""

    coords: DataFrame
    trace: list[float] = field(default_factory=list)
    termination: str = "iteration_limit"
    scales: list[float] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"{len(self.trace) - 1} steps, energy {self.trace[0]:.6g} to {self.trace[-1]:.6g}, {self.termination}"

    def summary(self) -> DataFrame:
        row = (float(self.trace[0]), float(self.trace[-1]), len(self.trace) - 1, self.termination)
        return self.coords.sparkSession.createDataFrame([row], "start_energy double, energy double, steps int, termination string")


def _measure(terms: list[Term], state: DataFrame, steps: list[float]) -> list[tuple[float, list[float]]]:
    rows = [t.sums(state, steps) for t in terms]
    out = []
    for n in range(len(steps)):
        v = [t.value(r[n]) for t, r in zip(terms, rows, strict=True)]
        out.append((sum(t.weight * e for t, (e, _) in zip(terms, v, strict=True)), [s for _, s in v]))
    return out


def descend(coords: DataFrame, terms: list[Term], max_iter: int = 50, c: float = 1e-4, step: float = 1.0, min_step: float = 1e-12, grad_tol: float = 1e-8) -> Fit:
    """From ``coords`` (v, x) downhill: the step halves until the energy falls by c times the step times the squared gradient; coordinates are centred after each step."""
    dim = coords.select(F.size("x").alias("n")).first()["n"]
    zero = F.array(*[F.lit(0.0)] * dim)
    now = materialize(coords.select("v", V.as_double("x").alias("x"), zero.alias("g")), "coords", True)
    (e, scales), = _measure(terms, now, [0.0])
    fit = Fit(now, [e], "iteration_limit", scales)
    for _ in range(max_iter):
        pulls = None
        for t, s in zip(terms, fit.scales, strict=True):
            g = t.gradient(now, s, dim).select("v", times(F.lit(float(t.weight)), F.col("g")).alias("d"))
            pulls = g if pulls is None else pulls.unionByName(g)
        total = pulls.groupBy("v").agg(F.array(*(F.sum(F.get("d", F.lit(k))) for k in range(dim))).alias("d"))
        state = materialize(now.select("v", "x").join(total, "v", "left").select("v", "x", F.coalesce("d", zero).alias("g")), "coords", True)
        r = state.agg(F.sum(V.dot("g", "g")).alias("gg"), *(F.avg(F.get(a, F.lit(k))).alias(f"{a}{k}") for a in "xg" for k in range(dim))).first()
        gg, found = r["gg"] or 0.0, None
        if math.sqrt(gg) <= grad_tol:
            fit.termination = "gradient_tolerance"
            discard(state)
            break
        while found is None and step >= min_step:
            sizes = [step / 2**k for k in range(TRIES)]
            for s, (energy, sc) in zip(sizes, _measure(terms, state, sizes), strict=True):
                if energy <= fit.trace[-1] - c * s * gg:
                    found = (s, energy, sc)
                    break
            step /= 2**TRIES
        if found is None:
            fit.termination = "minimum_step"
            discard(state)
            break
        s, energy, fit.scales = found
        centre = [r[f"x{k}"] - s * r[f"g{k}"] for k in range(dim)]
        x = F.array(*(F.get("x", F.lit(k)) - F.lit(s) * F.get("g", F.lit(k)) - F.lit(centre[k]) for k in range(dim)))
        new = materialize(state.select("v", x.alias("x"), zero.alias("g")), "coords", True)
        discard(now, state)
        now, step = new, min(2 * s, 1e6)
        fit.trace.append(energy)
    fit.coords = now.select("v", "x")
    return fit


def edge_kk(edges: DataFrame, coords: DataFrame, mixes: tuple[float, ...] = (0.0, 0.5, 1.0), scale: str | float = "profiled", stiffness: dict | None = None, max_iter: int = 30) -> Fit:
    """Edge lengths towards s w: one descent for each stiffness mix from uniform to full, each from the last one's result. ``scale``: profiled, identity, fixed_initial or a number."""
    fixed: float | None = None if scale in ("profiled", "fixed_initial") else 1.0 if scale == "identity" else float(scale)
    out = None
    for mix in mixes:
        e = materialize(length_stiffness(edges, mix=mix, **(stiffness or {"mode": "power", "power": -1.0})), "stiffness")
        if scale == "fixed_initial" and fixed is None:
            start = coords.select("v", V.as_double("x").alias("x"), V.as_double("x").alias("g"))
            fixed = _profiled(EdgeTerm(edges=e).sums(start, [0.0])[0], None)[1]
        fit = descend(coords if out is None else out.coords, [EdgeTerm(edges=e, scale=fixed)], max_iter)
        if out is not None:
            fit.trace = out.trace + fit.trace
        out = fit
        discard(e)
    return out


def geodesic_kk(pairs: DataFrame, path_edges: DataFrame, coords: DataFrame, scale: float | None = None, k: float = 1.0, max_iter: int = 30) -> Fit:
    """Embedded path lengths towards graph distances, over all pairs or landmark pairs alike (``pairs``: i, j, g)."""
    return descend(coords, [PathTerm(pairs=pairs, path_edges=path_edges, k=k, scale=scale)], max_iter)


def landmark_geodesic_kk(edges: DataFrame, vertices: DataFrame, coords: DataFrame, local: int = 5, landmarks: int = 3, weighted: bool = True, max_iter: int = 30) -> Fit:
    """``geodesic_kk`` over each vertex's nearest vertices and farthest-point landmarks, along single shortest paths."""
    pairs, path = landmark_preparation(edges, vertices, local, landmarks, weighted)
    return geodesic_kk(pairs, path, coords, max_iter=max_iter)


def landmark_preparation(edges: DataFrame, vertices: DataFrame, local: int, landmarks: int, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """pairs (i, j, g) and their path edges."""
    from meshlark.operators import paths, pivots

    s = vertices.select(F.col("v").alias("s"))
    d = materialize(paths.distances(edges, s) if weighted else paths.hops(edges, s), "distances")
    p = materialize(pivots.landmark_pairs(d, pivots.farthest_landmarks(d, landmarks), local), "landmark-pairs")
    pairs = materialize(p.join(d.select(F.col("s").alias("i"), F.col("v").alias("j"), F.col("d").cast("double").alias("g")), ["i", "j"]), "pairs")
    e = edges if weighted else edges.select("src", "dst", F.lit(1.0).alias("w"))
    return pairs, materialize(paths.path_edges(paths.tree(e, d), pairs.select("i", "j")), "path-edges")


def full_preparation(edges: DataFrame, vertices: DataFrame, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """All pairs (i, j, g) of a connected graph within the limit on all pairs, and their single paths."""
    from meshlark.operators import paths

    e = edges if weighted else edges.select("src", "dst", F.lit(1.0).alias("w"))
    pairs = paths.all_pairs(e, vertices, weighted).withColumnRenamed("d", "g")
    d = paths.distances(e, vertices.select(F.col("v").alias("s")))
    return pairs, materialize(paths.path_edges(paths.tree(e, d), pairs.select("i", "j")), "path-edges")


def kernel_gram_gkk(edges: DataFrame, reference: DataFrame, coords: DataFrame, edge_weight: float = 1.0, gram_weight: float = 1.0, q: float = 1.0, scale: float = 1.0, max_iter: int = 30) -> Fit:
    """Edge lengths and the angles of star pairs of a reference embedding together."""
    stars = materialize(star_pairs(edges, reference, q), "stars")
    return descend(coords, [EdgeTerm(edge_weight, edges.select("src", "dst", "w", F.lit(1.0).alias("k")), scale), GramTerm(gram_weight, stars, scale)], max_iter)


def repulsive_stage(pairs: DataFrame, coords: DataFrame, weight: float = 1.0, delta: float = 1e-3, power: float = 0.0, max_iter: int = 10) -> Fit:
    """Pairs move apart; without edges nothing holds them, so the number of steps is what bounds it."""
    return descend(coords, [RepulsionTerm(weight, pairs, delta, power)], max_iter)


def edge_repulsive_stage(edges: DataFrame, pairs: DataFrame, coords: DataFrame, weight: float = 0.1, kind: str = "quadratic", beta: float = 1.0, eps_plus: float = 0.5, delta: float = 1e-3, power: float = 0.0, max_iter: int = 10) -> Fit:
    return descend(coords, [EdgePotentialTerm(1.0, edges, kind, beta, eps_plus), RepulsionTerm(weight, pairs, delta, power)], max_iter)
