"""Geodesic fits level by level: the coarsest set from classical starts, each finer one inserted from its nearest placed vertices and refined over nearest and landmark pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators import fits, hierarchy, mds, paths
from meshlark.operators.layout_tables import nearest_members
from meshlark.plans.shared import Rounds, discard, materialize


def distance_terms(pairs: DataFrame) -> DataFrame:
    """Pairs (i, j, d) as the items of a descent: src, dst, w and the stiffness k = 1 / w^2."""
    return pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("w"), (1 / (F.col("d") * F.col("d"))).alias("k"))


def refine(pairs: DataFrame, coords: DataFrame, max_iter: int = 30) -> fits.Fit:
    """Chords towards graph distances (i, j, d), relative errors alike."""
    return fits.descend(coords, [fits.EdgeTerm(edges=distance_terms(pairs), scale=1.0)], max_iter)


def inserted(anchors: DataFrame, placed: DataFrame, dim: int, steps: int = 20) -> DataFrame:
    """v, x of new vertices from their anchors (v, s, d): the mean of these weighted by 1 / d^2, then descents on each vertex alone."""
    a = anchors.join(placed.select(F.col("v").alias("s"), "x"), "s").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("d", "s", "x"))).alias("a"))
    a = a.select("v", F.transform("a", lambda q: q["d"]).alias("d"), F.flatten(F.transform("a", lambda q: q["x"])).alias("x"))

    def run(parts):
        for pdf in parts:
            out = []
            for d, x in zip(pdf["d"], pdf["x"], strict=True):
                g, at = np.array(d, dtype=float), np.array(x).reshape(-1, dim)
                w = 1 / g**2
                z = (at * w[:, None]).sum(axis=0) / w.sum()
                for _ in range(steps):
                    gap = z - at
                    l = np.maximum(np.sqrt((gap * gap).sum(axis=1)), 1e-12)
                    z = z - ((w * (l - g) / l)[:, None] * gap).sum(axis=0) / w.sum()
                out.append(z)
            yield pd.DataFrame({"v": pdf["v"], "x": out})

    return a.mapInPandas(run, "v bigint, x array<double>")


def level_pairs(near: DataFrame, members: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """i, j, d: each member with its ``k`` nearest others and with the landmarks (``marks``: s, v, d) of the level."""
    ours = near.where("s <> v").join(members, "v", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "s"))).where(F.col("r") <= k).select("v", "s", "d")
    both = ours.union(marks.where("s <> v").join(members, "v", "left_semi").select("v", "s", F.col("d").cast("double")))
    return both.groupBy(F.least("v", "s").alias("i"), F.greatest("v", "s").alias("j")).agg(F.min("d").alias("d"))


def farthest_marks(edges: DataFrame, members: DataFrame, count: int, weighted: bool) -> DataFrame:
    """s, v, d: graph distances from farthest-point landmarks among the members, the smallest member first, ties to the smaller id; one search each."""
    out, s = None, members.agg(F.min("v").alias("s")).first()["s"]
    for k in range(count):
        one = members.sparkSession.createDataFrame([(s,)], "s bigint")
        d = (paths.distances(edges, one) if weighted else paths.hops(edges, one)).select("s", "v", F.col("d").cast("double").alias("d"))
        if out is None:
            out = Rounds(d, "marks")
        else:
            out.add(d)
        if k + 1 < count:
            far = out.all().join(members, "v", "left_semi").groupBy("v").agg(F.min("d").alias("d")).where("d > 0").orderBy(F.desc("d"), "v").first()
            if far is None:
                break
            s = far.v
    return out.all()


def misf_geodesic(edges: DataFrame, vertices: DataFrame, dim: int = 2, weighted: bool = False, num_init: int = 24, near_k: int = 10, landmarks: int = 8, anchors: int = 4, restarts: int = 3, max_iter: int = 30, seed: int = 1) -> tuple[fits.Fit, DataFrame]:
    """The fit of the finest level, and level, vertices, pairs, start_energy, energy, steps, termination of every level.

    The coarsest set, at most ``num_init`` vertices, is fitted over all its pairs from its classical coordinates and from ``restarts`` - 1 noisy copies of them; the least energy stays. The graph is connected.
    """
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w") if weighted else F.lit(1.0).alias("w"))
    levels = materialize(hierarchy.misf(e, vertices, num_init, weighted, seed), "levels")
    sizes = {r.level: r.size for r in hierarchy.sizes(levels).collect()}
    top, rows = max(sizes), []
    at = lambda k: levels.where(F.col("level") == k).select("v")
    members = at(top)
    near = materialize(nearest_members(e, members, num_init, weighted), "near")
    pairs = materialize(near.join(members, "v", "left_semi").where("v < s").select(F.col("v").alias("i"), F.col("s").alias("j"), "d"), "pairs")
    if pairs.count() != sizes[top] * (sizes[top] - 1) // 2:
        raise ValueError("the graph is not connected")
    start, _ = mds.classical(pairs, members, dim)
    best = None
    for r in range(restarts):
        u = lambda k, r=r: F.pmod(F.xxhash64("v", F.lit(seed), F.lit(r), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) - 0.5
        noise = F.array(*(F.lit(0.0) if r == 0 else 0.2 * u(k) for k in range(dim)))
        fit = refine(pairs, start.select("v", F.zip_with("x", noise, lambda a, b: a + b).alias("x")), max_iter)
        if best is None or fit.trace[-1] < best.trace[-1]:
            best = fit
    rows.append((top, sizes[top], pairs.count(), best.trace[0], best.trace[-1], len(best.trace) - 1, best.termination))
    for level in range(top - 1, -1, -1):
        members = at(level)
        new = members.join(best.coords, "v", "left_anti")
        first = near.join(new, "v", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "s"))).where(F.col("r") <= anchors).select("v", "s", "d")
        coords = materialize(best.coords.select("v", V.as_double("x").alias("x")).unionByName(inserted(first, best.coords, dim)), "placed")
        discard(near, pairs)
        near = materialize(nearest_members(e, members, max(near_k, anchors) + 1, weighted), "near")
        pairs = materialize(level_pairs(near, members, farthest_marks(e, members, landmarks, weighted), near_k), "pairs")
        best = refine(pairs, coords, max_iter)
        rows.append((level, sizes[level], pairs.count(), best.trace[0], best.trace[-1], len(best.trace) - 1, best.termination))
    discard(near, pairs, levels)
    return best, vertices.sparkSession.createDataFrame(rows, "level int, vertices bigint, pairs bigint, start_energy double, energy double, steps int, termination string")
