"""Pivots, their distance rows, regions, and the constraint tables of sparse stress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.graph import canonical
from meshlark.operators.paths import all_rows, distances, hops
from meshlark.plans.shared import Rounds, discard, materialize

METRICS = {"euclid": V.euclid, "linf": V.linf}
BATCH_PIVOTS, BROADCAST_PIVOTS, WORKSPACE_BYTES = 512, 4096, 512 << 20


def pivot_table(spark: SparkSession, pivots: list[int]) -> DataFrame:
    """k, pivot in the given order."""
    if len(set(pivots)) != len(pivots) or not pivots:
        raise ValueError("pivots must be distinct and at least one")
    return spark.createDataFrame(list(enumerate(pivots, 1)), "k int, pivot bigint")


def select_pivots(obs: DataFrame, count: int, method: str = "farthest", metric: str = "euclid", seed: int = 1) -> list[int]:
    """``farthest``: the smallest id, then always the row farthest from those chosen, ties to the smaller id. ``uniform``: by hash.
    ``random``: the next is drawn by its distance to the nearest chosen one (weighted hash order), one job each."""
    if method == "uniform":
        return [r.v for r in obs.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(count).collect()]
    return _farthest(obs, count, metric) if method == "farthest" else _drawn(obs, count, metric, seed)


def _to_chosen(obs: DataFrame, chosen: list[int], rows: list, metric: str) -> DataFrame:
    """v, x, d of the rows that are not chosen: the distance to the nearest chosen one."""
    centres, ids = np.array(rows, dtype=np.float64), np.array(chosen, dtype=np.int64)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from meshlark.operators.blocks import pairwise

        for pdf in parts:
            pdf = pdf[~np.isin(pdf["v"].to_numpy(), ids)]
            if len(pdf):
                yield pd.DataFrame({"v": pdf["v"], "x": pdf["x"], "d": pairwise(np.array(pdf["x"].tolist(), dtype=np.float64), centres, metric).min(axis=1)})

    return obs.select("v", V.as_double("x").alias("x")).mapInPandas(nearest, "v bigint, x array<double>, d double")


def _farthest(obs: DataFrame, count: int, metric: str, batch: int = BATCH_PIVOTS) -> list[int]:
    """Farthest points in batches. A pass brings the ``batch`` rows that are farthest from all chosen ones, and the rule goes on among these alone for as long as its pick is
    farther than any row left behind was; distances only fall, so that pick is the pick of all rows. Every pass yields one pivot at least."""
    from meshlark.operators.blocks import pairwise

    first = obs.select("v", "x").orderBy("v").first()
    chosen, rows = [first.v], [first.x]
    while len(chosen) < count:
        got = _to_chosen(obs, chosen, rows, metric).orderBy(F.desc("d"), "v").limit(batch + 1).collect()
        if not got:
            break
        left = got[batch].d if len(got) > batch else -1.0
        own = got[:batch]
        ids, x, d = np.array([r.v for r in own]), np.array([r.x for r in own], dtype=np.float64), np.array([r.d for r in own])
        open_ = np.ones(len(own), dtype=bool)
        taken = 0
        while len(chosen) < count and open_.any():
            best = d[open_].max()
            if taken and best <= left:
                break
            k = int(np.flatnonzero(open_ & (d == best))[np.argmin(ids[open_ & (d == best)])])
            chosen.append(int(ids[k]))
            rows.append(own[k].x)
            open_[k] = False
            taken += 1
            d = np.minimum(d, pairwise(x, x[k : k + 1], metric)[:, 0])
    return chosen


def _drawn(obs: DataFrame, count: int, metric: str, seed: int) -> list[int]:
    first = obs.select("v", "x").orderBy(F.xxhash64("v", F.lit(seed))).first()
    chosen, rows = [first.v], [first.x]
    while len(chosen) < count:
        # exponential races: the least -log(u) / d wins with probability in proportion to d
        u = (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(len(chosen))), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        row = _to_chosen(obs, chosen, rows, metric).withColumn("d", -(-F.log(u) / F.col("d"))).orderBy(F.desc("d"), "v").first()
        if row is None:
            break
        chosen.append(row.v)
        rows.append(row.x)
    return chosen


def observation_distances(obs: DataFrame, pivots: DataFrame, metric: str = "euclid") -> DataFrame:
    """k, pivot, v, d. The pivots' vectors, at most ``BROADCAST_PIVOTS``, meet all rows. Equal vectors would make a target of 0 and are an error."""
    if (n := pivots.count()) > BROADCAST_PIVOTS:
        raise ValueError(f"{n} pivots are more than the {BROADCAST_PIVOTS} that a task holds")
    p = pivots.join(obs.select(F.col("v").alias("pivot"), V.as_double("x").alias("px")), "pivot")
    d = obs.select("v", V.as_double("x").alias("x")).crossJoin(F.broadcast(p)).select("k", "pivot", "v", METRICS[metric]("x", "px").alias("d"))
    return d


def graph_distances(edges: DataFrame, pivots: DataFrame, weighted: bool = True) -> DataFrame:
    s = pivots.select(F.col("pivot").alias("s"))
    d = distances(edges, s) if weighted else hops(edges, s)
    return d.join(pivots, d.s == pivots.pivot).select("k", "pivot", "v", F.col("d").cast("double").alias("d"))


def regions(pivot_dist: DataFrame, steps: float | None = None) -> DataFrame:
    """v, owner: the nearest pivot, ties to the one selected first. ``steps``: a place in the selection weighs as much as one of so many steps to the unit of length, so the least
    d * steps + k owns a row, and of distances nearer to each other than that the earlier pivot's wins."""
    order = F.struct("d", "k") if steps is None else F.struct(F.col("d") * F.lit(float(steps)) + F.col("k"), "d", "k")
    return pivot_dist.groupBy("v").agg(F.min_by("pivot", order).alias("owner"))


def half_counts(pivot_dist: DataFrame, region: DataFrame) -> DataFrame:
    """pivot, v, d, s: how many members of the pivot's region are within d/2 of it (inclusive). One sort per pivot; no pair of vertices is formed."""
    members = pivot_dist.join(region.select("v", F.col("owner").alias("pivot")), ["v", "pivot"]).select("pivot", F.col("d").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("double").alias("d"))
    asks = pivot_dist.select("pivot", (F.col("d") / 2).alias("at"), F.lit(1).alias("ask"), "v", "d")
    w = Window.partitionBy("pivot").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return members.union(asks).withColumn("s", F.sum(1 - F.col("ask")).over(w)).where("ask = 1").select("pivot", "v", "d", "s")


def _ends(p: Column, v: Column, d: Column, s: Column) -> list[Column]:
    """i, j, target, count_i, count_j: the count goes to the end that is not the pivot."""
    low = v < p
    return [F.least(p, v).alias("i"), F.greatest(p, v).alias("j"), d.alias("target"), F.when(low, s).otherwise(0.0).alias("count_i"), F.when(low, F.lit(0.0)).otherwise(s).alias("count_j")]


def constraints(edges: DataFrame, pivot_dist: DataFrame, uniform: bool = False, steps: float | None = None) -> DataFrame:
    """i, j, target, count_i, count_j: edges with counts (1, 1), and pivot pairs that are not edges with regional counts; equal pairs merge."""
    e = canonical(edges).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("target"), F.lit(1.0).alias("count_i"), F.lit(1.0).alias("count_j"))
    if uniform:
        p = pivot_dist.where("v <> pivot").select(F.least("pivot", "v").alias("i"), F.greatest("pivot", "v").alias("j"), F.col("d").alias("target"), F.lit(1.0).alias("count_i"), F.lit(1.0).alias("count_j"))
        p = p.groupBy("i", "j", "count_i", "count_j").agg(F.min("target").alias("target")).select("i", "j", "target", "count_i", "count_j")
    else:
        h = half_counts(pivot_dist, regions(pivot_dist, steps)).where("v <> pivot")
        p = h.select(*_ends(F.col("pivot"), F.col("v"), F.col("d"), F.col("s").cast("double")))
    p = p.join(e.select("i", "j"), ["i", "j"], "left_anti")
    merged = e.union(p.select("i", "j", "target", "count_i", "count_j")).groupBy("i", "j").agg(F.min("target").alias("target"), F.sum("count_i").alias("count_i"), F.sum("count_j").alias("count_j"))
    return merged


def agreed(rows: DataFrame, key: list[str], value: str, order: list[str], tol: float = 1e-10) -> DataFrame:
    """The first row of each key in the given order, or an error if values of a key differ from its first by more than ``tol`` of it (at least 1)."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = materialize(rows.withColumn("_r", F.row_number().over(w)).withColumn("_first", F.first(value).over(w)), "groups")
    odd = x.where(F.abs(F.col(value) - F.col("_first")) > tol * F.greatest(F.lit(1.0), F.abs("_first"))).select(*key).first()
    if odd is not None:
        raise ValueError(f"the values of {tuple(odd)} differ")
    return x.where("_r = 1").drop("_r", "_first")


def order_breaks(rows: DataFrame, position: str, key: list[str]) -> DataFrame:
    """breaks: how many rows have a key that isn't above that of the row before, in the order of ``position``. Positions are sorted in ranges; a range's ends, a row each, meet."""
    x = materialize(rows.select(F.col(position).alias("p"), F.struct(*key).alias("k")).repartitionByRange("p").withColumn("part", F.spark_partition_id()), "ordered")
    inside = x.withColumn("before", F.lag("k").over(Window.partitionBy("part").orderBy("p"))).where("before is not null").agg(F.count_if(F.col("k") <= F.col("before")).alias("n"))
    ends = x.groupBy("part").agg(F.min_by("k", "p").alias("first"), F.max_by("k", "p").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("before is not null").agg(F.count_if(F.col("first") <= F.col("before")).alias("m"))  # a row for each range
    return inside.crossJoin(between).select((F.col("n") + F.col("m")).alias("breaks"))  # one row each


def landmark_constraints(pivot_dist: DataFrame, local: DataFrame | None = None, uniform: bool = False, tol: float = 1e-10, steps: float | None = None) -> DataFrame:
    """Constraints of a supplied distance table; ``local`` pairs (i, j, d) override counts with 1. Self-distances are 0, both rows of a pivot pair agree."""
    if not pivot_dist.where((F.col("v") == F.col("pivot")) & (F.abs("d") > tol)).isEmpty():
        raise ValueError("a pivot is not at distance 0 from itself")
    a, b = pivot_dist.alias("a"), pivot_dist.alias("b")
    odd = a.join(b, (F.col("a.pivot") == F.col("b.v")) & (F.col("a.v") == F.col("b.pivot"))).where(F.abs(F.col("a.d") - F.col("b.d")) > tol * F.greatest(F.lit(1.0), F.col("a.d")))
    if not odd.isEmpty():
        raise ValueError("the distances of two pivots differ by direction")
    if uniform:
        p = pivot_dist.where("v <> pivot").select(*_ends(F.col("pivot"), F.col("v"), F.col("d"), F.lit(1.0))).withColumns({"count_i": F.lit(1.0), "count_j": F.lit(1.0)})
        p = p.groupBy("i", "j").agg(F.min("target").alias("target"), F.first("count_i").alias("count_i"), F.first("count_j").alias("count_j"))
    else:
        p = half_counts(pivot_dist, regions(pivot_dist, steps)).where("v <> pivot").select(*_ends(F.col("pivot"), F.col("v"), F.col("d"), F.col("s").cast("double")))
    p = p.withColumn("local", F.lit(False))
    if local is not None:
        p = p.union(local.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("d").alias("target"), F.lit(1.0).alias("count_i"), F.lit(1.0).alias("count_j"), F.lit(True).alias("local")))
    g = p.groupBy("i", "j").agg(F.min("target").alias("target"), F.sum("count_i").alias("ci"), F.sum("count_j").alias("cj"), F.max("local").alias("local"))
    one = lambda c: F.when(F.col("local"), F.lit(1.0)).otherwise(F.col(c))
    return g.where("target > 0").select("i", "j", "target", one("ci").alias("count_i"), one("cj").alias("count_j"))


def check_constraints(c: DataFrame) -> DataFrame:
    """Canonical order (counts swap with the ends), distinct pairs, targets above 0, counts at least 0 and not both 0."""
    swap = F.col("i") > F.col("j")
    out = c.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "target", F.when(swap, F.col("count_j")).otherwise(F.col("count_i")).alias("count_i"), F.when(swap, F.col("count_i")).otherwise(F.col("count_j")).alias("count_j"))
    if not out.where("i = j or target <= 0 or count_i < 0 or count_j < 0 or count_i + count_j <= 0 or target is null").isEmpty():
        raise ValueError("a constraint has equal ends, a target that is not above 0 or no count")
    if not out.groupBy("i", "j").count().where("count > 1").isEmpty():
        raise ValueError("a pair has two constraints")
    return out


def check_pivot_distances(dist: DataFrame) -> DataFrame:
    """The rows (k, pivot, v, d), or an error: a distance is finite, and 0 for the pivot itself alone."""
    bad = dist.where("d is null or isnan(d) or d = double('infinity') or d < 0 or (d = 0) <> (v = pivot)").orderBy("k", "v").first()
    if bad is not None:
        raise ValueError(f"pivot {bad.pivot} and row {bad.v} are at distance {bad.d}")
    return dist


def workspace_bytes(rows: int, count: int, k: int, features: int) -> int:
    """What a preparation keeps at least: pivot rows of distances and counts, and neighbour lists with their vectors, 8 bytes a number."""
    return 8 * rows * (2 * count + 2 * k + features)


def search_space(obs: DataFrame, metric: str, share: float | None) -> DataFrame:
    """The vectors in which neighbours are sought: the leading principal components with that share of the variance, or the vectors themselves."""
    from meshlark.operators.mds import pca

    if share is None:
        return obs
    if metric != "euclid" or not 0 < share <= 1:
        raise ValueError("a search in principal components takes Euclidean distances and a share of variance above 0 and at most 1")
    return pca(obs, share)[0]


def sparse_preparation(
    obs: DataFrame, pivots: list[int] | int, k: int = 10, metric: str = "euclid", uniform: bool = False, geodesic: bool = False, method: str = "farthest", pca_share: float | None = None,
    connect: str | None = None, allowance: int | None = None, seed: int = 1, steps: float | None = None,
) -> dict[str, DataFrame]:
    """Neighbour graph, pivots, their distances, regions and constraints of observations (v, x).

    ``pivots`` are given or a number to select. Neighbours are sought in principal components with ``pca_share`` of the variance if it is given, and lengths are always those of the vectors.
    ``connect``: mst joins the parts of the neighbour graph, error refuses them; geodesic distances need one part. ``allowance``: the bytes that ``workspace_bytes`` may reach; more is refused
    before anything is run. ``steps``: see ``regions``.
    """
    from meshlark.operators.knn import connected_knn_graph, knn, knn_graph

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    n, count = obs.count(), pivots if isinstance(pivots, int) else len(pivots)
    if not 1 <= count <= max(1, n - 1):
        raise ValueError("there are no pivots, or more than other observations")
    if allowance is not None:
        need = workspace_bytes(n, count, k, obs.select(F.size("x").alias("p")).first()["p"])
        if need > allowance:
            raise ValueError(f"the preparation takes {need} bytes, more than the {allowance} that are allowed; take fewer pivots or neighbours")
    space = search_space(obs, metric, pca_share)
    if pca_share is not None:
        space = materialize(space, "search-space")
    found = connected_knn_graph(space, k, metric, "mst" if connect == "mst" else "error") if connect or geodesic else knn_graph(knn(space, k, metric))
    if pca_share is not None:
        a, b = (obs.select(F.col("v").alias(c), V.as_double("x").alias(f"x_{c}")) for c in ("src", "dst"))
        found = found.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", METRICS[metric]("x_src", "x_dst").alias("w"))
    edges = materialize(found.select("src", "dst", "w"), "edges")
    p = pivot_table(obs.sparkSession, select_pivots(obs, count, method, metric, seed) if isinstance(pivots, int) else pivots)
    d = materialize(graph_distances(edges, p) if geodesic else observation_distances(obs, p, metric), "pivot-distances")
    check_pivot_distances(d)
    return {"edges": edges, "pivots": p, "pivot_dist": d, "region": regions(d, steps), "constraints": materialize(constraints(edges, d, uniform, steps), "constraints")}


def landmark_pairs(dist: DataFrame, landmarks: DataFrame, local: int) -> DataFrame:
    """i, j: each source's ``local`` nearest vertices and its landmarks, as unordered pairs."""
    near = dist.where("v <> s").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("d", "v"))).where(F.col("r") <= local).select("s", "v")
    pairs = near.union(landmarks.select("s", "v"))
    return pairs.where("s <> v").select(F.least("s", "v").alias("i"), F.greatest("s", "v").alias("j")).distinct()


def landmark_pairs_of(edges: DataFrame, vertices: DataFrame, local: int) -> DataFrame:
    """i, j: each vertex's ``local`` nearest ones and the one farthest from it, ties to the smaller ids, as unordered pairs, in a connected graph that a task can hold: of a vertex's distances
    its task keeps these alone."""

    def fold(ids, at, d, _):
        rows, ends = np.arange(len(at)), []
        k = min(local, len(ids) - 1)
        far = d.copy()
        far[rows, at] = -1.0
        ends.append((at, far.argmax(axis=1)))
        d[rows, at] = np.inf
        if k:
            most = np.partition(d, k - 1, axis=1)[:, k - 1]
            for a, x, m in zip(at, d, most, strict=True):
                near = np.flatnonzero(x <= m)  # in the order of ids
                ends.append((np.full(k, a), near[np.argsort(x[near], kind="stable")[:k]]))
        s, v = (np.concatenate(c) for c in zip(*ends, strict=True))
        s, v = s[s != v], v[s != v]
        return {"i": ids[np.minimum(s, v)], "j": ids[np.maximum(s, v)]}

    return all_rows(edges, vertices, fold, "i bigint, j bigint").distinct()


def farthest_landmarks(dist: DataFrame, count: int, steps: float | None = None) -> DataFrame:
    """s, v: greedy farthest landmarks for each source, ties to the smaller id, over the distance rows of all vertices. ``steps``: an id weighs as much as one of so many steps to the unit of
    length, so the greatest d * steps - v is taken, and of distances nearer to each other than their ids' steps the smaller id's wins. A round takes each source's row farthest from it
    and from its landmarks, and lowers the rest by the new landmark's row; no source's rows meet in a driver or one group."""
    score = dist.where("s <> v").select("s", "v", F.col("d").cast("double").alias("score"))
    rows = dist.select(F.col("s").alias("landmark"), "v", F.col("d").cast("double").alias("d"))
    order = [F.col("score"), -F.col("v")] if steps is None else [F.col("score") * F.lit(float(steps)) - F.col("v"), F.col("score")]
    picked = None
    for k in range(count):
        pick = score.where("score < double('infinity')").groupBy("s").agg(F.max_by("v", F.struct(*order)).alias("landmark"))
        picked = Rounds(pick, "landmarks") if picked is None else picked
        if k:
            picked.add(pick)
        if k + 1 < count:
            near = score.join(picked.last, "s").where("v <> landmark").join(rows, ["landmark", "v"], "left")
            score, old = materialize(near.select("s", "v", F.least("score", F.coalesce("d", F.lit(float("inf")))).alias("score")), "landmark-scores"), score
            discard(old)
    return picked.all().select("s", F.col("landmark").alias("v"))
