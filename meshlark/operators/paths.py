"""Distances, shortest-path trees, path counts.

A graph of at most ``TASK_EDGES`` directed edges is searched where it is held: tasks take some sources each and follow all of their ways to the end, so a long graph takes no more jobs than a
short one. Larger graphs go by frontier joins, a round for each step, whose state goes to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.graph import adjacency
from meshlark.plans.shared import Rounds, discard, guard_all_pairs, materialize

TASK_EDGES, TASK_CELLS, STEP_EDGES = 1_000_000, 2_000_000, 1_000_000
STREAM_CELLS, ARROW_ROWS = 32_000_000, 100_000  # distances of a task that hands them on, and rows of a batch of them
BALL_SOURCES, TASK_SOURCES = 256, 16_384  # searched at once, and by a task


def _reached(start: np.ndarray, to: np.ndarray, w: np.ndarray, at: np.ndarray, limit: float) -> np.ndarray:
    """Least path lengths from each of ``at`` (rows) to all vertices, in at most ``limit`` steps: those whose length has just got less tell their neighbours."""
    n = len(start) - 1
    best = np.full(len(at) * n, np.inf)
    cell, steps = np.arange(len(at)) * n + at, 0
    best[cell] = 0.0
    while len(cell) and steps < limit:
        steps += 1
        had, found = best[cell], []
        deg = np.diff(start)[cell % n]
        cuts = np.searchsorted(np.cumsum(deg), np.arange(STEP_EDGES, deg.sum(), STEP_EDGES))
        for c, h, k in zip(np.split(cell, cuts), np.split(had, cuts), np.split(deg, cuts), strict=True):
            own = np.repeat(np.arange(len(c)), k)
            e = start[c % n][own] + np.arange(len(own)) - (np.cumsum(k) - k)[own]
            there, new = (c - c % n)[own] + to[e], h[own] + w[e]
            less = new < best[there]
            there, new = there[less], new[less]
            np.minimum.at(best, there, new)
            found.append(np.unique(there))
        cell = np.unique(np.concatenate(found))
    return best.reshape(len(at), n)


def _ball(start: np.ndarray, to: np.ndarray, w: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
    """Sorted cells (row of ``at`` times vertices plus vertex) within the radius of each of ``at``. It holds what is reached and not all vertices; sources that reach too many together are halved."""
    n = len(start) - 1
    known = cell = np.arange(len(at)) * n + at
    best = had = np.zeros(len(at))
    while len(cell):
        if len(known) > TASK_CELLS and len(at) > 1:
            half = len(at) // 2
            return np.concatenate([_ball(start, to, w, at[:half], radius), _ball(start, to, w, at[half:], radius) + half * n])
        k = np.diff(start)[cell % n]
        own = np.repeat(np.arange(len(cell)), k)
        e = start[cell % n][own] + np.arange(len(own)) - (np.cumsum(k) - k)[own]
        there, new = (cell - cell % n)[own] + to[e], had[own] + w[e]
        there, new = there[new <= radius], new[new <= radius]
        order = np.lexsort((new, there))
        there, new = there[order], new[order]
        first = np.concatenate([[True], there[1:] != there[:-1]]) if len(there) else np.empty(0, bool)
        there, new = there[first], new[first]
        place = np.searchsorted(known, there)
        old = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == there)
        less = np.ones(len(there), bool)
        less[old] = new[old] < best[place[old]]
        best = best.copy()
        best[place[old]] = np.minimum(best[place[old]], new[old])
        fresh = np.ones(len(there), bool)
        fresh[old] = False
        known, best = np.insert(known, place[fresh], there[fresh]), np.insert(best, place[fresh], new[fresh])
        cell, had = there[less], new[less]
    return known


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of a graph as one row: ids, and for each its edges' ends and lengths."""
    ids, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    a, b = at[: len(pdf)], at[len(pdf) :]
    order = np.lexsort((b, a))
    start = np.searchsorted(a[order], np.arange(len(ids) + 1))
    return pd.DataFrame({"ids": [ids.astype("<i8").tobytes()], "start": [start.astype("<i8").tobytes()], "to": [b[order].astype("<i8").tobytes()], "w": [pdf["w"].to_numpy("<f8")[order].tobytes()]})


def _searched(e: DataFrame, sources: DataFrame, limit: int | None, above: bool) -> DataFrame:
    """s, v, d over directed edges (src, dst, w) that one task can hold; the sources are dealt to tasks of about ``TASK_CELLS`` distances. ``above``: only v > s."""
    graph = materialize(e.groupBy().applyInPandas(_packed, "ids binary, start binary, to binary, w binary"), "packed")
    n = e.select("src").distinct().count()
    s = materialize(sources.select(F.col("s").cast("bigint").alias("s")).distinct(), "sources")
    tasks = max(1, -(-s.count() * max(n, 1) // TASK_CELLS))
    s = s.withColumn("task", F.pmod(F.xxhash64("s"), F.lit(tasks)).cast("int"))
    copies = s.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task")).crossJoin(F.broadcast(graph))  # one row

    def run(own: pa.Table, packed: pa.Table) -> pa.Table:
        at, held = np.sort(own.column("s").to_numpy()), packed.num_rows
        ids, start, to = (np.frombuffer(packed.column(c)[0].as_py() if held else b"", "<i8") for c in ("ids", "start", "to"))
        place = np.searchsorted(ids, at)
        known = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == at) if len(ids) else np.empty(0, np.int64)
        out = [(at, at, np.zeros(len(at)))] if not above else []  # a source is at 0 from itself, with edges or without
        for few in np.array_split(known, -(-len(known) * len(ids) // TASK_CELLS) or 1):
            if len(few):
                d = _reached(start, to, np.frombuffer(packed.column("w")[0].as_py()), place[few], math.inf if limit is None else limit)
                i, j = np.nonzero(np.isfinite(d) & (ids[None, :] > at[few][:, None] if above else ids[None, :] != at[few][:, None]))
                out.append((at[few][i], ids[j], d[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"s": cols[0].astype(np.int64), "v": cols[1].astype(np.int64), "d": cols[2].astype(np.float64)})

    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [x.repartition(max(parts, tasks), "task") for x in (s, copies)]  # a group a task: not merged into few
    return materialize(dealt[0].groupBy("task").cogroup(dealt[1].groupBy("task")).applyInArrow(run, "s bigint, v bigint, d double"), "distances")


def balls(e: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """s, v: vertices within the radius of each source (s) over directed edges (src, dst, w) that one task can hold; tasks hold the graph and what their sources reach."""
    graph = materialize(e.groupBy().applyInPandas(_packed, "ids binary, start binary, to binary, w binary"), "packed")
    s = materialize(sources.select(F.col("s").cast("bigint").alias("s")).distinct(), "sources")
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(parts, s.count() // BALL_SOURCES), -(-s.count() // TASK_SOURCES))
    s = s.withColumn("task", F.pmod(F.xxhash64("s"), F.lit(tasks)).cast("int"))
    copies = s.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task")).crossJoin(F.broadcast(graph))  # one row

    def run(own: pa.Table, packed: pa.Table) -> pa.Table:
        at, held = np.sort(own.column("s").to_numpy()), packed.num_rows
        ids, start, to = (np.frombuffer(packed.column(c)[0].as_py() if held else b"", "<i8") for c in ("ids", "start", "to"))
        place = np.searchsorted(ids, at)
        known = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == at) if len(ids) else np.empty(0, np.int64)
        alone = np.setdiff1d(at, at[known])
        out = [(alone, alone)]
        for few in np.array_split(known, -(-len(known) // BALL_SOURCES) or 1):
            if len(few):
                cell = _ball(start, to, np.frombuffer(packed.column("w")[0].as_py()), place[few], radius)
                out.append((at[few][cell // len(ids)], ids[cell % len(ids)]))
        return pa.table({"s": np.concatenate([c[0] for c in out]).astype(np.int64), "v": np.concatenate([c[1] for c in out]).astype(np.int64)})

    dealt = [x.repartition(max(parts, tasks), "task") for x in (s, copies)]
    return materialize(dealt[0].groupBy("task").cogroup(dealt[1].groupBy("task")).applyInArrow(run, "s bigint, v bigint"), "balls")


def hops(edges: DataFrame, sources: DataFrame, limit: int | None = None, above: bool = False) -> DataFrame:
    """s, v, d: breadth-first hop counts from each of ``sources`` (s); unreachable vertices are absent. ``above``: only v > s."""
    e = materialize(adjacency(edges).select("src", "dst").distinct(), "adjacency")
    if e.count() <= TASK_EDGES:
        out = _searched(e.withColumn("w", F.lit(1.0)), sources, limit, above)
        discard(e)
        return out.select("s", "v", F.col("d").cast("int").alias("d"))
    seen, d = Rounds(sources.select("s", F.col("s").alias("v"), F.lit(0).alias("d")), "hops"), 0
    while limit is None or d < limit:
        d += 1
        step = seen.last.select("s", F.col("v").alias("src")).join(e, "src").select("s", F.col("dst").alias("v")).distinct().join(seen.all().select("s", "v"), ["s", "v"], "left_anti")
        if seen.add(step.withColumn("d", F.lit(d))).isEmpty():
            break
    return seen.all().where("v > s") if above else seen.all()


def distances(edges: DataFrame, sources: DataFrame, rounds: int = 10_000, above: bool = False) -> DataFrame:
    """s, v, d: least path lengths (rounds of relaxation over vertices whose distance has just improved). ``above``: only v > s."""
    e = materialize(adjacency(edges).groupBy("src", "dst").agg(F.min("w").alias("w")), "adjacency")
    if e.count() <= TASK_EDGES:
        out = _searched(e, sources, None, above)
        discard(e)
        return out
    best = materialize(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("better")), "best")
    for _ in range(rounds):
        frontier = best.where("better").select("s", F.col("v").alias("src"), "d")
        step = frontier.join(e, "src").groupBy("s", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        merged = best.drop("better").join(step, ["s", "v"], "full").select("s", "v", F.least("d", "new").alias("d"), (F.col("d").isNull() | (F.col("new") < F.col("d"))).alias("better"))
        best, old = materialize(merged.withColumn("better", F.coalesce("better", F.lit(False))), "best"), best
        discard(old)
        if best.where("better").isEmpty():
            discard(e)
            return best.select("s", "v", "d").where("v > s" if above else "true")
    raise RuntimeError("distances did not settle")


def _trunk(start: np.ndarray, to: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """hub and length of each vertex, the graph without its leaves, and the places there. A leaf has one neighbour, its hub, and all of its ways go through it; others are their own hub at 0."""
    n, deg = len(start) - 1, np.diff(start)
    hub, own = np.arange(n), np.zeros(n)
    leaf = np.flatnonzero(deg == 1)
    near = to[start[leaf]]
    leaf = leaf[(deg[near] > 1) | (near < leaf)]
    hub[leaf], own[leaf] = to[start[leaf]], w[start[leaf]]
    stays = own == 0
    stays[leaf] = False
    place, src = np.cumsum(stays) - 1, np.repeat(np.arange(n), deg)
    m = stays[src] & stays[to]
    return hub, own, (np.searchsorted(place[src[m]], np.arange(stays.sum() + 1)), place[to[m]], w[m]), place


def packed_values(rows: DataFrame, *columns: str) -> DataFrame:
    """Numbers of vertices (v) as one row: ids in order, and the columns one after another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pd.DataFrame({"at": [pdf["v"].to_numpy("<i8").tobytes()], "numbers": [pdf[list(columns)].to_numpy("<f8").T.tobytes()]})

    return materialize(rows.select("v", *columns).groupBy().applyInPandas(run, "at binary, numbers binary"), "numbers")


def all_rows(edges: DataFrame, vertices: DataFrame, fold, schema: str, weighted: bool = True, values: DataFrame | None = None) -> DataFrame:
    """What ``fold`` makes of the distances between all vertices of a connected graph that one task can hold (an error otherwise): it is called with the ids in order, the places of some
    sources, their distances (a row each) and, from ``packed_values``, (ids, numbers), and returns columns. Nothing is stored or shuffled, and a task holds some two million distances at once."""
    e = adjacency(edges).groupBy("src", "dst").agg(F.min("w").alias("w") if weighted else F.lit(1.0).alias("w"))
    graph = materialize(e.groupBy().applyInPandas(_packed, "ids binary, start binary, to binary, w binary"), "packed")
    first = graph.first()
    n, known = vertices.count(), len(first.ids) // 8 if first is not None else 0
    if n > 1 and known != n or known and not np.isfinite(_from(first, np.zeros(1, np.int64))).all():
        raise ValueError("the graph is not connected")
    spark = vertices.sparkSession
    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n * n // STREAM_CELLS))
    held = graph.withColumns({"at": F.lit(b""), "numbers": F.lit(b"")}) if values is None else graph.crossJoin(values)
    rows = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(held))  # one row for each task

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, at = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["at"], "<i8")
                numbers = np.frombuffer(r["numbers"], "<f8").reshape(-1, len(at)) if len(at) else np.empty((0, 0))
                graph = _Held(r)
                own = np.arange(r["id"], len(ids), tasks)
                for few in np.array_split(own, -(-len(own) * len(ids) // TASK_CELLS) or 1):
                    if len(few):
                        yield from pa.table(fold(ids, few, graph.distances(few), (at, numbers))).to_batches(max_chunksize=ARROW_ROWS)

    return rows.mapInArrow(run, schema)


class _Held:
    """A packed graph in a task."""

    def __init__(self, row):
        start, to, w = (np.frombuffer(row[c], t) for c, t in (("start", "<i8"), ("to", "<i8"), ("w", "<f8")))
        self.hub, self.own, self.trunk, self.place = _trunk(start, to, w)

    def distances(self, at: np.ndarray) -> np.ndarray:
        hubs, which = np.unique(self.hub[at], return_inverse=True)
        d = _reached(*self.trunk, self.place[hubs], math.inf)
        out = np.take(d, self.place[self.hub], axis=1)[which]
        out += self.own[None, :]
        out += self.own[at][:, None]
        out[np.arange(len(at)), at] = 0.0
        return out


def _from(row, at: np.ndarray) -> np.ndarray:
    return _Held(row.asDict()).distances(at)


def _above(ids, at, d, _):
    """i, j, d of the pairs whose first id is the source's."""
    ends = [slice(a + 1, None) for a in at]
    return {"i": np.repeat(ids[at], len(ids) - 1 - at), "j": np.concatenate([ids[k] for k in ends]), "d": np.concatenate([x[k] for x, k in zip(d, ends, strict=True)])}


def all_pairs(edges: DataFrame, vertices: DataFrame, weighted: bool = True, most: int | None = None) -> DataFrame:
    """i, j, d for i < j; an error if some pair is unreachable or the vertices are more than ``most``. The rows are as many as the pairs; those of a graph that a task can hold are made anew
    whenever they are read, so they take no storage."""
    n = vertices.count()
    if most is not None:
        guard_all_pairs(n, most)
    if edges.count() * 2 <= TASK_EDGES:
        return all_rows(edges, vertices, _above, "i bigint, j bigint, d double", weighted)
    s = vertices.select(F.col("v").alias("s"))
    d = distances(edges, s, above=True) if weighted else hops(edges, s, above=True)
    d = d.select(F.col("s").alias("i"), F.col("v").alias("j"), F.col("d").cast("double").alias("d"))
    if d.count() != n * (n - 1) // 2:
        raise ValueError("the graph is not connected")
    return d


def diameter_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The greatest distance in a connected graph that a task can hold; tasks keep no more than that of their sources."""
    return diameter(all_rows(edges, vertices, lambda ids, at, d, _: {"d": d.max(axis=1)}, "d double"))


def predecessors(edges: DataFrame, dist: DataFrame, tol: float = 1.49e-8) -> DataFrame:
    """s, v, u: every u that comes right before v on some shortest path from s."""
    e = adjacency(edges).groupBy("src", "dst").agg(F.min("w").alias("w"))
    du, dv = dist.select("s", F.col("v").alias("src"), F.col("d").alias("du")), dist.select("s", F.col("v").alias("dst"), F.col("d").alias("dv"))
    scale = F.greatest(F.lit(1.0), F.col("dv"))
    near = (F.col("du") + tol * scale < F.col("dv")) & (F.abs(F.col("du") + F.col("w") - F.col("dv")) <= tol * scale)
    return e.join(du, "src").join(dv, ["s", "dst"]).where(near).select("s", F.col("dst").alias("v"), F.col("src").alias("u"), "w")


def tree(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """s, v, parent: the smallest predecessor."""
    return predecessors(edges, dist).groupBy("s", "v").agg(F.min("u").alias("parent"))


def path_edges(parents: DataFrame, pairs: DataFrame, rounds: int = 100_000) -> DataFrame:
    """i, j, u, v, coeff for the tree path of each pair (i, j), from j back to its root i."""
    up = parents.select(F.col("s").alias("i"), F.col("v").alias("at"), "parent")
    walk = Rounds(pairs.select("i", "j", F.col("j").alias("at")).join(up, ["i", "at"]).select("i", "j", "at", "parent"), "walk")
    for _ in range(rounds):
        if walk.last.isEmpty():
            return walk.all().select("i", "j", F.least("at", "parent").alias("u"), F.greatest("at", "parent").alias("v"), F.lit(1.0).alias("coeff"))
        walk.add(walk.last.select("i", "j", F.col("parent").alias("at")).join(up, ["i", "at"]).select("i", "j", "at", "parent"))
    raise RuntimeError("a path has a cycle")


def path_counts(edges: DataFrame, dist: DataFrame, rounds: int = 100_000) -> DataFrame:
    """s, v, log_paths, paths: the number of shortest paths from s to v, in waves along the predecessor graph. Counts are kept as logarithms, whose sums are shifted by the
    largest, so they do not overflow. ``paths`` are sums of counts, exact up to 2^53 (and to some 15 digits beyond, infinite from 1e308 on); a graph that no task holds takes the exponentials of
    the logarithms, which are right to some 13 digits."""
    p = materialize(predecessors(edges, dist).select("s", "v", "u"), "dag")
    if (p.groupBy("s").count().agg(F.max("count")).first()[0] or 0) <= TASK_EDGES:
        own = p.groupBy("s").applyInPandas(_counted, "s bigint, v bigint, log_paths double, paths double")
        return materialize(dist.where("s = v").select("s", "v", F.lit(0.0).alias("log_paths"), F.lit(1.0).alias("paths")).union(own), "counts")
    need = materialize(p.groupBy("s", "v").agg(F.count(F.lit(1)).alias("need")), "need")
    done = Rounds(dist.where("s = v").select("s", "v", F.lit(0.0).alias("log_paths")), "counts")
    got = None  # what has arrived at vertices that still wait
    for _ in range(rounds):
        arrive = p.join(done.last.select("s", F.col("v").alias("u"), F.col("log_paths").alias("l")), ["s", "u"]).select("s", "v", "l")
        got, old = materialize(arrive if got is None else got.union(arrive), "arrived"), got
        discard(old)
        full = got.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"), F.max("l").alias("m")).join(need, ["s", "v"]).where("n = need")
        wave = done.add(log_sum_exp(got, full, ["s", "v"]).select("s", "v", "log_paths"))
        if wave.isEmpty():
            discard(p, need, got)
            return done.all().withColumn("paths", F.exp("log_paths"))
        got, old = materialize(got.join(wave.select("s", "v"), ["s", "v"], "left_anti"), "arrived"), got
        discard(old)
    raise RuntimeError("path counts did not settle")


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """s, v, log_paths, paths of a source's predecessor graph: a vertex is counted as soon as all that come right before it are."""
    ids, at = np.unique(np.concatenate([pdf["v"], pdf["u"]]), return_inverse=True)
    v, u = at[: len(pdf)], at[len(pdf) :]
    into, outof = np.argsort(v, kind="stable"), np.argsort(u, kind="stable")
    first, after = (np.searchsorted(x[o], np.arange(len(ids) + 1)) for x, o in ((v, into), (u, outof)))
    spread = lambda start, k: (own := np.repeat(np.arange(len(k)), np.diff(start)[k]), start[k][own] + np.arange(len(own)) - np.searchsorted(own, own))
    wait, logs, sums, n = np.diff(first), np.zeros(len(ids)), np.ones(len(ids)), 0
    ready = np.flatnonzero(wait == 0)
    while len(ready):
        n += len(ready)
        _, e = spread(after, ready)
        met = v[outof[e]]
        np.subtract.at(wait, met, 1)
        ready = np.unique(met[wait[met] == 0])
        if len(ready):
            own, e = spread(first, ready)
            got, begin = logs[u[into[e]]], np.searchsorted(own, np.arange(len(ready)))
            top = np.maximum.reduceat(got, begin)
            logs[ready] = top + np.log(np.add.reduceat(np.exp(got - top[own]), begin))
            with np.errstate(over="ignore"):
                sums[ready] = np.add.reduceat(sums[u[into[e]]], begin)
    if n < len(ids):
        raise RuntimeError("path counts did not settle")
    s = pdf["s"].iloc[0]
    keep = ids != s
    return pd.DataFrame({"s": s, "v": ids[keep], "log_paths": logs[keep], "paths": sums[keep]})


def log_sum_exp(rows: DataFrame, tops: DataFrame, key: list[str]) -> DataFrame:
    """log_paths = log of the sum of exp(l) a key, each l less the key's largest (m in ``tops``)."""
    x = rows.join(tops.select(*key, "m"), key).groupBy(*key, "m").agg(F.sum(F.exp(F.col("l") - F.col("m"))).alias("sum"))
    return x.select(*key, (F.col("m") + F.log("sum")).alias("log_paths"))


def tie_average(edges: DataFrame, dist: DataFrame, pairs: DataFrame, tol: float = 1.49e-8) -> DataFrame:
    """i, j, u, v, coeff: the share of the shortest paths of pair (i, j) that use edge (u, v); ``dist`` has both ends as sources. Only edges of i's predecessor graph that are
    also on a way from j are formed."""
    counts = materialize(path_counts(edges, dist), "counts")
    x = dist.join(counts, ["s", "v"])
    total = pairs.join(x.select(F.col("s").alias("i"), F.col("v").alias("j"), F.col("d").alias("g"), F.col("log_paths").alias("all")), ["i", "j"])
    both = lambda c, d, l: x.select(F.col("s").alias(c), "v", F.col("d").alias(d), F.col("log_paths").alias(l))
    # Vertices on some shortest path of the pair: their distances to both ends add up.
    on = total.join(both("i", "di", "li"), "i").join(both("j", "dj", "lj"), ["j", "v"]).where(F.abs(F.col("di") + F.col("dj") - F.col("g")) <= tol * F.greatest(F.lit(1.0), F.col("g")))
    on = materialize(on.select("i", "j", "v", "di", "li", "lj", "all"), "on-paths")
    dag = predecessors(edges, dist).select(F.col("s").alias("i"), "u", "v")
    r = dag.join(on.select("i", "j", "v", "lj", "all"), ["i", "v"]).join(on.select("i", "j", F.col("v").alias("u"), "li"), ["i", "j", "u"])
    return r.groupBy("i", "j", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(F.exp(F.col("li") + F.col("lj") - F.col("all"))).alias("coeff")).withColumnsRenamed({"a": "u", "b": "v"})


def diameter(dist: DataFrame) -> DataFrame:
    return dist.agg(F.max("d").cast("double").alias("diameter"))
