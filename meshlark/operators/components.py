"""Connected components of an edge table by contraction, in levels that are sure to end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.plans.shared import average_ranks, discard, join_counted, materialize

TASK_EDGES, BROADCAST_ROOTS = 500_000, 500_000


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Every id of some edges and the smallest id that it reaches over them."""
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:  # places are in the order of ids, so the smallest place is the smallest id
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    yield from pa.Table.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "root"]).to_batches(max_chunksize=50_000)


def _roots(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``_joined`` of up to about ``most`` edges of a partition at a time."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
                n += b.num_rows
            if n >= most:
                yield from _joined(held)
                held, n = [], 0
        if held:
            yield from _joined(held)

    return run


def _near(e: DataFrame, n: int, tasks: int, tidy: bool) -> tuple[DataFrame, DataFrame]:
    """id, root of what each task's edges join, some ``TASK_EDGES`` at a time, and the edges that tie an id's several roots. An id has one root each time, so no key is hot."""
    roots = e.coalesce(tasks).mapInArrow(_roots(max(TASK_EDGES, -(-n // tasks))), "id bigint, root bigint").groupBy("id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    level = materialize(roots, "roots", tidy)
    ties = level.select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b")
    return level, materialize(ties.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", tidy)


def _far(e: DataFrame, n: int, level: int, tidy: bool) -> tuple[DataFrame, DataFrame]:
    """id, root: the id of least priority among an id and its neighbours, where priorities are drawn anew for each level; and the edges between roots.

    In expectation at most two thirds of the ids are roots, whatever the graph and however its ids are ordered.
    """
    drawn = lambda c: F.struct(F.xxhash64(F.lit(level), F.col(c)).alias("p"), F.col(c).alias("v"))
    both = e.union(e.select("b", "a"))
    least = both.groupBy(F.col("a").alias("id")).agg(F.min(drawn("b")).alias("b"), F.count(F.lit(1)).alias("count"))
    level_map = materialize(least.select("id", F.least(drawn("id"), F.col("b"))["v"].alias("root"), "count"), "roots", tidy)
    for c in ("a", "b"):
        e = join_counted(e, level_map.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"), "count"), [c], n)
    rest = e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return level_map, materialize(rest, "edges", tidy)


def onward(level: DataFrame, up: DataFrame, key: str, tidy: bool) -> DataFrame:
    """id, root of ``level`` with each root replaced by what ``up`` (key, top) says of it; a root of many ids is no hot key."""
    sizes = level.groupBy("root").agg(F.count(F.lit(1)).alias("count"))
    to = sizes.join(up.withColumnRenamed(key, "root"), "root", "left").select("root", F.coalesce("top", "root").alias("top"), "count")
    to = materialize(to, "tops", tidy)
    out = materialize(join_counted(level.select("id", "root"), to, ["root"], level.count()).select("id", F.col("top").alias("root")), "roots", tidy)
    discard(to)
    return out


def contraction(edges: DataFrame, tidy: bool = True) -> tuple[DataFrame, int]:
    """id, component (the smallest id that it reaches) for every id of ``edges`` (a bigint, b bigint), and the number of levels.

    What one task holds is joined there. Above ``TASK_EDGES`` edges a level first joins what its tasks hold; once that leaves more than half of the edges, levels contract each id
    to the one of least random priority next to it, of which some log(ids) / log(3/2) are enough. More than four times that many is an error. The maps of the levels are then joined
    from the last to the first, and each root gives way to the smallest id of its component.
    """
    e = materialize(edges.where("a <> b").select("a", "b"), "edges", tidy)
    maps: list[DataFrame] = []
    most, near, random = 0, True, False
    while (n := e.count()) or not maps:
        most = most or 4 * int(np.log(n + 2) / np.log(1.5) + 8)
        if len(maps) >= most:
            raise RuntimeError(f"{n} edges are left after {most} levels")
        tasks = -(-n // TASK_EDGES) or 1
        if near or tasks == 1:
            level, after = _near(e, n, tasks, tidy)
            near = tasks > 1 and 2 * after.count() < n
        else:
            level, after = _far(e, n, len(maps), tidy)
            random = True
        maps.append(level)
        discard(e)
        e = after
    discard(e)
    done = [maps[-1]]
    for level in maps[-2::-1]:
        done.append(onward(level, done[-1].select("id", F.col("root").alias("top")), "id", tidy))
    if random:  # roots are the smallest ids unless priorities were drawn
        done.append(onward(done[-1], done[-1].groupBy("root").agg(F.min("id").alias("top")), "root", tidy))
    discard(*maps[:-1], *done[:-1])
    return done[-1].select("id", F.col("root").alias("component")), len(maps)


def components(edges: DataFrame, tidy: bool = True) -> DataFrame:
    """id, component (the smallest id it reaches) for every id of ``edges`` (a bigint, b bigint); ids without edges are absent."""
    return contraction(edges, tidy)[0]


def _rooted(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    c = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("id", "v")
    return materialize(vertices.select("v").join(c, "v", "left").select("v", F.coalesce("component", "v").alias("root")), "rooted")


def numbered(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v, component numbered from 1 by its smallest vertex; isolated vertices are components of their own. Roots are ranked in ranges."""
    c = _rooted(vertices, edges)
    place: Column = F.col("rank").cast("int").alias("component")
    k = average_ranks(c.select("root").distinct(), "root").select("root", place)
    if c.count() <= BROADCAST_ROOTS:
        return c.join(F.broadcast(k), "root").select("v", "component")
    sizes = c.groupBy("root").agg(F.count(F.lit(1)).alias("count"))
    return join_counted(c, materialize(sizes.join(k, "root"), "numbers"), ["root"], c.count()).select("v", "component")


def largest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices of the largest component; ties go to the one with the smallest vertex."""
    c = _rooted(vertices, edges)
    top = c.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1)
    return c.join(F.broadcast(top.select("root")), "root").select("v")
