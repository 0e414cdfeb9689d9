"""Exact top-k inner products by best-first search of M-trees.

Rows go to the nearest of a bounded number of pivots, and the rows of a pivot to trees of bounded size. A tree is built once and stored: its nodes are pages in
one table of entries, each with its centre, its covering radius and its distance to the parent's centre; leaf pages are runs of rows, nearest to the page's centre first. For a
query q and an entry with centre c and radius r, the inner product with anything below is at most q.c + |q| r, and before q.c
is known at most q.p + |q| (d(p, c) + r) for the parent p: the stored distance spares the computation. A search takes the entry of the best bound first.

Every query searches the tree that holds it, which gives a floor: the k-th best score so far. Only trees whose root's bound reaches the floor are searched then, from that floor on.
Queries of a block go down a tree together. A tree meets its queries in groups of ``MEET_BLOCKS`` blocks, so neither side is unbounded in a task.

Defined results: rows whose vector is null or has null or non-finite components take no part, nor do rows without
vec_id. Vectors of different lengths are not compared. Rows that repeat a vec_id are candidates of other ids but
never of their own; each repeated query row has its own ranks. Ties go to the smaller vec_id. floor(scale * x) beyond 64 bits is the nearest
64-bit integer; inner products must fit in 64 bits. Where floats may not hold them exactly (by the largest norms of tree and queries) scores are computed in integers, and bounds
have slack. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.common import discard, join_counted, materialize

PAGE, FAN, TREE_BYTES, BLOCK_ROWS, MAX_PIVOTS, PART_TREES, MEET_BLOCKS = 64, 16, 8 << 20, 256, 4096, 1024, 64
TREE = "dim int, tree bigint, ids binary, vs binary, gaps binary, centres binary, radii binary, ups binary, links binary, longest double"


class MTree:
    """Entries in breadth-first order: ``links`` is (leaf, first, last): of entries, or of rows for a leaf page."""

    def __init__(self, ids, rows, gaps, centres, radii, ups, links):
        self.ids, self.rows, self.gaps, self.centres, self.radii, self.ups, self.links = ids, rows, gaps, centres, radii, ups, links
        self.x = rows.astype(np.float64)
        self.longest = float(np.sqrt((self.x**2).sum(axis=1)).max(initial=0.0))
        self.scored = 0

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> MTree:
        """Bulk-loaded: rows around the farthest-apart pivots, again and again, down to pages."""
        x, n = rows.astype(np.float64), len(ids)
        todo, at = [(np.arange(n), np.zeros(x.shape[1]), 0)], 0
        centres, radii, ups, links, order, gaps = [], [], [], [], [], []
        while at < len(todo):
            own, up, depth = todo[at]
            todo[at] = None  # the rows of inner entries are not kept
            c = x[own].mean(axis=0) if len(own) else np.zeros(x.shape[1])
            gap = np.sqrt(((x[own] - c) ** 2).sum(axis=1))
            centres.append(c)
            radii.append(float(gap.max(initial=0.0)))
            ups.append(float(np.sqrt(((c - up) ** 2).sum())) if at else 0.0)
            if len(own) <= PAGE or radii[-1] == 0.0 or depth > 24:
                by = np.argsort(gap, kind="stable")
                first = sum(map(len, order))
                order.append(own[by])
                gaps.append(gap[by])
                links.append((1, first, first + len(own)))
            else:
                p = int(own[np.argmax(gap)])
                near, owner = ((x[own] - x[p]) ** 2).sum(axis=1), np.zeros(len(own), dtype=np.int64)
                for k in range(1, min(FAN, -(-len(own) // PAGE))):  # the farthest point is next
                    if near.max() == 0.0:
                        break
                    d = ((x[own] - x[int(own[np.argmax(near)])]) ** 2).sum(axis=1)
                    owner[d < near] = k
                    near = np.minimum(near, d)
                parts = [part for k in range(int(owner.max()) + 1) if len(part := own[owner == k])]
                links.append((0, len(todo), len(todo) + len(parts)))
                todo += [(part, c, depth + 1) for part in parts]
            at += 1
        by = np.concatenate(order) if n else np.empty(0, dtype=np.int64)
        return cls(ids[by], rows[by], np.concatenate(gaps) if n else np.empty(0), np.array(centres), np.array(radii), np.array(ups), np.array(links, dtype="<i8"))

    def pack(self, dim: int, tree: int) -> tuple:
        return (dim, tree, self.ids.tobytes(), self.rows.tobytes(), self.gaps.tobytes(), self.centres.tobytes(), self.radii.tobytes(), self.ups.tobytes(), self.links.tobytes(), self.longest)

    @classmethod
    def unpack(cls, r) -> MTree:
        f = lambda b, t="<f8": np.frombuffer(b, dtype=t)
        ids, radii = f(r.ids, "<i8"), f(r.radii)
        return cls(ids, f(r.vs, "<i8").reshape(len(ids), r.dim), f(r.gaps), f(r.centres).reshape(len(radii), r.dim), radii, f(r.ups), f(r.links, "<i8").reshape(-1, 3))

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its k best (scores, vec_ids), best first; none below its ``least``, from which the search starts."""
        m = len(query_ids)
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in range(m)]
        if not len(self.ids) or not m:
            return found
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        exact = self.longest * float(norm.max()) < 2.0**51  # no partial sum is longer
        slack = 1.0 + 1e-9 * norm * self.longest
        floor = np.full(m, np.iinfo(np.int64).min) if least is None else least.copy()
        low = floor.astype(np.float64) - slack  # what a bound must reach
        dot = q @ self.centres[0]
        bound = dot + norm * self.radii[0]
        heap, n = [(-float((bound - low).max()), 0, bound, dot, 0)], 1
        while heap:
            _, _, bound, dot, node = heapq.heappop(heap)
            on = np.flatnonzero(bound >= low)
            if not len(on):
                continue
            leaf, first, last = self.links[node]
            if leaf:
                # Rows come by their distance to the centre: the first ones are too near it to reach any floor.
                if (norm[on] > 0).all():
                    first += int(np.searchsorted(self.gaps[first:last], ((low[on] - dot[on]) / norm[on]).min()))
                ids = self.ids[first:last]
                s = np.rint(self.x[first:last] @ q[on].T).astype(np.int64) if exact else self.rows[first:last] @ queries[on].T
                self.scored += s.size
                hit = (s >= floor[on]) & (ids[:, None] != query_ids[on][None, :])
                for c in np.flatnonzero(hit.any(axis=0)):
                    j, h = on[c], np.flatnonzero(hit[:, c])
                    best_s, best_i = np.concatenate([found[j][0], s[h, c]]), np.concatenate([found[j][1], ids[h]])
                    order = np.lexsort((best_i, ~best_s))[:k]
                    found[j] = best_s[order], best_i[order]
                    if len(order) == k and best_s[order[-1]] > floor[j]:
                        floor[j] = best_s[order[-1]]
                        low[j] = float(floor[j]) - slack[j]
                continue
            # The stored distances to the parent's centre rule out entries before their own centres are compared.
            reach = self.ups[first:last] + self.radii[first:last]
            which = first + np.flatnonzero((dot[on][None, :] + norm[on][None, :] * reach[:, None] >= low[on][None, :]).any(axis=1))
            for d, e in zip(self.centres[which] @ q[on].T, which, strict=True):
                up, full = np.full(m, -np.inf), np.zeros(m)
                up[on], full[on] = d + norm[on] * self.radii[e], d
                if (up >= low).any():
                    heapq.heappush(heap, (-float((up - low).max()), n, up, full, e))
                    n += 1
        return found


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), dim; only rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    e = embeddings.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    e = e.where(~F.coalesce(bad, F.lit(False)))
    return e.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"), F.size("x").alias("dim"))


def _nearest(pivots: dict[int, np.ndarray]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pivot = np.zeros(len(pdf), dtype=np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                if (p := pivots.get(int(dim))) is not None and dim:
                    x = np.array(pdf["v"].iloc[at].tolist(), dtype=np.float64)
                    pivot[at] = np.argmin((p * p).sum(axis=1)[None, :] - 2 * x @ p.T, axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "dim": pdf["dim"], "pivot": pivot})

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    dim, tree = int(pdf["dim"].iloc[0]), int(pdf["tree"].iloc[0])
    rows = np.array(pdf["v"].tolist(), dtype="<i8").reshape(len(pdf), dim)
    return pd.DataFrame([MTree.build(pdf["vec_id"].to_numpy(dtype="<i8"), rows).pack(dim, tree)], columns=[f.split()[0] for f in TREE.split(", ")])


FOUND = "dim int, tree bigint, block bigint, qids binary, qs binary, qvs binary, floors binary, rows binary"


def _own(k: int, every: int):
    """Each tree's queries search it: per block the queries, their floors and (query, q, vec_id, score) of what they found."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                tree = MTree.unpack(r)
                at = np.flatnonzero(tree.ids % every == 0)
                for b in range(0, len(at), BLOCK_ROWS):
                    qs = at[b : b + BLOCK_ROWS]
                    best = tree.top(tree.ids[qs], tree.rows[qs], k)
                    floors = np.array([s[-1] if len(s) == k else np.iinfo(np.int64).min for s, _ in best], dtype="<i8")
                    out.append((r.dim, r.tree, b // BLOCK_ROWS, tree.ids[qs].tobytes(), qs.astype("<i8").tobytes(), tree.rows[qs].tobytes(), floors.tobytes(), _rows(tree.ids[qs], qs, best)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _rows(qids: np.ndarray, qs: np.ndarray, best: list) -> bytes:
    n = [len(s) for s, _ in best]
    cols = np.repeat(qids, n), np.repeat(qs, n), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])
    return np.stack(cols, axis=1).astype("<i8").tobytes()


def _pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, roots of some trees) -> the block's queries for each other tree whose root's bound reaches their floors."""
    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            f = lambda b, t="<i8": np.frombuffer(b, dtype=t)
            qids, floors = f(r.qids), f(r.floors)
            qv, q = f(r.qvs).reshape(len(qids), r.dim), f(r.qvs).reshape(len(qids), r.dim).astype(np.float64)
            norm, trees = np.sqrt((q * q).sum(axis=1)), f(r.trees)
            bound = q @ f(r.roots, "<f8").reshape(len(trees), r.dim).T + norm[:, None] * f(r.reach, "<f8")[None, :]
            may = bound >= floors.astype(np.float64)[:, None] - 1.0 - 1e-9 * norm[:, None] * f(r.longest, "<f8")[None, :]
            for t in np.flatnonzero(may.any(axis=0)):
                if trees[t] != r.tree:
                    on = np.flatnonzero(may[:, t])
                    out.append((r.dim, int(trees[t]), r.tree, qids[on].tobytes(), f(r.qs)[on].tobytes(), qv[on].tobytes(), floors[on].tobytes()))
        yield pd.DataFrame(out, columns=["dim", "tree", "home", "qids", "qs", "qvs", "floors"])


HIT = "home bigint, rows binary"


def _others(k: int):
    def run(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(trees) and len(blocks):
            tree = MTree.unpack(next(trees.itertuples(index=False)))
            for r in blocks.itertuples(index=False):
                qids, qs, floors = (np.frombuffer(b, dtype="<i8") for b in (r.qids, r.qs, r.floors))
                best = tree.top(qids, np.frombuffer(r.qvs, dtype="<i8").reshape(len(qids), r.dim), k, floors)
                out.append((r.home, _rows(qids, qs, best)))
        return pd.DataFrame(out, columns=["home", "rows"])

    return run


def _unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for home, rows in zip(pdf["home"], pdf["rows"], strict=True):
            x = np.frombuffer(rows, dtype="<i8").reshape(-1, 4)
            yield pd.DataFrame({"query_id": x[:, 0], "home": np.full(len(x), home, dtype="<i8"), "q": x[:, 1], "vec_id": x[:, 2], "score": x[:, 3]})


def _root_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        root = [c[: 8 * d] for c, d in zip(pdf["centres"], pdf["dim"], strict=True)]
        yield pd.DataFrame({"dim": pdf["dim"], "tree": pdf["tree"], "root": root, "reach": [float(np.frombuffer(r, dtype="<f8")[0]) for r in pdf["radii"]], "longest": pdf["longest"]})


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    pack = lambda c: pdf[c].to_numpy(dtype="<f8").tobytes()
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "part": pdf["part"].iloc[:1], "trees": [pdf["tree"].to_numpy(dtype="<i8").tobytes()], "roots": [b"".join(pdf["root"])], "reach": [pack("reach")], "longest": [pack("longest")]})


def build_trees(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """The stored trees of all rows that take part. Up to ``MAX_PIVOTS`` rows of smallest hash are the pivots; they only decide which rows lie together."""
    v = materialize(integer_vectors(embeddings, scale), "vectors", True)
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dim") * F.lit(8)).alias("bytes")).first()
    want = min(MAX_PIVOTS, max(1, -(-(size["bytes"] or 0) // TREE_BYTES)))
    pivots: dict[int, list] = {}
    for r in v.orderBy(F.xxhash64("v"), "vec_id").limit(want).collect():
        pivots.setdefault(r.dim, []).append(r.v)
    a = v.mapInPandas(_nearest({d: np.array(p, dtype=np.float64) for d, p in pivots.items()}), "vec_id bigint, v array<bigint>, dim int, pivot bigint")
    a = materialize(a, "assigned", True)
    share = a.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("count")).withColumn("trees", F.ceil(F.col("count") * F.greatest(F.col("dim"), F.lit(1)) * 8 / TREE_BYTES))
    t = join_counted(a, share, ["dim", "pivot"], size["n"]).withColumn("tree", F.shiftleft("pivot", 32) + F.pmod(F.xxhash64("vec_id", "v"), F.col("trees")))
    out = materialize(t.select("dim", "tree", "vec_id", "v").groupBy("dim", "tree").applyInPandas(_build, TREE), "trees", True)
    discard(v, a)
    return out


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by ``every``."""
    trees = build_trees(embeddings, scale)
    own = materialize(trees.mapInPandas(_own(k, every), FOUND), "own", True)
    n = max(1, -(-trees.count() // PART_TREES))
    part = F.pmod(F.xxhash64("tree"), F.lit(n))
    roots = trees.select("dim", "tree", "centres", "radii", "longest").mapInPandas(_root_rows, "dim int, tree bigint, root binary, reach double, longest double").withColumn("part", part).groupBy("dim", "part").applyInPandas(_roots, "dim int, part bigint, trees binary, roots binary, reach binary, longest binary")
    blocks = own.drop("rows").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    picked = blocks.join(roots, ["dim", "part"]).mapInPandas(_pick, "dim int, tree bigint, home bigint, qids binary, qs binary, qvs binary, floors binary")
    salts = max(1, -(-own.count() // MEET_BLOCKS))
    picked = materialize(picked.withColumn("salt", F.pmod(F.xxhash64("home", "qids"), F.lit(salts))), "picked", True)
    wanted = picked.select("dim", "tree", (F.col("salt") + 0).alias("salt")).distinct()  # a column of its own for the join below
    dealt = trees.join(wanted, ["dim", "tree"])  # a tree goes where queries have picked it
    hits = dealt.groupBy("dim", "tree", "salt").cogroup(picked.groupBy("dim", "tree", "salt")).applyInPandas(_others(k), HIT)
    found = own.select(F.col("tree").alias("home"), "rows").union(hits).mapInPandas(_unpack, "query_id bigint, home bigint, q bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id", "home", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
