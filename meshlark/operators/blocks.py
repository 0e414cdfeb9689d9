"""Blocks of vectors around pivots, and the pairs of blocks that a search of nearest rows cannot leave out.

Rows go to the nearest of a bounded number of pivots; a pivot's rows are cut by their distance to it into rings, and rings into blocks of about ``BLOCK`` rows. A block keeps the least and
greatest distance of its rows (balls, where they have a radius) to the pivot, and each row how far away its answers can be at most. By the triangle inequality these say from pivots alone, then from blocks, then
row by row, where nothing can be near enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.plans.shared import join_counted, materialize

BLOCK, CELL_ROWS, MAX_PIVOTS = 512, 128, 1024
STRIPE_BYTES, STRIPES = 32 << 20, 8
SLACK = 1e-9  # of a bound, for rounding
PACKED = "b bigint, cell int, n int, dim int, lo double, hi double, most double, ids binary, xs binary, at binary, labels binary, bounds binary, bodies binary"


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a to all rows of b, some rows at a time; differences come first and components follow each other, as in a scalar loop."""
    out = np.zeros((len(a), len(b)))
    step, columns = max(1, (1 << 17) // max(1, len(b))), np.ascontiguousarray(b.T)
    for lo in range(0, len(a), step):
        x, best = np.ascontiguousarray(a[lo : lo + step].T), out[lo : lo + step]
        d = np.empty_like(best)
        for p, q in zip(x, columns, strict=True):
            np.subtract(p[:, None], q[None, :], out=d)
            if metric == "linf":
                np.maximum(best, np.abs(d, out=d), out=best)
            else:
                best += np.multiply(d, d, out=d)
        if metric != "linf":
            np.sqrt(best, out=best)
    return out


def matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float64)


@dataclass(frozen=True)
class Pivots:
    """Rows of the target by hash of their ids, at most ``MAX_PIVOTS``, and their distances to each other."""

    ids: np.ndarray
    at: np.ndarray
    apart: np.ndarray
    metric: str


def pivots_of(target: DataFrame, metric: str, rows: int | None = None) -> Pivots:
    count = min(MAX_PIVOTS, -(-(rows if rows is not None else target.count()) // CELL_ROWS) or 1)
    got = target.select("v", F.transform("x", lambda a: a.cast("double")).alias("x")).orderBy(F.xxhash64("v"), "v").limit(count).collect()
    at = np.array([r.x for r in got], dtype=np.float64).reshape(len(got), -1)
    return Pivots(np.array([r.v for r in got], dtype=np.int64), at, pairwise(at, at, metric), metric)


def assigned(obs: DataFrame, p: Pivots) -> DataFrame:
    """v, x, c, t, r, body, cell, at: the nearest pivot of each row and its distance. What ``obs`` lacks of a label c, a bound t, a radius r and a body (an array of numbers) is 0, infinite, 0 and empty."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                d = pairwise(matrix(pdf["x"]), p.at, p.metric)
                yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), at=d.min(axis=1))

    without = {"c": F.lit(0).cast("bigint"), "t": F.lit(float("inf")), "r": F.lit(0.0), "body": F.array().cast("array<double>")}
    o = obs.select("v", F.transform("x", lambda a: a.cast("double")).alias("x"), *((F.col(c) if c in obs.columns else x).alias(c) for c, x in without.items()))
    return o.mapInPandas(run, "v bigint, x array<double>, c bigint, t double, r double, body array<double>, cell int, at double")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v")
    x, first = matrix(pdf["x"]), pdf.iloc[0]
    as_bytes = lambda c, t: pdf[c].to_numpy(t).tobytes()
    return pd.DataFrame(
        {
            "b": [first["b"]], "cell": [first["cell"]], "n": [len(pdf)], "dim": [x.shape[1]], "lo": [(pdf["at"] - pdf["r"]).min()], "hi": [(pdf["at"] + pdf["r"]).max()], "most": [pdf["t"].max()],
            "ids": [as_bytes("v", "<i8")], "xs": [x.tobytes()], "at": [as_bytes("at", "<f8")], "labels": [as_bytes("c", "<i8")], "bounds": [as_bytes("t", "<f8")], "bodies": [np.concatenate(pdf["body"].tolist()).tobytes()],
        }
    )


def packed(obs: DataFrame, p: Pivots, block: int = BLOCK, k: int | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """The blocks of ``obs`` (v, x, maybe c and t; or what ``assigned`` returns), and a row for each cell: cell, n, lo, hi, most. Rings of many rows, such as copies of one vector, are cut by hash.

    With ``k`` each row's bound is lowered to where k other rows are sure to be: from the rows of its own block, and from the nearest cells that hold more than k rows together.
    """
    rows = materialize(obs if "cell" in obs.columns else assigned(obs, p), "assigned")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("at") - F.col("r")).alias("lo"), F.max(F.col("at") + F.col("r")).alias("hi"), F.max("t").alias("most")).toPandas().sort_values("cell")  # at most MAX_PIVOTS rows
    b = F.col("cell").cast("bigint") * F.lit(1 << 42)
    if (sizes["n"] > block).any():
        cells = rows.sparkSession.createDataFrame(sizes.assign(rings=-(-sizes["n"] // block), wide=sizes["hi"] - sizes["lo"])[["cell", "lo", "wide", "rings"]])
        ring = F.when(F.col("wide") > 0, F.least(F.floor((F.col("at") - F.col("lo")) / F.col("wide") * F.col("rings")), F.col("rings") - 1)).otherwise(0).cast("bigint")
        rows = rows.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("lo", "wide", "rings")
        count = rows.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("count"))
        rows = join_counted(rows, count.withColumn("parts", F.ceil(F.col("count") / block)), ["cell", "ring"], int(sizes["n"].sum()))
        b = b + F.col("ring") * F.lit(1 << 21) + F.pmod(F.xxhash64("v"), F.col("parts"))
    out = rows.select("v", "x", "c", "t", "r", "body", "cell", "at", b.alias("b"))
    if k is None:
        return materialize(out.groupBy("b").applyInPandas(_pack, PACKED), "blocks"), sizes
    out = materialize(out.groupBy("b").applyInPandas(_bounded(_reach(sizes, p, k), p.metric, k), PACKED), "blocks")
    most = out.groupBy("cell").agg(F.max("most").alias("most")).toPandas()
    return out, sizes.drop(columns="most").merge(most, on="cell").sort_values("cell")


def _reach(cells: pd.DataFrame, p: Pivots, k: int) -> np.ndarray:
    """For each cell the distance from its pivot within which cells hold more than k rows."""
    n, out = cells["n"].to_numpy(), np.full(len(p.at), np.inf)
    for c in cells["cell"]:
        far = p.apart[c, cells["cell"]] + cells["hi"].to_numpy()
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(n[order]), k + 1)
        if enough < len(order):
            out[c] = far[order[enough]]
    return out


def _bounded(reach: np.ndarray, metric: str, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        t = np.minimum(pdf["t"].to_numpy(), pdf["at"].to_numpy() + reach[pdf["cell"].iloc[0]])
        if len(pdf) > k:
            x = matrix(pdf["x"])
            d = pairwise(x, x, metric)
            np.fill_diagonal(d, np.inf)
            t = np.minimum(t, np.partition(d, k - 1, axis=1)[:, k - 1])
        return _pack(pdf.assign(t=t))

    return run


def _gap(apart, lo, hi, other_lo, other_hi, least):
    """The least distance between rows of two rings: of distance lo to hi from one pivot, and other_lo to other_hi from another that is ``apart``."""
    return least(apart - hi - other_hi, other_lo - apart - hi, lo - apart - other_hi)


def block_pairs(source: DataFrame, source_cells: pd.DataFrame, target: DataFrame, target_cells: pd.DataFrame, p: Pivots) -> DataFrame:
    """b, other, gap: the pairs of blocks that may hold a row within a row's bound, and how far apart they are at least. Pairs of cells, at most ``MAX_PIVOTS`` squared, are settled first, from their pivots alone."""
    s, t = source_cells, target_cells
    apart = p.apart[np.ix_(s["cell"], t["cell"])]
    col = lambda c: s[c].to_numpy()[:, None]
    gap = _gap(apart, col("lo"), col("hi"), t["lo"].to_numpy()[None, :], t["hi"].to_numpy()[None, :], lambda *x: np.maximum.reduce(x))
    i, j = np.nonzero(gap <= col("most") * (1 + SLACK) + SLACK)
    spark = source.sparkSession
    near = spark.createDataFrame(pd.DataFrame({"cell": s["cell"].to_numpy()[i], "cell2": t["cell"].to_numpy()[j], "apart": apart[i, j]}), "cell int, cell2 int, apart double")
    a = source.select("b", "cell", "lo", "hi", "most")
    o = target.select(F.col("b").alias("other"), F.col("cell").alias("cell2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    x = a.join(near, "cell").join(o, "cell2")
    gap = _gap(F.col("apart"), F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"), F.greatest)
    return x.where(gap <= F.col("most") * (1 + SLACK) + SLACK).select("b", "other", F.greatest(gap, F.lit(0.0)).alias("gap"))


def _stripes(packed: DataFrame) -> int:
    """Into how many stripes blocks are dealt, so that a task holds one of the source and one of the target: ``STRIPES`` at least, of about ``STRIPE_BYTES`` at most."""
    held = packed.agg(F.sum(F.col("n") * (F.col("dim") + 4) * 8)).first()[0] or 0
    return max(STRIPES, -(-held // STRIPE_BYTES))


def _nearest_few(v: np.ndarray, u: np.ndarray, d: np.ndarray, rows: int, k: int, ties: bool) -> tuple[np.ndarray, ...]:
    """Of candidates (row, u, d) the k nearest of each of ``rows`` rows and (``ties``) what ties with the last, and how far away the last is (infinite with fewer)."""
    order = np.lexsort((d, v))
    v, u, d = v[order], u[order], d[order]
    first = np.searchsorted(v, np.arange(rows + 1))
    edge = np.full(rows, np.inf)
    enough = np.flatnonzero(np.diff(first) >= k)
    edge[enough] = d[first[enough] + k - 1]
    keep = d <= edge[v] if ties else np.arange(len(v)) - first[v] < k
    return v[keep], u[keep], d[keep], edge


def searched(pairs: DataFrame, source: DataFrame, target: DataFrame, p: Pivots, k: int, apart: bool = False, ties: bool = True) -> DataFrame:
    """v, u, d: rows of the target within each row's bound, the k nearest of each pair of stripes and (``ties``) what ties with the last; not the row itself, or (``apart``) none with its label.

    Blocks are dealt to stripes, and a task takes a stripe of the source and one of the target: a block goes to as many tasks as there are stripes at most, not to one for each block that it meets.
    What a row has found lowers its bound for the blocks after it, and only its nearest of a stripe leave the task."""
    s = source.select("b", "dim", "ids", "xs", "labels", "bounds")
    t = target.select(F.col("b").alias("other"), F.col("cell").alias("cell2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("ids").alias("ids2"), F.col("xs").alias("xs2"), F.col("labels").alias("labels2"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    met = materialize(pairs.select("b", "other", "gap", dealt("b", _stripes(source)).alias("sa"), dealt("other", _stripes(target)).alias("sb")), "met")
    left = met.groupBy("b", "sa", "sb").agg(F.sort_array(F.collect_list(F.struct("gap", "other")))["other"].alias("others")).join(s, "b")
    right = met.select(F.col("sa").alias("ta"), F.col("sb").alias("tb"), "other").distinct().join(t, "other")

    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found, at_hand = [], {r.other: r for r in held.itertuples(index=False)}
        for r in own.itertuples(index=False):
            ids, bounds = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.bounds).copy()
            x, labels = np.frombuffer(r.xs).reshape(-1, r.dim), np.frombuffer(r.labels, "<i8")
            got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for o in map(at_hand.__getitem__, r.others):
                other, labels2, y = np.frombuffer(o.ids2, "<i8"), np.frombuffer(o.labels2, "<i8"), np.frombuffer(o.xs2).reshape(-1, r.dim)
                at = pairwise(x, p.at[o.cell2][None, :], p.metric)[:, 0]
                rows = np.flatnonzero(np.maximum(at - o.hi2, o.lo2 - at) <= bounds * (1 + SLACK) + SLACK)
                if not len(rows):
                    continue
                d = pairwise(x[rows], y, p.metric)
                d[(labels[rows, None] == labels2[None, :]) if apart else (ids[rows, None] == other[None, :])] = np.inf
                d[d > bounds[rows, None] * (1 + SLACK) + SLACK] = np.inf
                take = min(k, len(other))
                edge = np.partition(d, take - 1, axis=1)[:, take - 1]  # ties at the edge are all kept, so that the smaller ids can win
                i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                *got, edge = _nearest_few(np.concatenate([got[0], rows[i]]), np.concatenate([got[1], other[j]]), np.concatenate([got[2], d[i, j]]), len(ids), k, ties)
                bounds = np.minimum(bounds, edge)
            found.append(pd.DataFrame({"v": ids[got[0]], "u": got[1], "d": got[2]}))
        return pd.concat(found) if found else pd.DataFrame({"v": np.empty(0, np.int64), "u": np.empty(0, np.int64), "d": np.empty(0)})

    return left.groupBy("sa", "sb").cogroup(right.groupBy("ta", "tb")).applyInPandas(run, "v bigint, u bigint, d double")
