"""Metric MDS: SGD by strata of tables, SMACOF as DataFrame iterations, classical MDS, continuation.

SGD visits pairs one after another. ``sgd_tables`` deals vertices to blocks and an epoch to rounds of a tournament between blocks: the tasks of a round share no vertex, so they run side by side and
every pair still moves its ends from where the last pair left them. ``sgd_kernel`` is the same for what fits one task, with continuation; both draw from seeds, so runs repeat within this library.
SMACOF majorises over all pairs at once.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators import objectives
from meshlark.operators.paths import all_rows, packed_values
from meshlark.operators.schedules import sgd_rates
from meshlark.plans.shared import discard, materialize

MAX_KERNEL_PAIRS = 20_000_000
BLOCK_VERTICES, BLOCK_PAIRS, ROUNDS_A_JOB = 20_000, 200_000, 6
RUN_PAIRS = 32  # of a matching on average, from which it is one step of arrays
TILE_ROWS, TILE_STEP, TILE_BLOCKS, POINT_ROWS = 1024, 256, 8, 8192  # of classical MDS: a stored tile, what is in hand of a tile, blocks of points at least, points of a block at most


def normalise_targets(pairs: DataFrame) -> DataFrame:
    """d by its root mean square, scaled by the greatest first so that squares neither vanish nor overflow."""
    m = pairs.agg(F.max("d").alias("m"))
    x = pairs.crossJoin(F.broadcast(m)).withColumn("q", F.col("d") / F.col("m"))
    r = x.agg(F.sqrt(F.avg(F.col("q") * F.col("q"))).alias("r"))
    return x.crossJoin(F.broadcast(r)).select("i", "j", (F.col("q") / F.col("r")).alias("d"))  # one row each


def pair_weights(pairs: DataFrame, weighting: str = "uniform") -> DataFrame:
    if weighting == "inverse_squared" and not pairs.where("d <= 0").isEmpty():
        raise ValueError("a target of 0 has no inverse-square weight")
    return pairs.withColumn("w", F.lit(1.0) if weighting == "uniform" else 1 / (F.col("d") * F.col("d")))


def sgd_pass(x: list[list[float]], order, i: list[int], j: list[int], t: list[float], mi: list[float], mj: list[float], rng: np.random.Generator) -> None:
    """Pairs one after another in the given order: each end moves by its own step towards or from the other."""
    for k in order:
        a, b = x[i[k]], x[j[k]]
        gap = [p - q for p, q in zip(a, b)]  # noqa: B905
        d = math.sqrt(sum([g * g for g in gap]))
        if d == 0.0:
            if t[k] == 0.0:
                continue
            gap = rng.normal(size=len(a)).tolist()
            d, move = math.sqrt(sum([g * g for g in gap])), -t[k] / 2
        else:
            move = (d - t[k]) / 2
        f, g = mi[k] * move / d, mj[k] * move / d
        x[i[k]] = [p - f * q for p, q in zip(a, gap)]  # noqa: B905
        x[j[k]] = [p + g * q for p, q in zip(b, gap)]  # noqa: B905


def matchings(n: int, cut: int, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A random order of pairs between and within two blocks, places up to ``cut`` and from there up to ``n``, and where its runs begin: the pairs of a run share no vertex.

    Of vertices numbered at random in their block, those of pairs whose numbers have the same sum modulo the larger block differ. Pairs with the same ends follow each other in i and j."""
    place, wide = np.concatenate([rng.permutation(cut), rng.permutation(n - cut)]), max(cut, n - cut, 1)
    run = ((i < cut) != (j < cut)) * wide + (place[i] + place[j]) % wide
    lo, hi, at = np.minimum(i, j), np.maximum(i, j), np.arange(len(i))
    fresh = np.ones(len(i), bool)
    fresh[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    turn = rng.permutation(2 * wide * (int(again.max(initial=0)) + 1))[run + again * 2 * wide]
    order = np.argsort(turn.astype(np.uint16) if turn.max(initial=0) < 1 << 16 else turn, kind="stable")
    return order, np.flatnonzero(np.diff(turn[order], prepend=-1))


def sgd_runs(x: np.ndarray, order: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, mi: np.ndarray, mj: np.ndarray, rng: np.random.Generator) -> None:
    """``sgd_pass`` over an order in runs that share no vertex: a run is one step of arrays, as none of its pairs moves another's ends."""
    i, j, t, mi, mj = (c[order] for c in (i, j, t, mi, mj))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        a, b, target = i[lo:hi], j[lo:hi], t[lo:hi]
        gap = x[a] - x[b]
        d = np.sqrt(np.einsum("kc,kc->k", gap, gap))
        move = (d - target) / 2
        if not d.all():
            met = np.flatnonzero(d == 0.0)
            gap[met] = rng.normal(size=(len(met), x.shape[1]))
            d[met], move[met] = np.sqrt((gap[met] ** 2).sum(axis=1)), -target[met] / 2
        gap *= (move / d)[:, None]
        x[a] -= mi[lo:hi, None] * gap
        x[b] += mj[lo:hi, None] * gap


def sgd_epoch(x: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, wi: np.ndarray, wj: np.ndarray, rate: float, rng: np.random.Generator | None) -> None:
    """One pass over all pairs in random order (as they come without a generator) with steps min(rate * w, 1)."""
    order = range(len(i)) if rng is None else rng.permutation(len(i)).tolist()
    rows = x.tolist()
    sgd_pass(rows, order, i.tolist(), j.tolist(), t.tolist(), np.minimum(rate * wi, 1.0).tolist(), np.minimum(rate * wj, 1.0).tolist(), rng or np.random.default_rng(0))
    x[:] = rows


@dataclass
class SgdControl:
    epochs: int = 30
    schedule: str = "zheng"
    eps: float = 0.1
    start: float = 1.0
    final: float = 0.01
    stop: bool = False
    min_epochs: int = 10
    patience: int = 5
    change_tol: float = 1e-6
    motion_tol: float = 1e-5

    def rate(self, e: int, lo: float, hi: float) -> float:
        """The rate of epoch ``e`` (from 0) for weights from ``lo`` to ``hi``."""
        last = max(1, self.epochs - 1)
        if self.schedule == "hybrid":
            tau, ten = int(0.4 * self.epochs), self.start / 10
            return self.start * 10 ** (-e / max(1, tau)) if e < tau else ten / (1 + (e - tau) / max(1, last - tau) * (ten / self.final - 1))
        a, b = (1 / lo, self.eps / hi) if self.schedule == "zheng" else (self.start, self.final)
        return a * (b / a) ** (e / last)


@dataclass
class SgdState:
    coords: np.ndarray
    epoch: int
    rng: dict
    best: np.ndarray
    best_loss: float
    trace: list = field(default_factory=list)
    stable: int = 0

    def dump(self) -> str:
        body = json.dumps({"coords": self.coords.tolist(), "epoch": self.epoch, "rng": self.rng, "best": self.best.tolist(), "best_loss": self.best_loss, "trace": self.trace, "stable": self.stable})
        return json.dumps({"version": 1, "sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @classmethod
    def load(cls, text: str) -> SgdState:
        x = json.loads(text)
        if x["version"] != 1 or hashlib.sha256(x["body"].encode()).hexdigest() != x["sha256"]:
            raise ValueError("the saved state is of another version or has been changed")
        b = json.loads(x["body"])
        return cls(np.array(b["coords"]), b["epoch"], b["rng"], np.array(b["best"]), b["best_loss"], b["trace"], b["stable"])


def _profiled(x, i, j, t, w) -> tuple[float, float]:
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
    raw, dd, dt, tt = (w * (d - t) ** 2).sum(), (w * d * d).sum(), (w * d * t).sum(), (w * t * t).sum()
    return float(raw), float(tt - dt * dt / dd) if dd > 0 else float(tt)


def sgd_kernel(n: int, i, j, t, wi, wj, dim: int, control: SgdControl, seed: int = 1, start: np.ndarray | None = None, state: SgdState | None = None, upto: int | None = None) -> tuple[SgdState, str]:
    """Runs epochs from a start or a saved state; an interrupted run that is resumed gives what an uninterrupted one gives."""
    rng = np.random.default_rng(seed)
    w = (wi + wj) / 2
    if state is None:
        x = rng.random((n, dim)) if start is None else np.array(start, dtype=float)
        state = SgdState(x, 0, rng.bit_generator.state, x.copy(), _profiled(x, i, j, t, w)[1])
    else:
        rng.bit_generator.state = state.rng
        x = state.coords.copy()
    pos = np.concatenate([wi[wi > 0], wj[wj > 0]])
    lo, hi = (float(pos.min()), float(pos.max())) if len(pos) else (1.0, 1.0)
    end, why = min(control.epochs, upto or control.epochs), "iteration_limit"
    for e in range(state.epoch, end):
        rate = control.rate(e, lo, hi)
        before = x.copy()
        sgd_epoch(x, i, j, t, wi, wj, rate, rng)
        raw, loss = _profiled(x, i, j, t, w)
        move = x - before
        motion = float(np.sqrt(((move - move.mean(axis=0)) ** 2).sum(axis=1).mean()))
        last = state.trace[-1]["profiled_stress"] if state.trace else loss
        change = abs(last - loss) / max(1.0, abs(last))
        if loss < state.best_loss:
            state.best, state.best_loss = x.copy(), loss
        state.stable = state.stable + 1 if change <= control.change_tol and motion <= control.motion_tol else 0
        state.trace.append({"epoch": e + 1, "raw_stress": raw, "profiled_stress": loss, "pair_updates": float((e + 1) * len(i)), "learning_rate": rate, "relative_change": change, "centered_motion": motion, "stable_checkpoints": state.stable})
        state.coords, state.epoch, state.rng = x.copy(), e + 1, rng.bit_generator.state
        if control.stop and e + 1 >= control.min_epochs and state.stable >= control.patience:
            why = "practical_stabilization"
            break
    return state, why


def sgd(pairs: DataFrame, starts: int = 1, dim: int = 2, control: SgdControl | None = None, seed: int = 1) -> DataFrame:
    """start, v, x of a constraint table (i, j, target, count_i, count_j) or pair table (i, j, d); one kernel per start."""
    control = control or SgdControl()
    full = "d" in pairs.columns
    p = pairs.select("i", "j", F.col("d").alias("t"), F.lit(1.0).alias("ci"), F.lit(1.0).alias("cj")) if full else pairs.select("i", "j", F.col("target").alias("t"), F.col("count_i").alias("ci"), F.col("count_j").alias("cj"))
    if p.count() > MAX_KERNEL_PAIRS:
        raise ValueError("too many pairs for the sequential kernel; use smacof, or fewer constraints")
    each = p.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        ids = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        i, j, t = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"]), pdf["t"].to_numpy(float)
        k = int(pdf["start"].iloc[0])
        st, _ = sgd_kernel(len(ids), i, j, t, pdf["ci"].to_numpy(float) / t**2, pdf["cj"].to_numpy(float) / t**2, dim, control, seed + k - 1)
        x = st.best if full else st.coords
        return pd.DataFrame({"start": k, "v": ids, "x": list(x)})

    return each.groupBy("start").applyInPandas(run, "start int, v bigint, x array<double>")


def _as_constraints(pairs: DataFrame) -> DataFrame:
    """i, j, t, wi, wj of a constraint table (i, j, target, count_i, count_j) or pair table (i, j, d)."""
    if "d" in pairs.columns:
        return pairs.select("i", "j", F.col("d").cast("double").alias("t"), F.lit(1.0).alias("wi"), F.lit(1.0).alias("wj"))
    w = lambda c: (F.col(c) / (F.col("target") * F.col("target"))).alias(f"w{c[-1]}")
    return pairs.select("i", "j", F.col("target").alias("t"), w("count_i"), w("count_j"))


def tournament_round(lo: Column, hi: Column, blocks: int) -> Column:
    """The round, of ``blocks`` - 1, in which two of an even number of blocks meet; no block meets two others in one round."""
    m = blocks - 1
    return F.when(hi == m, lo).otherwise(F.pmod((lo + hi) * ((m + 1) // 2), F.lit(m))).cast("int")


def _partner(b: Column, r: int, blocks: int) -> Column:
    m = blocks - 1
    return F.when(b == m, F.lit(r)).when(b == r, F.lit(m)).otherwise(F.pmod(F.lit(2 * r) - b, F.lit(m))).cast("int")


def strata(constraints: DataFrame, blocks: int, seed: int = 1) -> DataFrame:
    """round, lo, hi, body: the pairs between each two blocks, and those within a block where it first meets another. Every meeting has a row, with or without pairs."""
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    x = constraints.withColumn("bi", block("i")).withColumn("bj", block("j"))
    x = x.withColumn("bj", F.when(F.col("bi") == F.col("bj"), _partner(F.col("bi"), 0, blocks)).otherwise(F.col("bj")))
    x = x.select("i", "j", "t", "wi", "wj", F.least("bi", "bj").alias("lo"), F.greatest("bi", "bj").alias("hi"))
    b = x.sparkSession.range(blocks * blocks).select((F.col("id") / blocks).cast("int").alias("lo"), (F.col("id") % blocks).cast("int").alias("hi")).where("lo < hi")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset="i")
        pdf = pdf.assign(least=pdf[["i", "j"]].min(axis=1), most=pdf[["i", "j"]].max(axis=1)).sort_values(["least", "most", "i", "t", "wi", "wj"])  # pairs with the same ends lie together
        cols = [pdf["i"].to_numpy("<i8"), pdf["j"].to_numpy("<i8"), *(pdf[c].to_numpy("<f8") for c in ("t", "wi", "wj"))]
        return pd.DataFrame({"body": [b"".join(c.tobytes() for c in cols)]})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack(pdf).assign(lo=key[0], hi=key[1])[["lo", "hi", "body"]]

    rows = b.join(x, ["lo", "hi"], "left").groupBy("lo", "hi").applyInPandas(run, "lo int, hi int, body binary")
    return materialize(rows.withColumn("round", tournament_round(F.col("lo"), F.col("hi"), blocks)), "strata", by="round")


def _held(state: pd.DataFrame, body: bytes, dim: int):
    """Vertex ids and coordinates of two blocks, and the places, targets and weights of the pairs between them."""
    ids, n = [np.frombuffer(q, "<i8") for q in state["ids"]], len(body) // 40
    at = np.concatenate(ids)
    order = np.argsort(at, kind="stable")
    pair, own = np.frombuffer(body, "<i8", 2 * n).reshape(2, n), np.frombuffer(body, "<f8", 3 * n, 16 * n).reshape(3, n)
    return len(ids[0]), np.concatenate([np.frombuffer(q) for q in state["xs"]]).reshape(-1, dim), order[np.searchsorted(at, pair, sorter=order)], own


def _meet(dim: int, rate: float, seed: int):
    def run(state: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        """The pairs of one meeting, in an order drawn for it, over the coordinates of its two blocks: many pairs by matchings, few one after another."""
        r = pairs.iloc[0]
        cut, x, (i, j), own = _held(state, r["body"], dim)
        rng, steps = np.random.default_rng([seed, int(r["lo"]), int(r["hi"])]), np.minimum(rate * own[1:], 1.0)
        if len(i) >= RUN_PAIRS * max(cut, len(x) - cut):
            sgd_runs(x, *matchings(len(x), cut, i, j, rng), i, j, own[0], *steps, rng)
        else:
            x = x.tolist()
            sgd_pass(x, rng.permutation(len(i)).tolist(), i.tolist(), j.tolist(), own[0].tolist(), *steps.tolist(), rng)
            x = np.array(x).reshape(-1, dim)
        return state.assign(xs=[x[:cut].tobytes(), x[cut:].tobytes()])[["b", "ids", "xs"]]

    return run


def drawn_start(vertices: DataFrame, dim: int, seed: int = 1) -> DataFrame:
    """v, x: coordinates from 0 to 1 by hash."""
    return vertices.select("v", F.array(*(F.pmod(F.xxhash64("v", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) for k in range(dim))).alias("x"))


def _unpacked(state: DataFrame, dim: int) -> DataFrame:
    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if len(r.ids):  # a block may have no vertices
                    yield pd.DataFrame({"v": np.frombuffer(r.ids, "<i8"), "x": list(np.frombuffer(r.xs).reshape(-1, dim))})

    return state.mapInPandas(run, "v bigint, x array<double>")


def sgd_tables(pairs: DataFrame, dim: int = 2, control: SgdControl | None = None, seed: int = 1, start: DataFrame | None = None, blocks: int | None = None, traced: bool | None = None) -> tuple[DataFrame, list[dict], str]:
    """v, x after SGD over a constraint or pair table; a row for each traced epoch; and why it ended. Traced runs (pair tables unless said otherwise) return the coordinates of least profiled stress.

    Vertices are dealt to an even number of blocks, at least four, of at most ``BLOCK_VERTICES`` vertices and so many that a meeting has some ``BLOCK_PAIRS`` pairs; a job takes up to ``ROUNDS_A_JOB`` rounds, of one epoch or more.
    """
    control, full = control or SgdControl(), "d" in pairs.columns
    traced = full or control.stop if traced is None else traced
    c = materialize(_as_constraints(pairs), "constraints")
    if not c.where("t is null or t < 0 or wi < 0 or wj < 0 or i = j").isEmpty():
        raise ValueError("targets and weights are at least 0, and the ends of a pair differ")
    v = materialize(c.select(F.explode(F.array("i", "j")).alias("v")).distinct(), "vertices")
    ends = F.array("wi", "wj")
    low = c.select(F.explode(ends).alias("w")).where("w > 0").agg(F.min("w"), F.max("w")).first()
    lo, hi = (float(low[0]), float(low[1])) if low[0] is not None else (1.0, 1.0)
    blocks = blocks or max(4, 2 * math.ceil(max(v.count() / BLOCK_VERTICES, math.sqrt(2 * c.count() / BLOCK_PAIRS)) / 2))
    if blocks < 2 or blocks % 2:
        raise ValueError("the number of blocks is even")
    table = strata(c, blocks, seed)
    x = start if start is not None else drawn_start(v, dim, seed)
    every = v.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset="v").sort_values("v")
        return pd.DataFrame({"b": [key[0]], "ids": [pdf["v"].to_numpy("<i8").tobytes()], "xs": [np.array(pdf["x"].tolist(), dtype="<f8").tobytes()]})

    x = v.join(x, "v").withColumn("b", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(blocks)).cast("int"))
    state = materialize(every.join(x, "b", "left").groupBy("b").applyInPandas(pack, "b int, ids binary, xs binary"), "blocks")
    trace, best, stable, why = [], None, 0, "iteration_limit"
    stored, waiting = state, 0
    for e in range(control.epochs):
        before, rate = stored, control.rate(e, lo, hi)
        for r in range(blocks - 1):
            met = state.withColumn("lo", F.least("b", _partner(F.col("b"), r, blocks)))  # two rows a meeting
            dealt = [q.repartition(2 * blocks, "lo").groupBy("lo") for q in (met, table.where(F.col("round") == r).drop("round"))]  # meetings run side by side: they are not merged into few tasks
            state = dealt[0].cogroup(dealt[1]).applyInPandas(_meet(dim, rate, seed * 1_000_003 + e), "b int, ids binary, xs binary")
            waiting += 1
            if waiting >= ROUNDS_A_JOB or r == blocks - 2 and (traced or e == control.epochs - 1):
                state, old, waiting = materialize(state, "blocks"), stored, 0
                stored = state
                if old is not before and (best is None or old is not best[1]):
                    discard(old)
        if traced:
            row = _traced(table, state, before, dim)
            last = trace[-1]["profiled_stress"] if trace else row["profiled_stress"]
            change = abs(last - row["profiled_stress"]) / max(1.0, abs(last))
            stable = stable + 1 if change <= control.change_tol and row["centered_motion"] <= control.motion_tol else 0
            trace.append({"epoch": e + 1, **row, "learning_rate": rate, "relative_change": change, "stable_checkpoints": stable})
            if best is None or row["profiled_stress"] < best[0]:
                best = (row["profiled_stress"], state)
            if control.stop and e + 1 >= control.min_epochs and stable >= control.patience:
                why = "practical_stabilization"
                break
        if before is not stored and (best is None or before is not best[1]):
            discard(before)
    out = materialize(_unpacked(best[1] if full and best else state, dim), "coordinates")
    discard(state, c, table)
    return out, trace, why


def _traced(table: DataFrame, state: DataFrame, before: DataFrame, dim: int) -> dict:
    """Raw and profiled stress, summed meeting by meeting, and the centred motion since ``before``."""
    a, b = (state.select(F.col("b").alias(n), F.col("ids").alias(f"ids_{n}"), F.col("xs").alias(f"xs_{n}")) for n in ("lo", "hi"))

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                held = pd.DataFrame({"ids": [r.ids_lo, r.ids_hi], "xs": [r.xs_lo, r.xs_hi]})
                _, x, (i, j), (t, wi, wj) = _held(held, r.body, dim)
                o, w = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)), (wi + wj) / 2
                yield pd.DataFrame({"raw": [(w * (o - t) ** 2).sum()], "oo": [(w * o * o).sum()], "ot": [(w * o * t).sum()], "tt": [(w * t * t).sum()]})

    def moved(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                d = (np.frombuffer(r.xs) - np.frombuffer(r.old)).reshape(-1, dim)
                yield pd.DataFrame({"raw": np.zeros(dim), "oo": (d * d).sum(axis=0), "ot": d.sum(axis=0), "tt": float(len(d)), "axis": np.arange(dim)})

    sums = table.join(a, "lo").join(b, "hi").select("ids_lo", "xs_lo", "ids_hi", "xs_hi", "body").mapInPandas(run, "raw double, oo double, ot double, tt double").withColumn("axis", F.lit(-1))
    steps = state.join(before.select("b", F.col("xs").alias("old")), "b").mapInPandas(moved, "raw double, oo double, ot double, tt double, axis int")
    got = {r["axis"]: r for r in sums.unionByName(steps).groupBy("axis").agg(*(F.sum(c).alias(c) for c in ("raw", "oo", "ot", "tt"))).collect()}
    s = got.pop(-1)
    motion = math.sqrt(sum(max(0.0, r.oo - r.ot * r.ot / r.tt) / r.tt for r in got.values() if r.tt))
    return {"raw_stress": s.raw, "profiled_stress": s.tt - s.ot * s.ot / s.oo if s.oo else s.tt, "centered_motion": motion}


def multistart(pairs: DataFrame, seeds: list[int], dim: int = 2, control: SgdControl | None = None) -> tuple[DataFrame, DataFrame]:
    """The coordinates of the start with the least profiled stress, and start, seed, status, message, profiled_stress of every start; a start that fails is a row, not the end."""
    rows, best = [], None
    for k, seed in enumerate(seeds, 1):
        try:
            coords, trace, why = sgd_tables(pairs, dim, control, seed, traced=True)
            loss = min(r["profiled_stress"] for r in trace)
            if not math.isfinite(loss):
                raise ArithmeticError("the stress is not finite")
            rows.append((k, seed, why, None, loss))
            if best is None or loss < best[0]:
                best = (loss, coords)
        except (ValueError, ArithmeticError) as err:
            rows.append((k, seed, "failed", str(err), None))
    if best is None:
        raise RuntimeError("every start has failed: " + "; ".join(sorted({str(r[3]) for r in rows})))
    return best[1], pairs.sparkSession.createDataFrame(rows, "start int, seed int, status string, message string, profiled_stress double")


FRAME = "frame int, epoch int, update_in_epoch bigint, pair_updates bigint, v bigint, x array<double>"


def trace_bytes(vertices: int, dim: int, pairs: int, epochs: int, every: int) -> int:
    """What the frames of an update trace take: coordinates and 512 bytes each, one at the start and one after every ``every`` updates and at the end of each epoch."""
    if every < 1 or every != int(every):
        raise ValueError("frames are a whole number of updates apart")
    return (-(-pairs // every) * epochs + 1) * (8 * vertices * dim + 512)


def update_trace(pairs: DataFrame, every: int, max_bytes: int, dim: int = 2, control: SgdControl | None = None, seed: int = 1) -> DataFrame:
    """frame, epoch, update_in_epoch, pair_updates, v, x: coordinates while pairs are visited one after another. The budget bounds what the run holds and is checked before it starts,
    so it is one task's kernel, which hands on each frame as soon as it is there; ``sgd_tables`` has the traces of epochs for tables of any size."""
    control, c = control or SgdControl(), materialize(_as_constraints(pairs), "constraints")
    n, m = c.select(F.explode(F.array("i", "j"))).distinct().count(), c.count()
    need = max(trace_bytes(n, dim, m, control.epochs, every), 40 * m)
    if not max_bytes > 0 or need > max_bytes:
        raise ValueError(f"the trace takes {need} bytes, more than the {max_bytes} that are allowed; take more updates between frames")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := [pdf for pdf in parts if len(pdf)]):
            return
        pdf = pd.concat(held).sort_values(["i", "j"])
        ids, at = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        i, j = at[: len(pdf)], at[len(pdf) :]
        t, wi, wj = (pdf[k].to_numpy(float) for k in ("t", "wi", "wj"))
        rng, frame = np.random.default_rng(seed), 0
        x, w = rng.random((len(ids), dim)).tolist(), np.concatenate([wi[wi > 0], wj[wj > 0]])

        def shown(epoch: int, within: int) -> pd.DataFrame:
            total = max(epoch - 1, 0) * len(i) + within
            return pd.DataFrame({"frame": frame, "epoch": epoch, "update_in_epoch": within, "pair_updates": total, "v": ids, "x": [list(r) for r in x]})

        yield shown(0, 0)
        for e in range(control.epochs):
            rate = control.rate(e, float(w.min()), float(w.max()))
            order, sizes = rng.permutation(len(i)), (np.minimum(rate * wi, 1.0), np.minimum(rate * wj, 1.0))
            for done in range(0, len(order), every):
                part = order[done : done + every]
                sgd_pass(x, range(len(part)), *(k[part].tolist() for k in (i, j, t, *sizes)), rng)
                frame += 1
                yield shown(e + 1, done + len(part))

    return c.coalesce(1).mapInPandas(run, FRAME)


def smacof_step(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    """One Guttman transform for unit weights over all pairs (i, j, d): x_i becomes the sum over j of d / o (x_i - x_j), by n."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"x{c}")) for c in ("i", "j"))
    p = pairs.join(a, "i").join(b, "j").withColumn("o", V.euclid("xi", "xj"))
    f = F.when(F.col("o") > 0, F.col("d") / F.col("o")).otherwise(F.lit(0.0))
    both = p.select(f.alias("f"), F.explode(F.array(F.struct(F.col("i").alias("v"), V.minus("xi", "xj").alias("g")), F.struct(F.col("j").alias("v"), V.minus("xj", "xi").alias("g")))).alias("e"))
    n = coords.agg(F.count(F.lit(1)).alias("n"))
    s = both.select("e.v", "f", F.posexplode("e.g").alias("k", "g")).groupBy("v", "k").agg(F.sum(F.col("f") * F.col("g")).alias("s"))
    s = s.crossJoin(F.broadcast(n)).withColumn("s", F.col("s") / F.col("n"))  # one row
    return s.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda q: q["s"]).alias("x"))


def smacof(pairs: DataFrame, coords: DataFrame, iterations: int = 20, tol: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """Coordinates and the raw stress before each step; it never rises."""
    trace: list[float] = []
    for _ in range(iterations):
        trace.append(float(objectives.stress(pairs, coords).first().raw))
        if len(trace) > 1 and trace[-2] - trace[-1] <= tol * max(1.0, trace[-2]):
            break
        coords = materialize(smacof_step(pairs, coords), "smacof")
    return coords, trace


def fit_summary(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    """raw_stress, target_normalized_rmse, stress1_identity, stress1_profiled."""
    x = objectives.observed(pairs, coords)
    s = x.agg(F.sum(F.pow(F.col("o") - F.col("d"), 2)).alias("raw_stress"), F.sum(F.col("o") * F.col("d")).alias("od"), F.sum(F.col("o") ** 2).alias("oo"), F.sum(F.col("d") ** 2).alias("dd"))
    best = F.greatest(F.lit(0.0), F.col("dd") - F.col("od") ** 2 / F.col("oo"))
    return s.select("raw_stress", F.sqrt(best / F.col("dd")).alias("target_normalized_rmse"), F.sqrt(F.col("raw_stress") / F.col("oo")).alias("stress1_identity"), F.sqrt(F.greatest(F.lit(0.0), F.col("oo") - F.col("od") ** 2 / F.col("dd")) / F.col("oo")).alias("stress1_profiled"))


def double_centred(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """r, c, b: -1/2 of the squared distances with row and column means taken off, for all ordered pairs."""
    sq = F.col("d") * F.col("d")
    full = pairs.select(F.col("i").alias("r"), F.col("j").alias("c"), sq.alias("s")).union(pairs.select("j", "i", sq)).union(vertices.select("v", "v", F.lit(0.0)))
    m = full.groupBy("r").agg(F.avg("s").alias("m"))
    g = m.agg(F.avg("m").alias("g"))
    return full.join(m, "r").join(m.select(F.col("r").alias("c"), F.col("m").alias("mc")), "c").crossJoin(F.broadcast(g)).select("r", "c", (-0.5 * (F.col("s") - F.col("m") - F.col("mc") + F.col("g"))).alias("b"))  # one row


def double_centred_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same of the distances in a connected graph that a task can hold: means come first, one a vertex, and the rows are made once more with them, so none is stored or shuffled."""
    mean = materialize(all_rows(edges, vertices, lambda ids, at, d, _: {"v": ids[at], "m": np.einsum("ij,ij->i", d, d) / len(ids)}, "v bigint, m double"), "means")

    def fold(ids, at, d, values):
        m = values[1][0]
        b = -0.5 * (d * d - m[at][:, None] - m[None, :] + m.mean())
        return {"r": np.repeat(ids[at], len(ids)), "c": np.tile(ids, len(at)), "b": b.ravel()}

    return all_rows(edges, vertices, fold, "r bigint, c bigint, b double", values=packed_values(mean, "m"))


def smacof_step_of(edges: DataFrame, vertices: DataFrame, coords: DataFrame, dim: int = 2) -> DataFrame:
    """``smacof_step`` between the vertices that have coordinates, with the distances in a connected graph that a task can hold; a task keeps a row for each of its vertices."""
    columns = [f"x{k}" for k in range(dim)]

    def fold(ids, at, d, values):
        placed = np.isin(ids[at], values[0])
        own, there, d = np.searchsorted(values[0], ids[at][placed]), np.searchsorted(ids, values[0]), d[placed]
        d = d[:, there]
        gap = [x[own][:, None] - x[None, :] for x in values[1]]
        o = np.sqrt(sum(g * g for g in gap))
        f = np.divide(d, o, out=np.zeros_like(d), where=o > 0)
        return {"v": ids[at][placed]} | {c: np.einsum("ij,ij->i", f, g) / len(there) for c, g in zip(columns, gap, strict=True)}

    values = packed_values(coords.select("v", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate(columns))), *columns)
    rows = all_rows(edges, vertices, fold, "v bigint, " + ", ".join(f"{c} double" for c in columns), values=values)
    return rows.select("v", F.array(*columns).alias("x"))


def classical(pairs: DataFrame, vertices: DataFrame, dim: int = 2, iterations: int = 1000, seed: int = 1, driver_limit: int = 3000) -> tuple[DataFrame, list[float]]:
    """Classical MDS: coordinates and the eigenvalues. Up to ``driver_limit`` vertices the centred matrix goes to one kernel; beyond, block power iteration
    over tiles of ``TILE_ROWS`` squared, each distance stored once, until the coordinates settle: Ritz values keep their signs, the matrix is shifted by the most negative one, and eigenvalues below 0 give coordinates 0, as in the kernel."""
    spark, n = vertices.sparkSession, vertices.count()
    if n <= driver_limit:
        rows = double_centred(pairs, vertices).toPandas()
        ids = np.unique(rows["r"])
        m = np.zeros((n, n))
        m[np.searchsorted(ids, rows["r"]), np.searchsorted(ids, rows["c"])] = rows["b"]
        val, vec = np.linalg.eigh(m)
        val, vec = val[::-1][:dim], vec[:, ::-1][:, :dim]
        x = np.zeros((n, dim))
        x[:, : len(val)] = vec * np.sqrt(np.maximum(val, 0))
        return spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "v bigint, x array<double>"), val.tolist()
    blocks = -(-n // TILE_ROWS)
    held = _dealt(vertices.select("v", F.array().cast("array<double>").alias("x")), blocks)
    return _power(held, _stored(pairs, held, blocks), n, dim, iterations, seed)


def classical_of(points: DataFrame, dim: int = 2, iterations: int = 1000, seed: int = 1, driver_limit: int = 3000) -> tuple[DataFrame, list[float]]:
    """Classical MDS of the Euclidean distances between points (v, x). Beyond ``driver_limit`` tasks form the distances of two blocks of points anew in each step, so no table of all pairs is stored or shuffled."""
    n = points.count()
    if n <= driver_limit:
        a, b = (points.select(F.col("v").alias(c), F.col("x").alias(f"x{c}")) for c in ("i", "j"))
        pairs = a.join(b, F.col("i") < F.col("j")).select("i", "j", V.euclid("xi", "xj").alias("d"))
        return classical(pairs, points.select("v"), dim, iterations, seed, driver_limit)
    blocks = max(TILE_BLOCKS, -(-n // POINT_ROWS))
    return _power(_dealt(points, blocks), _meetings(points.sparkSession, blocks), n, dim, iterations, seed)


def _dealt(points: DataFrame, blocks: int) -> DataFrame:
    """b, ids, xs: points (v, x) dealt to blocks by hash, in the order of their ids."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pd.DataFrame({"b": [key[0]], "ids": [pdf["v"].to_numpy("<i8").tobytes()], "xs": [np.array(pdf["x"].tolist(), dtype="<f8").tobytes()]})

    return materialize(points.withColumn("b", _block_of("v", blocks)).groupBy("b").applyInPandas(pack, "b int, ids binary, xs binary"), "dealt")


def _block_of(c: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _meetings(spark: SparkSession, blocks: int) -> DataFrame:
    """b, c: each two blocks once, and each with itself."""
    return spark.range(blocks * blocks).select((F.col("id") / blocks).cast("int").alias("b"), (F.col("id") % blocks).cast("int").alias("c")).where("b <= c")


def _stored(pairs: DataFrame, held: DataFrame, blocks: int) -> DataFrame:
    """b, c, body: the squared distances between the vertices of two blocks. Pairs are shuffled once."""
    p = pairs.select("i", "j", "d", _block_of("i", blocks).alias("bi"), _block_of("j", blocks).alias("bj")).withColumns({"b": F.least("bi", "bj"), "c": F.greatest("bi", "bj")})
    p = p.select("b", "c", F.when(F.col("bi") <= F.col("bj"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("bi") <= F.col("bj"), F.col("j")).otherwise(F.col("i")).alias("j"), F.col("d").cast("double").alias("d"))
    own = _meetings(pairs.sparkSession, blocks).join(held.select("b", "ids"), "b").join(held.select(F.col("b").alias("c"), F.col("ids").alias("ids2")), "c").select("b", "c", "ids", "ids2")

    def run(own: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        rows, columns = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["ids2"], "<i8")
        sq, i, j = np.full((len(rows), len(columns)), np.nan), np.searchsorted(rows, p["i"]), np.searchsorted(columns, p["j"])
        sq[i, j] = p["d"].to_numpy() ** 2
        if r["b"] == r["c"]:
            sq[j, i] = sq[i, j]
            np.fill_diagonal(sq, 0.0)
        if np.isnan(sq).any():
            raise ValueError("classical MDS takes a distance for every pair of vertices")
        return pd.DataFrame({"b": [r["b"]], "c": [r["c"]], "body": [sq.tobytes()]})

    return materialize(own.groupBy("b", "c").cogroup(p.groupBy("b", "c")).applyInPandas(run, "b int, c int, body binary"), "tiles")


def _product(state: DataFrame, tiles: DataFrame, g: float, k: int) -> DataFrame:
    """b, z: the centred matrix times the columns y of the state (b, ids, xs, m, y), tile by tile. Tiles have a body or follow from the points of their blocks."""
    stored = "body" in tiles.columns
    near = F.broadcast if stored else (lambda df: df)  # bodies stay where they are; without them tiles are a few numbers
    columns = ["xs", "m", "y"]
    a, b = state.select("b", *columns), state.select(F.col("b").alias("c"), *(F.col(q).alias(f"{q}2") for q in columns))
    rows = tiles.join(near(a), "b").join(near(b), "c")
    if not stored:
        rows = rows.repartition(max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles.count(), 1024)), "b", "c")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                m, m2, y, y2 = np.frombuffer(r.m), np.frombuffer(r.m2), np.frombuffer(r.y).reshape(-1, k), np.frombuffer(r.y2).reshape(-1, k)
                x, x2 = (np.frombuffer(q).reshape(len(w), -1).T for q, w in ((r.xs, m), (r.xs2, m2)))
                z, z2 = np.empty_like(y), np.zeros_like(y2)
                for lo in range(0, len(m), TILE_STEP):
                    own = slice(lo, lo + TILE_STEP)
                    if stored:
                        t = np.frombuffer(r.body).reshape(len(m), len(m2))[own].copy()
                    else:
                        t = np.zeros((len(m[own]), len(m2)))
                        for p, q in zip(x, x2, strict=True):
                            d = np.subtract.outer(p[own], q)
                            t += np.multiply(d, d, out=d)
                    t -= m[own, None]
                    t -= m2 - g
                    t *= -0.5
                    z[own] = t @ y2
                    if r.b != r.c:
                        z2 += t.T @ y[own]
                ends = [(r.b, z)] if r.b == r.c else [(r.b, z), (r.c, z2)]
                yield pd.DataFrame({"b": [q for q, _ in ends], "z": [q.tobytes() for _, q in ends]})

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [key[0]], "z": [sum(np.frombuffer(q) for q in pdf["z"]).tobytes()]})

    return rows.mapInPandas(run, "b int, z binary").groupBy("b").applyInPandas(total, "b int, z binary")


def _power(held: DataFrame, tiles: DataFrame, n: int, dim: int, iterations: int, seed: int) -> tuple[DataFrame, list[float]]:
    """Shifted block power iteration over tiles of squared distances until the coordinates settle; only k x k numbers come to the driver."""
    state_type = "b int, ids binary, xs binary, m binary, y binary"

    def each(df: DataFrame, what) -> DataFrame:
        """Blocks with new columns: ``what`` of a row gives its m and y."""
        def run(parts):
            for pdf in parts:
                got = [what(r) for r in pdf.itertuples(index=False)]
                yield pdf[["b", "ids", "xs"]].assign(m=[m.tobytes() for m, _ in got], y=[y.tobytes() for _, y in got])

        return df.mapInPandas(run, state_type)

    def sums(df: DataFrame, what, width: int) -> np.ndarray:
        """The sum over blocks of ``width`` numbers of a row."""
        def run(parts):
            for pdf in parts:
                for r in pdf.itertuples(index=False):
                    yield pd.DataFrame({"at": np.arange(width), "s": np.ravel(what(r))})

        rows = df.mapInPandas(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        return np.array([r.s for r in sorted(rows, key=lambda r: r["at"])])

    def beside(r, k: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(q).reshape(-1, k) for q in (r.y, r.z)], axis=1)

    def orthonormal(g: np.ndarray) -> np.ndarray:
        """What makes columns with these inner products orthonormal; dependent ones go."""
        val, vec = np.linalg.eigh(g)
        keep = val > 1e-12 * max(val[-1], 0.0)
        return vec[:, keep] / np.sqrt(val[keep])

    size = lambda r: len(r.ids) // 8
    flat = each(held, lambda r: (np.zeros(size(r)), np.ones(size(r))))
    rows = materialize(held.join(_product(flat, tiles, 0.0, 1), "b"), "means")
    g, k = float(sums(rows, lambda r: -2 / n * np.frombuffer(r.z).sum(), 1)[0]) / n, min(n, dim + 4)
    state = each(rows, lambda r: (-2 / n * np.frombuffer(r.z), np.random.default_rng([seed, r.b]).random((size(r), k)) - 0.5))
    by = orthonormal(sums(state, lambda r: np.frombuffer(r.y).reshape(-1, k).T @ np.frombuffer(r.y).reshape(-1, k), k * k).reshape(k, k))
    state = materialize(each(state, lambda r: (np.frombuffer(r.m), np.frombuffer(r.y).reshape(-1, k) @ by)), "power")
    for _ in range(iterations):
        both = materialize(state.join(_product(state, tiles, g, k), "b"), "power")
        m = sums(both, lambda r, k=k: beside(r, k).T @ beside(r, k), 4 * k * k).reshape(2 * k, 2 * k)
        val, vec = np.linalg.eigh((m[:k, k:] + m[k:, :k]) / 2)
        val, vec = val[::-1], vec[:, ::-1]
        left = np.sqrt(np.maximum(0.0, np.einsum("ac,ab,bc->c", vec, m[k:, k:], vec) - val**2))[:dim]
        if (left <= 1e-6 * np.abs(val).max()).all():
            val, vec = val[:dim], vec[:, :dim]
            by = np.zeros((k, dim))
            by[:, : len(val)] = vec * np.sqrt(np.maximum(val, 0))
            out = materialize(_unpacked(each(both, lambda r, k=k, by=by: (np.empty(0), np.frombuffer(r.y).reshape(-1, k) @ by)).select("ids", F.col("y").alias("xs")), dim), "coordinates")
            discard(both, state, held, rows, tiles)
            return out, val.tolist()
        shift = np.vstack([max(0.0, -val[-1]) * np.eye(k), np.eye(k)])
        by = shift @ orthonormal(shift.T @ m @ shift)
        old, state = state, materialize(each(both, lambda r, k=k, by=by: (np.frombuffer(r.m), beside(r, k) @ by)), "power")
        discard(old, both)
        k = by.shape[1]
    raise RuntimeError("classical MDS did not settle")


def retained_dimension(variances: list[float], share: float, width: int) -> int:
    """The least number of components with the share of variance; share 1 takes all that are numerically resolved."""
    v = np.array(variances)
    if share >= 1:
        return int((v > width * np.finfo(float).eps * v[0]).sum())
    return int(np.searchsorted(np.cumsum(v) / v.sum(), share - 1e-15) + 1)


def _moments(parts):
    """(n, mean, centred cross-products) of a partition's vectors, folded batch by batch."""
    n, mean, m2 = 0, None, None
    for pdf in parts:
        if len(pdf):
            x = np.array(pdf["x"].tolist(), dtype=np.float64)
            k, own = len(x), x.mean(axis=0)
            d = x - own
            if mean is None:
                n, mean, m2 = k, own, d.T @ d
            else:
                gap = own - mean
                m2 += d.T @ d + np.outer(gap, gap) * (n * k / (n + k))
                mean = mean + gap * (k / (n + k))
                n += k
    if n:
        r, c = np.indices(m2.shape)
        yield pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "n": n, "a": mean[r.ravel()], "b": mean[c.ravel()], "s": m2.ravel()})


def covariance(obs: DataFrame) -> DataFrame:
    """r, c, s: the sample covariance of the components. A task sends the moments of its rows, p x p numbers, not its rows."""
    x = obs.select(F.transform("x", lambda q: q.cast("double")).alias("x")).mapInPandas(_moments, "r int, c int, n bigint, a double, b double, s double")
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("a") * F.col("b")) - F.sum(F.col("n") * F.col("a")) * F.sum(F.col("n") * F.col("b")) / n
    return x.groupBy("r", "c").agg(((F.sum("s") + between) / (n - 1)).alias("s"))


def pca(obs: DataFrame, share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Scores on the retained components: the covariance is aggregated, its eigenvectors (p x p) come from the driver."""
    rows = covariance(obs).collect()
    p = max(r.r for r in rows) + 1
    m = np.zeros((p, p))
    for r in rows:
        m[r.r, r.c] = r.s
    val, vec = np.linalg.eigh(m)
    val, vec = val[::-1], vec[:, ::-1]
    d = retained_dimension(val.tolist(), share, p)
    mean = np.array(obs.agg(*(F.avg(F.get("x", F.lit(k))) for k in range(p))).first(), dtype=float)
    load = F.array(*(F.array(*map(F.lit, vec[:, k].tolist())) for k in range(d)))
    x = V.minus(V.as_double("x"), F.array(*map(F.lit, mean.tolist())))
    return obs.select("v", F.transform(load, lambda l: V.dot(x, l)).alias("x")), val[:d].tolist()


def rates(spark: SparkSession, control: SgdControl, w_min: float, w_max: float) -> DataFrame:
    return sgd_rates(spark, control.epochs, control.schedule, control.start, control.final, w_min, w_max, control.eps)
