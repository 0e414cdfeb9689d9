"""Comparison of layout candidates: grids of parameters, runs with captured errors, summaries, composite ranking."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.quality import cluster_separation, crossings, rank01

# The weights of the composite score; all are better when lower but the last two groups marked here.
WEIGHTS = {"sampled_stress_mean": 0.35, "edge_length_cv_mean": 0.20, "sampled_nonedge_sep_ratio_mean": 0.20, "stability_mean": 0.15, "edge_crossings_mean": 0.05, "cluster_separation_mean": 0.05}
HIGHER_BETTER = frozenset(["sampled_nonedge_sep_ratio_mean", "cluster_separation_mean"])
SCORES = ("sampled_stress", "edge_length_cv", "median_edge_length", "sampled_nonedge_sep_ratio", "edge_crossings", "cluster_separation")


def expand_search(prefix: str, base: dict, grid: dict[str, list], include_base: bool = False) -> dict[str, dict]:
    """Named candidates of all combinations; names tell the values, equal names are numbered."""
    rows = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    out: dict[str, dict] = {prefix: dict(base)} if include_base else {}
    seen = {tuple(sorted((k, str(v)) for k, v in base.items()))} if include_base else set()
    for k, r in enumerate(rows, 1):
        p = base | r
        if (key := tuple(sorted((a, str(b)) for a, b in p.items()))) in seen:
            continue
        seen.add(key)
        name = f"{prefix}.search." + ".".join(f"{a}{b:g}" if isinstance(b, (int, float)) else f"{a}{b}" for a, b in r.items())
        out[name if name not in out else f"{prefix}.{k:03d}"] = p
    return out


def expand_search_table(grid: dict[str, DataFrame], prefix: str) -> DataFrame:
    """The same as a cross join of literal tables (one column each), with names."""
    out = None
    for c, t in grid.items():
        out = t if out is None else out.crossJoin(t)  # literal tables of a few rows
    return out.select(F.concat_ws(".", F.lit(f"{prefix}.search"), *(F.concat(F.lit(c), F.col(c).cast("string")) for c in grid)).alias("candidate"), *grid)


def run_candidates(edges: DataFrame, vertices: DataFrame, candidates: dict[str, dict], seeds: list[int]) -> DataFrame:
    """candidate, seed, status, error_message, coords (array of (v, x)): one kernel per row, errors become rows."""
    from meshlark.operators.layout import LayoutParams, layout_graph

    names = list(candidates)
    if len(set(names)) != len(names):
        raise ValueError("candidate names repeat")
    runs = [(c, s) for c in names for s in seeds]
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w")).withColumn("kind", F.lit(0))
    rows = e.union(vertices.select("v", F.lit(0).cast("bigint"), F.lit(0.0), F.lit(1))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, s = runs[int(pdf["run"].iloc[0])]
        ids = pdf.loc[pdf["kind"] == 1, "src"].sort_values().to_numpy()
        e = pdf.loc[pdf["kind"] == 0].sort_values(["src", "dst"])
        try:
            x = layout_graph(ids, e[["src", "dst"]].to_numpy(), e["w"].to_numpy(), LayoutParams.of(**(candidates[c] | {"seed": s})))
            return pd.DataFrame({"candidate": c, "seed": s, "status": "ok", "error_message": None, "v": ids, "x": list(x)})
        except Exception as error:  # one failing candidate is a row, not the end of the comparison
            return pd.DataFrame({"candidate": [c], "seed": [s], "status": ["error"], "error_message": [str(error)], "v": [None], "x": [None]})

    return rows.repartitionByRange(len(runs), "run").groupBy("run").applyInPandas(run, "candidate string, seed int, status string, error_message string, v bigint, x array<double>")


def run_candidates_tables(edges: DataFrame, vertices: DataFrame, candidates: dict[str, dict], seeds: list[int]) -> DataFrame:
    """The same for graphs of any size: each run is the layout on tables, one after another; a run that fails is a row with its error."""
    from meshlark.operators.layout import LayoutParams
    from meshlark.operators.layout_tables import multiscale_tables

    out, columns = None, "candidate string, seed int, status string, error_message string, v bigint, x array<double>"
    for c, p in candidates.items():
        for s in seeds:
            try:
                x = multiscale_tables(edges, vertices, LayoutParams.of(**(p | {"seed": s})))
                x = x.select(F.lit(c).alias("candidate"), F.lit(s).alias("seed"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_message"), "v", "x")
            except ValueError as error:
                x = vertices.sparkSession.createDataFrame([(c, s, "error", str(error), None, None)], columns)
            out = x if out is None else out.union(x)
    return out


def score_runs(layouts: DataFrame, edges: DataFrame, dist: DataFrame, pairs: DataFrame, clusters: DataFrame | None = None, count_crossings: bool | None = None) -> DataFrame:
    """One row per run with sampled stress, edge statistics, non-edge separation, crossings (of layouts in two dimensions, however many edges there are, unless they are
    declined) and cluster separation; every run's pairs are scored in the same aggregates."""
    key = ["candidate", "seed"]
    ok = layouts.where("status = 'ok'")
    a, b = (ok.select(*key, F.col("v").alias(c), F.col("x").alias(f"x{c}")) for c in ("i", "j"))
    p = pairs.join(dist, ["i", "j"]).where("d > 0").join(a, "i").join(b, [*key, "j"]).withColumn("o", V.euclid("xi", "xj"))
    s = p.groupBy(key).agg(F.sum(F.col("o") * F.col("d")).alias("od"), F.sum(F.col("o") ** 2).alias("oo"), F.sum(F.col("d") ** 2).alias("dd"))
    s = s.select(*key, F.sqrt(F.greatest(F.lit(0.0), F.col("oo") - F.col("od") ** 2 / F.col("dd")) / F.col("oo")).alias("sampled_stress"))
    e = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).join(a, "i").join(b, [*key, "j"]).withColumn("l", V.euclid("xi", "xj"))
    e = e.groupBy(key).agg(F.percentile("l", F.lit(0.5)).alias("median_edge_length"), (F.stddev_samp("l") / F.avg("l")).alias("edge_length_cv"))
    n = pairs.select("i", "j").join(edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")), ["i", "j"], "left_anti")
    n = n.join(a, "i").join(b, [*key, "j"]).groupBy(key).agg(F.min(V.euclid("xi", "xj")).alias("gap"))
    runs = layouts.groupBy(*key, "status").agg(F.first("error_message").alias("error_message"))
    out = runs.join(s, key, "left").join(e, key, "left").join(n, key, "left").withColumn("sampled_nonedge_sep_ratio", F.col("gap") / F.col("median_edge_length")).drop("gap")
    if count_crossings is not False:
        flat = ok.where(F.size("x") == 2)
        runs_2d = flat.select(*key).distinct().withColumn("flat", F.lit(True))
        out = out.join(crossings(edges, flat, tuple(key)), key, "left").join(runs_2d, key, "left").withColumn("edge_crossings", F.when(F.col("flat"), F.coalesce("edge_crossings", F.lit(0)))).drop("flat")
    else:
        out = out.withColumn("edge_crossings", F.lit(None).cast("bigint"))
    return out.join(cluster_separation(ok, clusters, tuple(key)), key, "left") if clusters is not None else out.withColumn("cluster_separation", F.lit(None).cast("double"))


def summarise(runs: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """Per candidate: n_ok, n_fail, mean and standard deviation of each score over ok runs (0 below two)."""
    ok = F.col("status") == "ok"
    aggs = [F.sum(F.when(ok, 1).otherwise(0)).alias("n_ok"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_fail")]
    for c in SCORES:
        v = F.when(ok, F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.when(F.count(v) < 2, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias(f"{c}_sd")]
    s = runs.groupBy("candidate").agg(*aggs)
    return s.join(stability, "candidate", "left") if stability is not None else s.withColumn("stability_mean", F.lit(None).cast("double"))


def rank(summary: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """summary with composite_score (lower is better) and rank: weights are shared among metrics that have any finite value."""
    weights = weights or WEIGHTS
    live = summary.agg(*(F.max(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) != F.lit(float("inf")))).alias(m) for m in weights)).first()
    used = {m: w for m, w in weights.items() if live[m]}
    total = sum(used.values()) or 1.0
    score = sum((F.lit(w / total) * rank01(m, m in HIGHER_BETTER) for m, w in used.items()), F.lit(0.0))
    from pyspark.sql import Window

    out = summary.withColumn("composite_score", score)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.bround("composite_score", 12), "sampled_stress_mean", "candidate")))


def stability(layouts: DataFrame) -> DataFrame:
    """candidate, stability_mean, stability_max: Procrustes RMSE over pairs of seeds in two dimensions, whose best rotation and reflection has a closed form
    of the four cross-products."""
    x = layouts.where("status = 'ok'").select("candidate", "seed", "v", F.get("x", F.lit(0)).alias("p"), F.get("x", F.lit(1)).alias("q"))
    m = x.groupBy("candidate", "seed").agg(F.avg("p").alias("mp"), F.avg("q").alias("mq"))
    x = x.join(m, ["candidate", "seed"]).withColumns({"p": F.col("p") - F.col("mp"), "q": F.col("q") - F.col("mq")})
    r = x.groupBy("candidate", "seed").agg(F.max(F.sqrt(F.col("p") ** 2 + F.col("q") ** 2)).alias("r"))
    x = x.join(r, ["candidate", "seed"]).select("candidate", "seed", "v", (F.col("p") / F.col("r")).alias("p"), (F.col("q") / F.col("r")).alias("q"))
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, (F.col("a.candidate") == F.col("b.candidate")) & (F.col("a.v") == F.col("b.v"))).where("a.seed < b.seed")
    s = {n: F.sum(F.col(f"a.{c[0]}") * F.col(f"b.{c[1]}")) for n, c in (("pp", "pp"), ("pq", "pq"), ("qp", "qp"), ("qq", "qq"))}
    g = j.groupBy(F.col("a.candidate").alias("candidate"), F.col("a.seed").alias("s"), F.col("b.seed").alias("t")).agg(*(v.alias(k) for k, v in s.items()), F.sum(F.col("a.p") ** 2 + F.col("a.q") ** 2 + F.col("b.p") ** 2 + F.col("b.q") ** 2).alias("ss"), F.count(F.lit(1)).alias("n"))
    best = F.greatest(F.sqrt((F.col("pp") + F.col("qq")) ** 2 + (F.col("pq") - F.col("qp")) ** 2), F.sqrt((F.col("pp") - F.col("qq")) ** 2 + (F.col("pq") + F.col("qp")) ** 2))
    g = g.withColumn("rmse", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") - 2 * best) / F.col("n")))
    return g.groupBy("candidate").agg(F.avg("rmse").alias("stability_mean"), F.max("rmse").alias("stability_max"))


def params_of_first(summary: DataFrame, columns: list[str]) -> dict:
    """The parameters of the first-ranked candidate; an empty preset is left out."""
    r = summary.orderBy("rank").select(*columns).first()
    return {c: r[c] for c in columns if r[c] is not None and not (c == "preset" and r[c] == "")}


def compare(edges: DataFrame, vertices: DataFrame, candidates: dict[str, dict], seeds: list[int], dist: DataFrame, pairs: DataFrame, clusters: DataFrame | None = None, how: str = "kernel", count_crossings: bool | None = None) -> DataFrame:
    """Summary and rank of candidates over seeds. ``how``: a kernel a run side by side, or ``tables``, run by run."""
    from meshlark.plans.shared import materialize

    layouts = materialize((run_candidates_tables if how == "tables" else run_candidates)(edges, vertices, candidates, seeds), "layouts")
    return rank(summarise(score_runs(layouts, edges, dist, pairs, clusters, count_crossings), stability(layouts).select("candidate", "stability_mean")))
