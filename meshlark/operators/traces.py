"""Traces of layouts as tables: frames (frame, v, x) and their meta rows, thinning, diagnostics of each frame, and stage records; and the refinement after a layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators import fits, layout
from meshlark.plans.shared import materialize

META = "frame int, phase string, misf_level int, round_in_level int, active_vertices int"


def thin(meta: list[dict], every: int = 1) -> list[int]:
    """The places of the frames that stay: insertions, every so many rounds of a level, and each level's last round."""
    if every < 1:
        raise ValueError("every must be at least 1")
    last = {m["misf_level"]: k for k, m in enumerate(meta)}
    return [k for k, m in enumerate(meta) if m["phase"] != "refinement" or m["round_in_level"] % every == 0 or last[m["misf_level"]] == k]


def trace(spark: SparkSession, ids: list[int], edges: list[tuple[int, int, float]], p: layout.LayoutParams, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """(meta, frames) of one connected graph's layout; vertices that are not placed yet have no row in a frame. Frames are numbered from 0 after thinning."""
    meta, rows = layout.trace_frames(ids, edges, p)
    keep = {k: n for n, k in enumerate(thin(meta, every))}
    m = [(n, meta[k]["phase"], meta[k]["misf_level"], meta[k]["round_in_level"], meta[k]["active_vertices"]) for k, n in keep.items()]
    f = [(keep[k], v, x) for k, v, x in rows if k in keep]
    return spark.createDataFrame(m, META), spark.createDataFrame(f, "frame int, v bigint, x array<double>")


def diagnostics(frames: DataFrame, edges: DataFrame, mode: str = "light", pairs: DataFrame | None = None, dist: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame | None:
    """For each frame, over the edges between its vertices: active_edges, edge_length_cv, median_edge_length; with ``pairs`` (i, j: a sample) the least distance of those that are no
    edges by the median length; ``full`` adds the stress of the sampled pairs against ``dist`` (i, j, d), and a ``target`` (v, x) the rmse after normalised alignment."""
    if mode not in ("none", "light", "full"):
        raise ValueError(f"unknown diagnostics {mode!r}")
    if mode == "none":
        return None
    at = lambda c: frames.select("frame", F.col("v").alias(c), F.col("x").alias(f"x_{c}"))
    every = frames.groupBy("frame").agg(F.count(F.lit(1)).cast("int").alias("active_vertices"))
    e = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), ["frame", "dst"]).withColumn("len", V.euclid("x_src", "x_dst"))
    e = e.groupBy("frame").agg(F.count(F.lit(1)).alias("active_edges"), F.when(F.avg("len") > 0, F.stddev_samp("len") / F.avg("len")).alias("edge_length_cv"), F.percentile("len", F.lit(0.5)).alias("median_edge_length"))
    out = every.join(e, "frame", "left").withColumn("active_edges", F.coalesce("active_edges", F.lit(0)))
    if pairs is not None:
        p = pairs.select("i", "j").join(at("i"), "i").join(at("j"), ["frame", "j"]).withColumn("o", V.euclid("x_i", "x_j"))
        ends = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
        apart = p.join(ends, ["i", "j"], "left_anti").groupBy("frame").agg(F.min("o").alias("closest"))
        out = out.join(apart, "frame", "left").withColumn("nonedge_sep_ratio", F.when(F.col("median_edge_length") > 0, F.col("closest") / F.col("median_edge_length"))).drop("closest")
        if mode == "full" and dist is not None:
            q = p.join(dist, ["i", "j"]).where("d > 0 and d < double('infinity')").groupBy("frame").agg(F.sum(F.col("o") * F.col("d")).alias("od"), F.sum(F.col("o") ** 2).alias("oo"), F.sum(F.col("d") ** 2).alias("dd"))
            out = out.join(q.select("frame", F.when(F.col("oo") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("oo") - F.col("od") ** 2 / F.col("dd")) / F.col("oo"))).alias("sampled_stress")), "frame", "left")
    if target is not None:
        j = frames.join(target.select("v", F.col("x").alias("t")), "v")
        out = out.join(j.groupBy("frame").applyInPandas(_aligned, "frame int, procrustes_rmse double"), "frame", "left")
    return out


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    """A frame has as many vertices as a layout kernel takes at most."""
    unit = lambda a: (a - a.mean(axis=0)) / (np.sqrt(((a - a.mean(axis=0)) ** 2).sum(axis=1)).max() or 1.0)
    s, t = (unit(np.array(pdf[c].tolist(), dtype=float)) for c in ("x", "t"))
    u, _, v = np.linalg.svd(s.T @ t)
    return pd.DataFrame({"frame": pdf["frame"].iloc[:1], "procrustes_rmse": [float(np.sqrt((((s @ u @ v) - t) ** 2).sum(axis=1).mean()))]})


def stages(meta: DataFrame, polished: bool = False) -> DataFrame:
    """stage, kind, misf_level, first_frame, last_frame, rounds: runs of frames of one phase and level in their order, named seed (the first of a trace that starts before any round), top_level,
    insertion, refinement; and final_polish at the end if there was one."""
    top = meta.agg(F.max("misf_level").alias("top"))
    g = meta.groupBy("misf_level", "phase").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("round_in_level").alias("rounds")).crossJoin(F.broadcast(top))  # one row
    kind = F.when(F.col("phase") == "insertion", "insertion").when(F.col("misf_level") == F.col("top"), "top_level").otherwise("refinement")
    s = g.select(kind.alias("kind"), "misf_level", "first_frame", "last_frame", "rounds")
    if polished:
        s = s.union(meta.agg(F.lit("final_polish").alias("kind"), F.lit(0).alias("misf_level"), F.max("frame") + 1, F.max("frame") + 1, F.lit(0)))
    from pyspark.sql import Window

    return s.withColumn("stage", F.row_number().over(Window.orderBy("first_frame"))).select("stage", "kind", "misf_level", "first_frame", "last_frame", "rounds")  # a few rows a level


def polish(edges: DataFrame, coords: DataFrame, rounds: int, local: int = 5, landmarks: int = 3) -> DataFrame:
    """Coordinates after ``rounds`` steps towards the graph distances of near and landmark pairs; unchanged without rounds."""
    if rounds <= 0:
        return coords
    return fits.landmark_geodesic_kk(edges, coords.select("v"), coords, local, landmarks, max_iter=rounds).coords


def layout_graph(edges: DataFrame, vertices: DataFrame, metric: str = "hop", preset: str | None = None, polish_rounds: int = 0, **params) -> DataFrame:
    """v, x: the layout by hops or edge lengths (components side by side), and its refinement if asked. Edge-length arguments are an error with hops."""
    if metric == "hop" and "normalize" in params:
        raise ValueError("normalize is for edge lengths")
    x = layout.multiscale(edges, vertices, [{"metric": metric, "preset": preset, **params}]).select("v", "x")
    return polish(edges, materialize(x, "layout"), polish_rounds)
