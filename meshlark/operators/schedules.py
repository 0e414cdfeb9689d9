"""Step-size, round and weight schedules as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sgd_rates(spark: SparkSession, epochs: int, kind: str = "hybrid", start: float = 1.0, final: float = 0.01, w_min: float = 1.0, w_max: float = 1.0, eps: float = 0.1, horizon: int | None = None) -> DataFrame:
    """epoch (from 0), rate. hybrid: a tenth of the start after 40 % of the epochs by an exponential, then harmonic to ``final``;
    exponential: start to final; zheng: log-linear from 1 / w_min to eps / w_max. Past the horizon: last / (1 + j / horizon)."""
    h = horizon or epochs
    t = F.col("epoch")
    last = {"hybrid": final, "exponential": final, "zheng": eps / w_max}[kind]
    tau = math.floor(0.4 * h)
    if kind == "hybrid":
        early = start * F.pow(F.lit(10.0), -t / max(1, tau))
        ten, steps = start / 10, max(1, h - 1 - tau)
        late = ten / (1 + (t - tau) / steps * (ten / final - 1))
        rate = F.when(t < tau, early).otherwise(late)
    else:
        a, b = (start, final) if kind == "exponential" else (1 / w_min, eps / w_max)
        rate = a * F.pow(F.lit(b / a), t / max(1, h - 1))
    return spark.range(epochs).withColumnRenamed("id", "epoch").select("epoch", F.when(t < h, rate).otherwise(last / (1 + (t - h + 1) / h)).alias("rate"))


def round_schedule(spark: SparkSession, levels: int, most: int, least: int) -> DataFrame:
    """level, rounds: ceil(most * exp(-k level)) with k = -ln(least / most) / levels."""
    k = -math.log(least / most) / max(1, levels)
    return spark.range(levels + 1).select(F.col("id").alias("level"), F.ceil(F.round(most * F.exp(-k * F.col("id")), 9)).cast("bigint").alias("rounds"))


def weight_schedule(spark: SparkSession, steps: int, first: float, last: float, kind: str = "linear") -> DataFrame:
    t = F.col("id") / max(1, steps - 1)
    w = {"constant": F.lit(first), "linear": first + (last - first) * t, "geometric": first * F.pow(F.lit(last / first if first else 1.0), t)}[kind]
    return spark.range(steps).select(F.col("id").alias("step"), w.alias("weight"))


def neighbour_schedule(sizes: DataFrame, most: int) -> DataFrame:
    """level, nbrs = min(most, size - 1)."""
    return sizes.select("level", F.least(F.lit(most), F.col("size") - 1).alias("nbrs"))


def final_rounds(n: int) -> int:
    """Rounds of the last level by the number of vertices."""
    return next(r for most, r in ((1_000, 384), (5_000, 320), (20_000, 256), (50_000, 200), (math.inf, 128)) if n <= most)
