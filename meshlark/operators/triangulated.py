"""Triangulated surfaces: regions of a triangular lattice and subdivided polyhedra, as range queries whose shared vertices meet by key."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.components import components
from meshlark.operators.generators import Bundle
from meshlark.operators.graph import lengths_from_coords, normalize_lengths
from meshlark.plans.shared import average_ranks, discard, materialize


LATTICE_TASK = 1_000_000  # points of a task


def _dense(cells: DataFrame, key: str) -> DataFrame:
    """key, v: places from 1 in the order of the key, counted in ranges."""
    return average_ranks(cells.select(key), key).select(key, F.col("rank").cast("bigint").alias("v"))


def _unit_radius(coords: DataFrame, dim: int) -> DataFrame:
    """v, x, q: coordinates and the same ones centred and divided by the greatest radius."""
    m = coords.agg(*(F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(dim)))
    c = coords.crossJoin(F.broadcast(m)).select("v", "x", F.array(*(F.get("x", F.lit(k)) - F.col(f"m{k}") for k in range(dim))).alias("q"))
    r = c.agg(F.max(V.norm("q")).alias("r"))
    return c.crossJoin(F.broadcast(r)).select("v", "x", F.transform("q", lambda a: a / F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)).alias("q"))  # one row each


def lattice_region(spark: SparkSession, box: tuple[float, float, float, float], spacing: float, keep) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, a, b: coordinates of their ends) and coordinates (v, x: two of them) of the largest component of a triangular lattice's points in a region; ``keep`` is a predicate of two columns.

    Rows lie spacing sqrt(3) / 2 apart and every other one is moved by half a spacing; a row and a column beyond the box are tried on each side. Vertices are numbered by row and column.
    Neighbouring points of a row are one run, and components are those of runs, whose number grows with the rows; points and edges follow from the runs that stay, without a shuffle.
    """
    x0, x1, y0, y1 = box
    if not (x0 < x1 and y0 < y1 and spacing > 0):
        raise ValueError("the box or the spacing is empty")
    high = spacing * math.sqrt(3) / 2
    rows, cols = int((y1 - y0 + 2 * high) / high + 1e-10) + 1, math.ceil((x1 - x0) / spacing) + 4
    at = lambda r, c: (F.lit(x0 - spacing) + spacing * (c + 0.5 * (r % 2)), F.lit(y0 - high) + high * r)
    r, c = F.col("r"), F.col("c")
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("bigint").alias("r"), (F.col("id") % cols).alias("c"))
    held = lambda d: (c + d >= 0) & (c + d < cols) & keep(*at(r, c + d))
    ends = cells.where(held(0)).select("r", "c", (~held(-1)).alias("first"), (~held(1)).alias("last")).where("first or last")
    ends = ends.groupBy("r").agg(*(F.array_sort(F.collect_list(F.when(F.col(n), c))).alias(n) for n in ("first", "last")))  # as many as a row has runs
    runs = materialize(ends.select("r", F.explode(F.arrays_zip("first", "last")).alias("run")).select((r * cols + F.col("run.first")).alias("id"), "r", F.col("run.first").alias("lo"), F.col("run.last").alias("hi")), "runs")
    up = runs.select((r - 1).alias("r"), F.col("id").alias("up"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = runs.join(up, "r").where((F.col("lo2") <= F.col("hi") + r % 2) & (F.col("hi2") >= F.col("lo") + r % 2 - 1)).select(F.col("id").alias("a"), F.col("up").alias("b"))
    comp = runs.join(components(met), "id", "left").select(*runs.columns, F.coalesce("component", "id").alias("root"))
    comp = materialize(comp, "rooted")
    top = comp.groupBy("root").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), F.count(F.lit(1)).alias("runs")).orderBy(F.desc("n"), "root").first()
    if top is None or top["runs"] == 1 and top["n"] == 1:
        raise ValueError("the region holds no edges at this spacing")
    # Points before each row's first run and each run, from sums of the rows: no more rows than the lattice has.
    kept = comp.where(F.col("root") == top["root"]).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    order = kept.repartitionByRange("r").withColumn("part", F.spark_partition_id())
    order = materialize(order, "rows")
    size = order.groupBy("part").agg(F.sum("n").alias("size"))
    before = size.alias("a").join(F.broadcast(size.alias("b")), F.col("a.part") > F.col("b.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))  # a row for each range
    own = F.sum("n").over(Window.partitionBy("part").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    place = materialize(order.withColumn("upto", own).join(F.broadcast(before), "part").select("r", "runs", (F.col("before") + F.col("upto") - F.col("n")).alias("below")), "places")
    discard(runs, comp, order)

    def number(runs: Column, below: Column, c: Column) -> Column:
        """A point's number, or null where no run of the row has it: points before the row, those of runs to the left, and its place in its own."""
        has = F.exists(runs, lambda x: (x["lo"] <= c) & (c <= x["hi"]))
        left = F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(F.lit(0).cast("bigint"), F.least(c, x["hi"]) - x["lo"] + 1))
        return F.when(has, below + left)

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-top["n"] // LATTICE_TASK))
    lone = place.select("r", "runs", "below", F.explode("runs").alias("run")).withColumn("base", number(F.col("runs"), F.col("below"), F.col("run.lo"))).repartition(spread)
    g = lone.select("r", "runs", "below", (F.col("base") - F.col("run.lo")).alias("base"), F.explode(F.sequence("run.lo", "run.hi")).alias("c")).withColumn("v", F.col("base") + c)
    coords = g.select("v", F.array(*at(r, c)).alias("x"))
    above = place.select((r - 1).alias("r"), F.col("runs").alias("runs2"), F.col("below").alias("below2"))
    g = g.join(F.broadcast(above), "r", "left")
    to = [(r, c + 1, number(F.col("runs"), F.col("below"), c + 1)), *((r + 1, k, number(F.col("runs2"), F.col("below2"), k)) for k in (c, c + 2 * (r % 2) - 1))]
    ways = F.filter(F.array(*(F.struct(v.alias("dst"), F.array(*at(p, q)).alias("b")) for p, q, v in to)), lambda x: x["dst"].isNotNull())
    return g.select(F.col("v").alias("src"), F.array(*at(r, c)).alias("a"), F.explode(ways).alias("to")).select("src", "to.dst", "a", "to.b"), coords


def _lifted(edges: DataFrame, flat: DataFrame, surface: str, a: float, fu: float, fv: float, by: str, family: str, **attrs) -> Bundle:
    part = lambda x, k: F.get(x, F.lit(k))
    m = flat.agg(*(F.avg(part("x", k)).alias(f"m{k}") for k in range(2))).first()
    u, t = (part("x", k) - m[k] for k in range(2))
    r = flat.agg(F.max(F.sqrt(u * u + t * t)).alias("r")).first()["r"] or 1.0

    def lift(x: str) -> Column:
        u, t = ((part(x, k) - m[k]) / r for k in range(2))
        z = F.lit(0.0) if surface == "flat" else a * F.abs(u) if surface == "folded" else V.surface_height(u, t, surface, a, fu, fv)
        return F.array(part(x, 0), part(x, 1), z)

    # Neighbours of a lattice are a spacing apart, so every edge has a length.
    e = edges.select("src", "dst", V.euclid(lift("a"), lift("b")).alias("w"))
    return Bundle(normalize_lengths(e, by), flat.select("v", lift("x").alias("x")), family, {"surface": surface, **attrs})


def annulus(spark: SparkSession, resolution: int = 12, outer: float = 1.0, inner: float = 0.45, surface: str = "flat", a: float = 0.6, fu: float = 1.0, fv: float = 1.0, by: str = "median") -> Bundle:
    """The lattice between two circles, ``resolution`` spacings to the outer radius."""
    if resolution < 4 or not 0 < inner < outer or outer - inner < 2 * outer / resolution:
        raise ValueError("an annulus has a resolution of at least 4, radii in order, and is two spacings thick")
    r2 = lambda x, y: x * x + y * y
    e, c = lattice_region(spark, (-outer, outer, -outer, outer), outer / resolution, lambda x, y: (r2(x, y) <= outer**2) & (r2(x, y) >= inner**2))
    return _lifted(e, c, surface, a, fu, fv, by, "triangulated-annulus", resolution=resolution)


def pair_of_pants(spark: SparkSession, resolution: int = 12, outer: float = 1.1, hole: float = 0.24, offset: float = 0.38, height: float = 0.18, surface: str = "flat", a: float = 0.6, fu: float = 1.0, fv: float = 1.0, by: str = "median") -> Bundle:
    """The lattice in a circle without two round holes at (-offset, height) and (offset, height)."""
    far = math.hypot(offset, height) + hole
    if resolution < 4 or not 0 < hole < offset or far >= outer or outer - far < outer / resolution:
        raise ValueError("the holes lie apart and inside the circle, with a spacing to spare")
    out = lambda x, y, cx: (x - cx) * (x - cx) + (y - height) * (y - height) >= hole**2
    e, c = lattice_region(spark, (-outer, outer, -outer, outer), outer / resolution, lambda x, y: (x * x + y * y <= outer**2) & out(x, y, -offset) & out(x, y, offset))
    return _lifted(e, c, surface, a, fu, fv, by, "triangulated-pair-of-pants", resolution=resolution)


def solid(base: str) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Corners on the unit sphere and triangular faces: those triples of corners that are at the least distance from each other."""
    phi = (1 + math.sqrt(5)) / 2
    corners = {
        "tetrahedron": [s for s in itertools.product((1, -1), repeat=3) if math.prod(s) == 1],
        "octahedron": [tuple(s if k == axis else 0 for k in range(3)) for axis in range(3) for s in (1, -1)],
        "icosahedron": [tuple(np.roll((0, s, t * phi), k)) for k in range(3) for s in (1, -1) for t in (1, -1)],
    }[base]
    x = np.array(corners, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    edge = d[d > 1e-9].min() * (1 + 1e-9)
    return x, [f for f in itertools.combinations(range(len(x)), 3) if all(d[p, q] <= edge for p, q in itertools.combinations(f, 2))]


def polyhedron(spark: SparkSession, base: str = "octahedron", level: int = 1, surface: str = "standard", a: float = 0.25, freq: float = 2.0, twist: float = 0.6, by: str = "median") -> Bundle:
    """A polyhedron whose faces are split in four ``level`` times. A vertex's key is its corners with their shares, so faces meet in the vertices that they have in common."""
    x, faces = solid(base)
    parts = 2**level
    side = parts + 1
    corner = F.array(*(F.array(*map(F.lit, p)) for p in x.tolist()))
    face = F.array(*(F.array(*map(F.lit, f)) for f in faces))
    g = spark.range(len(faces) * side * side).select(F.floor(F.col("id") / (side * side)).cast("int").alias("f"), (F.floor(F.col("id") / side) % side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    g = g.where(F.col("i") + F.col("j") <= parts).withColumn("face", F.get(face, F.col("f")))

    def key(i: Column, j: Column) -> Column:
        shares = F.array(parts - i - j, i, j)
        return F.concat_ws(" ", F.array_sort(F.filter(F.zip_with("face", shares, lambda c, n: F.when(n > 0, F.concat_ws(":", F.lpad(c.cast("string"), 2, "0"), n.cast("string")))), lambda k: k.isNotNull())))

    i, j = F.col("i"), F.col("j")
    at = lambda k: F.aggregate(F.zip_with("face", F.array(parts - i - j, i, j), lambda c, n: F.get(F.get(corner, c), F.lit(k)) * n / parts), F.lit(0.0), lambda p, q: p + q)
    points = g.groupBy(key(i, j).alias("key")).agg(F.min(F.array(*(at(k) for k in range(3)))).alias("x"))
    points = materialize(points, "vertices")
    place = materialize(points.join(_dense(points, "key"), "key"), "places")
    to = F.array(F.when(i + j < parts, key(i + 1, j)), F.when(i + j < parts, key(i, j + 1)), F.when(j >= 1, key(i + 1, j - 1)))
    e = g.select(key(i, j).alias("a"), F.explode(to).alias("b")).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    name = lambda n: place.select(F.col("key").alias(n), F.col("v").alias(f"{n}_v"))
    e = materialize(e.join(name("a"), "a").join(name("b"), "b").select(F.least("a_v", "b_v").alias("src"), F.greatest("a_v", "b_v").alias("dst")), "edges")
    flat = place.select("v", "x")
    coords = materialize(_bent(flat, surface, a, freq, twist), "bent")
    return Bundle(lengths_from_coords(e, coords, by), coords, "triangulated-polyhedron", {"base": base, "surface": surface, "level": level})


def _bent(flat: DataFrame, surface: str, a: float, freq: float, twist: float) -> DataFrame:
    """Points as they are, drawn to the unit sphere, turned by their height, or with a wave along their radius."""
    if surface == "standard":
        return flat
    q = _unit_radius(flat, 3).withColumn("n", V.norm("x"))
    x, u = (lambda k: F.get("x", F.lit(k))), (lambda k: F.get("q", F.lit(k)))
    if surface == "twisted":
        t = twist * u(2)
        return q.select("v", F.array(x(0) * F.cos(t) - x(1) * F.sin(t), x(0) * F.sin(t) + x(1) * F.cos(t), x(2)).alias("x"))
    wave = 1 + a * F.sin(math.pi * freq * u(0)) * F.cos(math.pi * freq * u(1)) * F.sin(math.pi * freq * u(2))
    scale = {"inflated": (F.col("n") + a * (1 - F.col("n"))) / F.col("n"), "wavy": wave}[surface]
    out = q.select("v", F.transform("x", lambda c: c * scale).alias("x"), scale.alias("s"))
    if not out.where("s is null or s <= 0").isEmpty():
        raise ValueError("the amplitude leaves a radius that is not above 0")
    return out.select("v", "x")
