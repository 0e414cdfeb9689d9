"""Synthetic graphs as range queries: ids are arithmetic on ``spark.range``, neighbours are offsets, coordinates are column expressions."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.graph import canonical, lengths_from_coords


@dataclass
class Bundle:
    """edges (src, dst, w), coords (v, x), params (v, x): the surface, its parameters, and what made it."""

    edges: DataFrame
    coords: DataFrame
    family: str
    attrs: dict = field(default_factory=dict)


def _grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    """v, i, j with v = i * w + j + 1."""
    return spark.range(h * w).select((F.col("id") + 1).alias("v"), F.floor(F.col("id") / w).cast("bigint").alias("i"), (F.col("id") % w).alias("j"))


def _edges(cells: DataFrame, targets: list[tuple[Column, Column]]) -> DataFrame:
    """Edges (src, dst) from each cell to (target, condition)."""
    t = F.array(*(F.when(ok, to) for to, ok in targets))
    return cells.select(F.col("v").alias("src"), F.explode(t).alias("dst")).where("dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    if n < 3:
        raise ValueError("a cycle has at least three vertices")
    return spark.range(1, n + 1).select(F.least("id", F.col("id") % n + 1).alias("src"), F.greatest("id", F.col("id") % n + 1).alias("dst"))


def mesh(spark: SparkSession, h: int, w: int, diagonal: bool = False) -> DataFrame:
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    t = [(v + 1, j < w - 1), (v + w, i < h - 1)] + ([(v + w + 1, (i < h - 1) & (j < w - 1))] if diagonal else [])
    return _edges(_grid(spark, h, w), t)


def cylinder(spark: SparkSession, h: int, w: int) -> DataFrame:
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    return _edges(_grid(spark, h, w), [(i * w + (j + 1) % w + 1, F.lit(w > 1)), (v + w, i < h - 1)])


def torus(spark: SparkSession, h: int, w: int) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    return _edges(_grid(spark, h, w), [(i * w + (j + 1) % w + 1, F.lit(w > 1)), (((i + 1) % h) * w + j + 1, F.lit(h > 1))])


def sphere(spark: SparkSession, h: int, w: int) -> DataFrame:
    """Poles are vertices 1 and 2 + (h - 2) w; h counts both."""
    rows, last = h - 2, 2 + (h - 2) * w
    c = _grid(spark, rows, w).withColumn("v", F.col("v") + 1)
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    return _edges(c, [(i * w + (j + 1) % w + 2, F.lit(w > 1)), (v + w, i < rows - 1), (F.lit(1).cast("bigint"), i == 0), (F.lit(last).cast("bigint"), i == rows - 1)])


def kary_tree(spark: SparkSession, k: int, depth: int) -> DataFrame:
    n = sum(k**d for d in range(depth + 1))
    return spark.range(2, n + 1).select((F.floor((F.col("id") - 2) / k) + 1).cast("bigint").alias("src"), F.col("id").alias("dst"))


def kary_tree_weighted(spark: SparkSession, k: int, depth: int, base: float = 1.0, decay: float = 1.0, spread: float = 0.0, by: str = "none") -> DataFrame:
    """length = base * decay^(level - 1) * branch factor, linear over the branches."""
    e = kary_tree(spark, k, depth)
    # The level is counted exactly: the number of level starts that are not past the vertex.
    starts = [1 + sum(k**d for d in range(x)) for x in range(1, depth + 1)]
    level = sum((F.when(F.col("dst") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    slot = (F.col("dst") - 2) % k
    branch = F.lit(1.0) if k == 1 else F.lit(1 - spread / 2) + slot * F.lit(spread / (k - 1))
    from meshlark.operators.graph import normalize_lengths

    return normalize_lengths(e.withColumn("w", F.lit(base) * F.pow(F.lit(decay), level - 1) * branch), by)


def cube_surface(spark: SparkSession, side: int) -> DataFrame:
    """Vertices of a side^3 lattice with a coordinate on a face, numbered by the lattice (z fastest); +x, +y, +z neighbours that are there too. Only vertices of the surface are
    formed: the two faces across x, and between them a ring for each x; whether a neighbour is there shows from the coordinates."""
    last, face, ring = side - 1, side * side, 4 * (side - 1)
    whole = min(side, 2) * face
    at, c = F.col("id") - whole, F.col("id") < whole
    on = F.pmod(at, F.lit(max(ring, 1)))
    q = on - 2 * side
    floor = lambda a, b: F.floor(a / b).cast("bigint")
    x = F.when(c, floor(F.col("id"), face) * last).otherwise(1 + floor(at, max(ring, 1)))
    y = F.when(c, floor(F.col("id") % face, side)).when(on < side, 0).when(on < 2 * side, last).otherwise(1 + floor(q, 2))
    z = F.when(c, F.col("id") % side).when(on < side, on).when(on < 2 * side, on - side).otherwise(F.pmod(q, F.lit(2)) * last)
    cells = spark.range(whole + max(side - 2, 0) * ring).select(*(v.cast("bigint").alias(f"c{k}") for k, v in enumerate((x, y, z))))
    v = F.col("c0") * face + F.col("c1") * side + F.col("c2") + 1
    outer = lambda k: F.col(f"c{k}").isin(0, last)
    there = [(F.col(f"c{k}") < last) & (outer((k + 1) % 3) | outer((k + 2) % 3) | (F.col(f"c{k}") + 1 == last)) for k in range(3)]
    ways = F.array(*(F.when(t, v + side ** (2 - k)) for k, t in enumerate(there)))
    return cells.select(v.alias("src"), F.explode(F.array_compact(ways)).alias("dst"))


def _cells(spark: SparkSession, side: int, dims: int) -> DataFrame:
    return spark.range(side**dims).select((F.col("id") + 1).alias("v"), *((F.floor(F.col("id") / side ** (dims - 1 - k)) % side).cast("bigint").alias(f"c{k}") for k in range(dims)))


def cells_edges(cells: DataFrame, side: int, dims: int) -> DataFrame:
    t = [(F.col("v") + side ** (dims - 1 - k), F.col(f"c{k}") < side - 1) for k in range(dims)]
    return _edges(cells, t).join(cells.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")


@dataclass(frozen=True)
class Mask:
    """The kept cells of a base^dims block."""

    base: int
    dims: int
    kept: frozenset

    def __len__(self) -> int:
        return len(self.kept)


def _whole(name: str, value: int, least: int, most: int | None = None) -> None:
    if int(value) != value or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else ""))


def _where(base: int, dims: int, keep) -> Mask:
    return Mask(base, dims, frozenset(c for c in itertools.product(range(base), repeat=dims) if keep(*c)))


def _without(base: int, *boxes: tuple[tuple[int, int], ...]) -> Mask:
    """All cells but those of boxes, each given by (first, size) an axis."""
    inside = lambda c, box: all(at <= x < at + n for x, (at, n) in zip(c, box, strict=True))
    return _where(base, len(boxes[0]), lambda *c: not any(inside(c, b) for b in boxes))


def mask_cross(k: int = 5, arm_width: int = 1) -> Mask:
    """Rows and columns through the middle."""
    _whole("k", k, 3)
    _whole("arm_width", arm_width, 1, k)
    if k % 2 == 0:
        raise ValueError("k must be odd")
    arm = range(at := (k - arm_width) // 2, at + arm_width)
    return _where(k, 2, lambda r, c: r in arm or c in arm)


def mask_border(k: int = 5, thickness: int = 1) -> Mask:
    _whole("k", k, 3)
    _whole("thickness", thickness, 1, k)
    return _where(k, 2, lambda r, c: min(r, c, k - 1 - r, k - 1 - c) < thickness)


def mask_corner(k: int = 5, width: int = 2, corner: str = "top_left") -> Mask:
    """One square block in a corner."""
    _whole("k", k, 2)
    _whole("width", width, 1, k)
    row, _, col = corner.partition("_")
    if row not in ("top", "bottom") or col not in ("left", "right"):
        raise ValueError(f"unknown corner {corner!r}")
    return _where(k, 2, lambda r, c: (r if row == "top" else k - 1 - r) < width and (c if col == "left" else k - 1 - c) < width)


def mask_asymmetric_holes(k: int = 5, hole_size: int = 1) -> Mask:
    """Holes near the two upper corners, and one at the lower side near the middle."""
    _whole("k", k, 5)
    _whole("hole_size", hole_size, 1, max(1, (k - 3) // 2))
    if k % 2 == 0:
        raise ValueError("k must be odd")
    far = k - hole_size - 1
    middle = max(1, min(far, (k - 1) // 2 - hole_size // 2))
    return _without(k, *(((r, hole_size), (c, hole_size)) for r, c in ((1, 1), (1, far), (far, middle))))


def mask_carpet() -> Mask:
    return _where(3, 2, lambda r, c: (r, c) != (1, 1))


def mask_menger() -> Mask:
    return _where(3, 3, lambda *c: c.count(1) < 2)


def mask_periodic_tunnels(side: int = 5, tunnel_width: int = 1, tunnel_period: int = 2, tunnel_offset: int = 2) -> Mask:
    """Bands along each axis; a cell in two bands or more is in a tunnel. The offset counts from 1."""
    _whole("side", side, 3)
    _whole("tunnel_width", tunnel_width, 1, side - 1)
    _whole("tunnel_period", tunnel_period, 1)
    _whole("tunnel_offset", tunnel_offset, 1, side - tunnel_width)
    band = {at + d for at in range(tunnel_offset - 1, side - tunnel_width, tunnel_period) for d in range(tunnel_width)}
    return _where(side, 3, lambda *c: sum(x in band for x in c) < 2)


def mask_asymmetric_cavities(side: int = 5, cavity_size: int = 2, pocket_size: int | None = None) -> Mask:
    """A large and a small cube cut out of opposite parts of the inside."""
    pocket_size = max(1, cavity_size - 1) if pocket_size is None else pocket_size
    _whole("side", side, 5)
    _whole("cavity_size", cavity_size, 1, side - 2)
    _whole("pocket_size", pocket_size, 1, side - 2)
    a, b = max(1, side - cavity_size - 1), max(1, side - pocket_size - 1)
    return _without(side, ((1, cavity_size), (a, cavity_size), (1, cavity_size)), ((b, pocket_size), (1, pocket_size), (b, pocket_size)))


def mask_channel_network(side: int = 5, channel_width: int = 1, branch_offset: int = 2) -> Mask:
    """Three channels through the middle, and two branches beside it. The offset counts from 1."""
    _whole("side", side, 5)
    _whole("channel_width", channel_width, 1, side - 1)
    _whole("branch_offset", branch_offset, 2, side - channel_width)
    thin, full = ((side - channel_width) // 2, channel_width), (0, side)
    branch, high = (branch_offset - 1, channel_width), (side - channel_width - 1, channel_width)
    return _without(side, (thin, full, thin), (full, thin, thin), (thin, thin, full), (branch, full, thin), (thin, high, full))


MASKS = {
    "carpet": mask_carpet, "vicsek": lambda: mask_cross(3, 1), "border": mask_border, "cross": mask_cross, "corner": mask_corner, "asymmetric_holes": mask_asymmetric_holes,
    "menger": mask_menger, "periodic_tunnels": mask_periodic_tunnels, "asymmetric_cavities": mask_asymmetric_cavities, "channel_network": mask_channel_network,
}


def mask_cells(spark: SparkSession, masks: dict[str, Mask]) -> DataFrame:
    """mask, c0, c1, c2 (-1 in two dimensions) of each kept cell; one level of each mask."""
    rows = [(name, *c, *([-1] * (3 - m.dims))) for name, m in masks.items() for c in sorted(m.kept)]
    return spark.createDataFrame(rows, "mask string, c0 int, c1 int, c2 int")


def recursive_cells(spark: SparkSession, mask: str | Mask, levels: int) -> tuple[DataFrame, int, int]:
    """Cells all of whose base-b digit tuples are kept."""
    m = MASKS[mask]() if isinstance(mask, str) else mask
    side = m.base**levels
    c = _cells(spark, side, m.dims)
    place = lambda digits: sum(d * m.base ** (m.dims - 1 - k) for k, d in enumerate(digits))
    keep = sorted(map(place, m.kept))
    for level in range(levels):
        c = c.where(place([F.floor(F.col(f"c{k}") / m.base**level) % m.base for k in range(m.dims)]).isin(keep))
    return c, side, m.dims


def recursive_mask_graph(spark: SparkSession, mask: str | Mask, levels: int) -> DataFrame:
    """src, dst over lattice ids."""
    c, side, dims = recursive_cells(spark, mask, levels)
    return cells_edges(c, side, dims)


def occupied_mesh(spark: SparkSession, h: int, w: int, keep: Column) -> DataFrame:
    """Mesh edges between kept cells; ``keep`` is a predicate over i and j."""
    g = _grid(spark, h, w)
    k = g.where(keep)
    return mesh(spark, h, w).join(k.select(F.col("v").alias("src")), "src", "left_semi").join(k.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")


def _block(x: Column, first: int | Column, period: int, size: int, n: int) -> Column:
    """x is in a run of ``size`` places that begins at ``first`` (from 0) or a multiple of ``period`` after it, and that ends within n places."""
    start = x - F.pmod(x - first, F.lit(period)) if size <= period else F.lit(None)
    if size <= period:
        return (x >= first) & (x - start < size) & (start + size <= n)
    last = first + F.floor((F.lit(n - size) - first) / period) * period  # runs overlap: one long run
    return (x >= first) & (x < last + size) & (last >= first)


def keep_periodic_holes(h: int, w: int, hole_period: int = 4, hole_height: int = 1, hole_width: int | None = None, row_offset: int = 2, col_offset: int = 2) -> Column:
    """Predicates over i and j, from 0; offsets count from 1."""
    hole_width = hole_height if hole_width is None else hole_width
    return ~(_block(F.col("i"), row_offset - 1, hole_period, hole_height, h) & _block(F.col("j"), col_offset - 1, hole_period, hole_width, w))


def keep_staggered_windows(h: int, w: int, window_height: int = 1, window_width: int = 2, row_period: int = 4, col_period: int = 5, row_offset: int = 2, col_offset: int = 2) -> Column:
    """Bands of windows; those of every other band are half a period to the right."""
    if window_height > row_period:
        raise ValueError("bands of windows may not overlap")
    odd = F.floor((F.col("i") - (row_offset - 1)) / row_period) % 2 == 1
    rows = _block(F.col("i"), row_offset - 1, row_period, window_height, h)
    cols = F.when(odd, _block(F.col("j"), col_offset - 1 + col_period // 2, col_period, window_width, w)).otherwise(_block(F.col("j"), col_offset - 1, col_period, window_width, w))
    return ~(rows & cols)


def keep_slit_channels(h: int, w: int, orientation: str = "vertical", slit_period: int = 5, slit_width: int = 1, bridge_spacing: int = 4, bridge_size: int = 1, offset: int = 2) -> Column:
    """Slits along one axis, with bridges at its start and every ``bridge_spacing`` places."""
    if orientation not in ("vertical", "horizontal"):
        raise ValueError(f"unknown orientation {orientation!r}")
    along, across, n = ("i", "j", w) if orientation == "vertical" else ("j", "i", h)
    return ~(_block(F.col(across), offset - 1, slit_period, slit_width, n) & (F.col(along) % bridge_spacing >= bridge_size))


def keep_asymmetric_notches(h: int, w: int, notch_depth: int = 3, notch_width: int = 2) -> Column:
    """Cuts from above at a third of the width, from the right at half the height (one wider), and from below at two thirds (one less deep)."""
    box = lambda r0, r1, c0, c1: F.col("i").between(r0 - 1, r1 - 1) & F.col("j").between(c0 - 1, c1 - 1)  # noqa: E731  places from 1
    deep = lambda depth, n: min(max(1, depth), max(1, n - 2))
    left, wide = max(2, w // 3), deep(notch_width, w)
    top = box(1, deep(notch_depth, h), left, min(w - 1, left + wide - 1))
    tall = deep(notch_width + 1, h)
    high = max(2, h // 2 - tall // 2)
    right = box(high, min(h - 1, high + tall - 1), w - deep(notch_depth, w) + 1, w)
    end, wide = min(w - 2, max(2, 2 * w // 3)), min(max(1, notch_width), max(1, w - 3))
    bottom = box(h - deep(notch_depth - 1, h) + 1, h, max(2, end - wide + 1), end)
    return ~(top | right | bottom)


# The slots of simplex masks; each is the copy at that corner, and the triangle's centre the one between the sides' middles.
TRIANGLE, TETRAHEDRON = ("left", "right", "top", "center"), ("base_left", "base_right", "base_back", "apex")


def mask_triangle(missing: str | None = None) -> tuple[str, ...]:
    """Without ``missing`` the classic gasket (no centre), else the bridge: all slots but that corner."""
    if missing is None:
        return TRIANGLE[:3]
    if missing not in TRIANGLE[:3]:
        raise ValueError(f"unknown corner {missing!r}")
    return tuple(s for s in TRIANGLE if s != missing)


def mask_tetrahedron(omit: str | None = None) -> tuple[str, ...]:
    if omit is not None and omit not in TETRAHEDRON:
        raise ValueError(f"unknown corner {omit!r}")
    return tuple(s for s in TETRAHEDRON if s != omit)


def _replicate(spark: SparkSession, corners: list[tuple[float, ...]], levels: int, kept: list[int]) -> DataFrame:
    """Simplex cells by half-scale copies: cell, corner coordinates (rounded to 12 digits, so that copies meet). Copy k is at corner k; the one after the last is turned, between the sides' middles."""
    d = spark.createDataFrame([(0, [list(map(float, c)) for c in corners])], "cell bigint, p array<array<double>>")
    n = len(corners)

    def half(k: int) -> Column:
        middle = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
        return F.array(*(middle(F.get("p", F.lit(q)), F.get("p", F.lit(k if k < n else (q + 1) % n))) for q in range(n)))

    for _ in range(levels):
        d = d.select(F.explode(F.array(*(F.struct((F.col("cell") * (n + 1) + k).alias("cell"), half(k).alias("p")) for k in kept))).alias("x")).select("x.*")
    return d.select("cell", F.transform("p", lambda q: F.transform(q, lambda a: F.bround(a, 12) + F.lit(0.0))).alias("p"))


def simplex_mask_graph(spark: SparkSession, levels: int, slots: tuple[str, ...] | None = None, dims: int = 2) -> Bundle:
    """Triangle (2) or tetrahedron (3), classic or by the slots kept at each level: vertices are distinct corners in coordinate order, edges the sides of the cells."""
    from pyspark.sql import Window

    corners = [(0.0, 0.0), (1.0, 0.0), (0.5, math.sqrt(3) / 2)] if dims == 2 else [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.5, math.sqrt(3) / 2, 0.0), (0.5, math.sqrt(3) / 6, math.sqrt(2 / 3))]
    names = TRIANGLE if dims == 2 else TETRAHEDRON
    slots = slots or (mask_triangle() if dims == 2 else mask_tetrahedron())
    d = _replicate(spark, corners, levels, [names.index(x) for x in slots])
    sides = [(a, b) for a in range(dims + 1) for b in range(a + 1, dims + 1)]
    e = d.select(F.explode(F.array(*(F.struct(F.get("p", F.lit(a)).alias("a"), F.get("p", F.lit(b)).alias("b")) for a, b in sides))).alias("s")).select("s.*")
    v = e.select(F.explode(F.array("a", "b")).alias("x")).distinct().select("x", F.row_number().over(Window.orderBy("x")).cast("bigint").alias("v"))
    e = e.join(v.select(F.col("x").alias("a"), F.col("v").alias("s")), "a").join(v.select(F.col("x").alias("b"), F.col("v").alias("t")), "b").select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).distinct()
    coords = v.select("v", "x")
    return Bundle(lengths_from_coords(e, coords, "none"), coords, f"sierpinski-{dims}", {"levels": levels, "slots": slots})


def sierpinski(spark: SparkSession, levels: int, dims: int = 2) -> Bundle:
    return simplex_mask_graph(spark, levels, None, dims)


def _bundle(edges: DataFrame, coords: DataFrame, family: str, by: str, **attrs) -> Bundle:
    return Bundle(lengths_from_coords(edges, coords, by), coords, family, attrs)


def mesh_surface(spark: SparkSession, h: int, w: int, surface: str = "plane", a: float = 0.5, fu: float = 1.0, fv: float = 1.0, diagonal: bool = False, by: str = "median", keep: Column | None = None) -> Bundle:
    u, v = 2 * F.col("j") / max(1, w - 1) - 1, 2 * F.col("i") / max(1, h - 1) - 1
    g = _grid(spark, h, w) if keep is None else _grid(spark, h, w).where(keep)
    coords = g.select("v", F.array(u.cast("double"), v.cast("double"), V.surface_height(u, v, surface, a, fu, fv).cast("double")).alias("x"))
    e = mesh(spark, h, w, diagonal) if keep is None else occupied_mesh(spark, h, w, keep)
    return _bundle(e, coords, "mesh", by, surface=surface)


def cylinder_surface(spark: SparkSession, h: int, w: int, radius: float = 1.0, height: float = 2.0, mode: str = "standard", a: float = 0.2, ft: float = 3.0, fz: float = 1.0, twist: float = 0.0, by: str = "median") -> Bundle:
    t, s = 2 * math.pi * F.col("j") / w, F.lit(1.0) - 2 * F.col("i") / max(1, h - 1)
    r = {"standard": F.lit(radius), "barrel": radius * (1 + a * (1 - s * s)), "hourglass": radius * (1 - a * (1 - s * s)), "wavy": radius * (1 + a * F.sin(ft * t) * F.cos(math.pi * fz * s))}[mode]
    coords = _grid(spark, h, w).select("v", F.array(r * F.cos(t + twist * s), r * F.sin(t + twist * s), height / 2 * s).alias("x"))
    return _bundle(cylinder(spark, h, w), coords, "cylinder", by, mode=mode)


def torus_surface(spark: SparkSession, h: int, w: int, big: float = 2.0, small: float = 0.7, mode: str = "standard", a: float = 0.2, f_major: float = 3.0, f_minor: float = 2.0, twist: float = 0.0, by: str = "median") -> Bundle:
    t, p = 2 * math.pi * F.col("j") / w, 2 * math.pi * F.col("i") / h
    rho = {"standard": F.lit(small), "pinched": small * (1 - a * F.cos(t)), "wavy": small * (1 + a * F.sin(f_major * t) * F.cos(f_minor * p))}[mode]
    q = p + twist * F.sin(f_major * t)
    ring = big + rho * F.cos(q)
    coords = _grid(spark, h, w).select("v", F.array(ring * F.cos(t), ring * F.sin(t), rho * F.sin(q)).alias("x"))
    return _bundle(torus(spark, h, w), coords, "torus", by, mode=mode)


def sphere_surface(spark: SparkSession, h: int, w: int, radius: float = 1.0, mode: str = "standard", a: float = 0.2, ft: float = 3.0, fl: float = 1.0, twist: float = 0.0, by: str = "median") -> Bundle:
    last = 2 + (h - 2) * w
    c = _grid(spark, h - 2, w).select((F.col("v") + 1).alias("v"), (math.pi / 2 - math.pi * (F.col("i") + 1) / (h - 1)).alias("lat"), (2 * math.pi * F.col("j") / w).alias("t"))
    c = c.union(spark.createDataFrame([(1, math.pi / 2, 0.0), (last, -math.pi / 2, 0.0)], "v bigint, lat double, t double"))
    lat, t = F.col("lat"), F.col("t") + twist * F.sin(2 * F.col("lat"))
    r = radius * (1 + a * F.cos(lat) ** 2 * F.sin(ft * F.col("t")) * F.cos(fl * lat)) if mode == "wavy" else F.lit(radius)
    rx, rz = (r * (1 + a), r * (1 - a)) if mode == "ellipsoid" else (r, r)
    coords = c.select("v", F.array(rx * F.cos(lat) * F.cos(t), rx * F.cos(lat) * F.sin(t), rz * F.sin(lat)).alias("x"))
    return _bundle(sphere(spark, h, w), coords, "sphere", by, mode=mode)


def lattice_coords(cells: DataFrame, side: int, dims: int, mode: str = "plain", a: float = 0.2, f: float = 1.0, twist: float = 0.5) -> DataFrame:
    """Cell centres in [-1, 1]^dims, bulged, twisted about the last axis or wavy."""
    p = [2 * (F.col(f"c{k}") + 0.5) / side - 1 for k in range(dims)]
    if mode == "bulged":
        s = 1 + a * sum((q * q for q in p), F.lit(0.0))
        p = [q * s for q in p]
    elif mode == "twisted" and dims == 3:
        t = twist * p[2]
        p = [p[0] * F.cos(t) - p[1] * F.sin(t), p[0] * F.sin(t) + p[1] * F.cos(t), p[2]]
    elif mode == "wavy":
        s = [a * F.sin(math.pi * f * p[(k + 1) % dims]) * F.cos(math.pi * f * p[(k + 2) % dims]) for k in range(dims)]
        p = [q + d for q, d in zip(p, s, strict=True)]
    return cells.select("v", F.array(*(q.cast("double") for q in p)).alias("x"))


def recursive_mask_surface(spark: SparkSession, mask: str | Mask, levels: int, mode: str = "plain", by: str = "median", **kw) -> Bundle:
    c, side, dims = recursive_cells(spark, mask, levels)
    return _bundle(cells_edges(c, side, dims), lattice_coords(c, side, dims, mode, **kw), str(mask), by, levels=levels)


def irregular_points(spark: SparkSession, family: str, n: int, seed: int = 1, small: float = 0.6, big: float = 2.0, a: float = 0.3) -> DataFrame:
    """v, x: points of a surface or solid from four hashed draws a vertex, uniform by area or volume but for the tori (uniform in their angles) and the pants (in their legs)."""
    d = spark.range(1, n + 1).withColumnRenamed("id", "v").select("v", *(V.hashed_draw(F.col("v"), k, seed).alias(f"u{k}") for k in range(4)))
    u, t, p, z = F.col("u0"), 2 * math.pi * F.col("u1"), 2 * math.pi * F.col("u2"), 2 * F.col("u3") - 1
    flat = F.sqrt(1 - z * z)
    ball = (flat * F.cos(t), flat * F.sin(t), z)
    times = lambda r: tuple(r * c for c in ball)
    ring = lambda cx: (F.lit(cx) + (big + small * F.cos(p)) * F.cos(t), (big + small * F.cos(p)) * F.sin(t), small * F.sin(p))
    either = lambda x, y: tuple(F.when(F.col("v") % 2 == 0, i).otherwise(j) for i, j in zip(x, y, strict=True))
    arm, rad = F.col("v") % 3 * (2 * math.pi / 3), F.sqrt(0.25 + 0.75 * u)
    x = {
        "rectangle": (2 * u - 1, z, a * F.sin(math.pi * u) * F.cos(math.pi * z)),
        "annulus": (rad * F.cos(t), rad * F.sin(t), 0 * u),
        "sphere": ball,
        "torus": ring(0.0),
        "double_torus": either(ring(-big), ring(big)),
        "pair_of_pants": (2 * u * F.cos(arm) - 0.5 * F.cos(t) * F.sin(arm), 2 * u * F.sin(arm) + 0.5 * F.cos(t) * F.cos(arm), 0.5 * F.sin(t)),
        "ball": times(F.cbrt(u)),
        "shell": times(F.cbrt(0.125 + 0.875 * u)),
    }
    if family not in x:
        raise ValueError(f"unknown family {family!r}")
    return d.select("v", F.array(*(c.cast("double") for c in x[family])).alias("x"))


def irregular(spark: SparkSession, family: str, n: int, k: int = 6, seed: int = 1, by: str = "median", **kw) -> Bundle:
    """``irregular_points`` and their connected kNN graph."""
    from meshlark.operators.knn import connected_knn_graph
    from meshlark.plans.shared import materialize

    coords = materialize(irregular_points(spark, family, n, seed, **kw), "points")
    e = connected_knn_graph(coords, k, "euclid").select("src", "dst")
    return _bundle(e, coords, f"irregular-{family}", by, n=n, k=k)


def sampled_points(spark: SparkSession, n: int, seed: int = 1, surface: str = "saddle", a: float = 0.5) -> DataFrame:
    """v, x: uniform points by hash on the rectangle, lifted to the surface."""
    unit = lambda k: 2 * V.hashed_draw(F.col("id"), k, seed) - 1
    return spark.range(1, n + 1).select(F.col("id").alias("v"), unit(1).alias("u"), unit(2).alias("t")).select("v", F.array("u", "t", V.surface_height(F.col("u"), F.col("t"), surface, a)).alias("x"))


def sampled_rectangles(spark: SparkSession, n: int, ks: list[int], seed: int = 1, surface: str = "saddle", a: float = 0.5, prune: float | None = None) -> list[Bundle]:
    """kNN sets and the overlap graph of those for several k. The points are drawn, and the neighbours of the greatest k sought, once."""
    from meshlark.operators.knn import knn, overlap_graph, prune_geometric
    from meshlark.plans.shared import materialize

    if not ks or len(set(ks)) != len(ks) or min(ks) < 1:
        raise ValueError("the numbers of neighbours are distinct and at least 1")
    coords = materialize(sampled_points(spark, n, seed, surface, a), "points")
    near = materialize(knn(coords, max(ks), "euclid"), "near")
    out = []
    for k in ks:
        e = overlap_graph(near.where(F.col("rank") <= k)).select("src", "dst", "w")
        out.append(Bundle(prune_geometric(e, prune) if prune is not None else e, coords, "sampled-rectangle", {"n": n, "k": k}))
    return out


def sampled_rectangle(spark: SparkSession, n: int, k: int, seed: int = 1, surface: str = "saddle", a: float = 0.5, prune: float | None = None) -> Bundle:
    return sampled_rectangles(spark, n, [k], seed, surface, a, prune)[0]


def deduplicate_coordinates(edges: DataFrame, coords: DataFrame, digits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Vertices at equal coordinates (to ``digits``, without negative zero) become the smallest of them."""
    c = coords.withColumn("key", F.transform("x", lambda a: F.bround(a, digits) + F.lit(0.0)))
    m = c.join(c.groupBy("key").agg(F.min("v").alias("to")), "key").select("v", "to", F.col("key").alias("x"))
    e = edges.join(m.select(F.col("v").alias("src"), F.col("to").alias("s")), "src").join(m.select(F.col("v").alias("dst"), F.col("to").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return canonical(e), m.where("v = to").select("v", "x")
