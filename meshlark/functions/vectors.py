"""Column expressions over coordinate arrays: distances, angles, projections, potentials."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(x: Column | str) -> Column:
    return F.transform(_col(x), lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a * b))


def minus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a - b)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def euclid(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b))))


def linf(x: Column | str, y: Column | str) -> Column:
    return F.array_max(F.zip_with(_col(x), _col(y), lambda a, b: F.abs(a - b)))


def soft_length(x: Column | str, y: Column | str, eps: float = 1e-8) -> Column:
    d = euclid(x, y)
    return F.sqrt(d * d + F.lit(eps * eps))


def angle(x: Column | str, y: Column | str) -> Column:
    """Angle between two vectors, null if one has no length."""
    d = norm(x) * norm(y)
    return F.when(d > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(x, y) / d))))


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    ax, ay, bx, by, cx, cy = map(_col, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(p: tuple, q: tuple, r: tuple, s: tuple, tol: float = 1e-12) -> Column:
    """Whether the open segments pq and rs cross strictly; collinear ends never do."""
    o = [orientation(*a, *b, *c) for a, b, c in ((p, q, r), (p, q, s), (r, s, p), (r, s, q))]
    clear = F.lit(True)
    for x in o:
        clear = clear & (F.abs(x) > tol)
    return clear & ((o[0] > 0) != (o[1] > 0)) & ((o[2] > 0) != (o[3] > 0))


def project_3d(x, y, z, azimuth: float = 35.0, elevation: float = 22.0) -> tuple[Column, Column]:
    """The first two coordinates after a turn about z by the azimuth and then about x by the elevation (degrees)."""
    x, y, z = map(_col, (x, y, z))
    ca, sa, ce, se = (f(math.radians(a)) for a in (azimuth, elevation) for f in (math.cos, math.sin))
    turned = x * -sa + y * ca
    return x * ca + y * sa, turned * ce + z * se


def edge_potential(length: Column, target: Column, kind: str = "quadratic", beta: float = 1.0, eps_plus: float = 0.5) -> Column:
    s = length / target
    if kind == "quadratic":
        return 0.5 * (s - 1) * (s - 1)
    if kind != "upper_barrier":
        raise ValueError(f"unknown potential {kind!r}")
    u = (s - 1) / eps_plus
    return 0.5 * (s - 1) * (s - 1) + F.when(u >= 1 - 1e-10, F.lit(float("inf"))).when(u > 0, beta * (-F.log1p(-u) - u)).otherwise(F.lit(0.0))


def repulsion_potential(distance: Column, delta: float = 1e-3, power: float = 0.0) -> Column:
    r2 = distance * distance + delta * delta
    return -0.5 * F.log(r2) if power == 0 else F.pow(r2, F.lit(-power / 2))


def stiffness(x: Column, kind: str = "identity") -> Column:
    x = F.greatest(x, F.lit(0.0))
    return {"identity": x, "sqrt": F.sqrt(x), "log1p": F.log1p(x)}[kind]


def surface_height(u: Column, v: Column, kind: str, a: float, fu: float = 1.0, fv: float = 1.0) -> Column:
    return {
        "plane": F.lit(0.0) * u,
        "saddle": a * (u * u - v * v),
        "paraboloid": a * (u * u + v * v),
        "ripple": a * F.sin(F.lit(math.pi * fu) * u) * F.cos(F.lit(math.pi * fv) * v),
    }[kind]


def hashed_draw(v: Column, k: int, seed: int = 1) -> Column:
    """A number from 0 to below 1 that depends on an integer alone: multiplications and shifts modulo 2^32, as any SQL engine has them."""
    m = F.lit(1 << 32)
    mix = lambda h: F.pmod(h.bitwiseXOR(F.shiftrightunsigned(h, 16)) * F.lit(73244475), m)
    h = mix(mix(F.pmod(v.cast("bigint") * F.lit(1103515245) + F.lit(k * 362437 + seed * 8675309), m)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16)) / float(1 << 32)
