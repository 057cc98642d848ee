"""Vectors, histograms and points as Column expressions: sums, distances, kernels, rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)


def scaled_to_one(x: Column) -> Column:
    """x divided by its sum."""
    return F.element_at(F.transform(F.array(x), lambda v: F.element_at(F.transform(F.array(total(v)), lambda s: F.transform(v, lambda e: e / s)), 1)), 1)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def cityblock(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def chi_square(x: Column, y: Column) -> Column:
    """Half the sum of (x - y)^2 / (x + y); a bin that is empty in both adds 0."""
    return total(F.zip_with(x, y, lambda a, b: F.when(a + b == 0, 0.0).otherwise((a - b) * (a - b) / F.when(a + b != 0, a + b)))) / 2


def kullback_leibler(x: Column, y: Column) -> Column:
    """Sum of x ln(x / y) - x + y: y where x is 0, infinite where only y is 0."""
    inf = F.lit(float("inf"))
    return total(F.zip_with(x, y, lambda a, b: F.when(a == 0, b).when(b == 0, inf).otherwise(a * F.ln(a / F.when(b != 0, b)) - a + b)))


def symmetric_kl(x: Column, y: Column, smooth: float = 1e-6) -> Column:
    """Mean over bins of (x - y) ln(x / y), both smoothed and scaled to one."""
    spread = lambda v: scaled_to_one(F.transform(v, lambda e: e + smooth))
    return total(F.zip_with(spread(x), spread(y), lambda a, b: (a - b) * F.ln(a / b))) / F.size(x)


def jensen_shannon(x: Column, y: Column) -> Column:
    """Square root of the Jensen-Shannon distance of x and y, both scaled to one: the fourth root of their divergence."""
    part = lambda a, m: F.when(a > 0, a * F.ln(a / F.when(m > 0, m))).otherwise(0.0)
    both = F.zip_with(scaled_to_one(x), scaled_to_one(y), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.pow(F.greatest(F.lit(0.0), total(both) / 2), 0.25)


def kolmogorov_smirnov(x: Column, y: Column) -> Column:
    """Largest distance of the running sums."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("most"))
    step = lambda a, d: F.struct((a["run"] + d).alias("run"), F.greatest(a["most"], F.abs(a["run"] + d)).alias("most"))
    return F.aggregate(F.zip_with(x, y, lambda a, b: a - b), start, step)["most"]


def histogram_intersection(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.least(a, b)))


def laplacian(x: Column, y: Column, gamma: float | None = None) -> Column:
    """exp(-gamma * cityblock), gamma 1 / length unless given."""
    return F.exp(-cityblock(x, y) * (F.lit(gamma) if gamma else 1 / F.size(x)))


def gaussian(x: Column, y: Column, gamma: float | None = None) -> Column:
    d = euclidean(x, y)
    return F.exp(-d * d * (F.lit(gamma) if gamma else 1 / F.size(x)))


def combined_kernel(hx: Column, hy: Column, sx: Column, sy: Column) -> Column:
    """Histogram intersection of one part and the Laplacian of the other."""
    return histogram_intersection(hx, hy) + laplacian(sx, sy)


def composite(parts: list[Column], weights: list[float] | None = None, root: bool = False) -> Column:
    """Weighted sum of distances, or the root of their squares."""
    out = [p * p if root else p * w for p, w in zip(parts, weights or [1.0] * len(parts), strict=True)]
    s = out[0]
    for p in out[1:]:
        s = s + p
    return F.sqrt(s) if root else s


#: Distances and kernels by name; callers may add their own (Column, Column) -> Column.
DISTANCES = {"l2": euclidean, "l1": cityblock, "chi2": chi_square, "kl": kullback_leibler, "symkl": symmetric_kl, "js": jensen_shannon, "ks": kolmogorov_smirnov, "hist": histogram_intersection, "laplace": laplacian, "rbf": gaussian}


def point_key(x: Column, y: Column, z: Column) -> Column:
    """A point in hundredths, rounded half-even as binary numbers, to match it across meshes."""
    return F.struct(*((F.rint(c * 100) / 100 + 0.0).alias(k) for c, k in ((x, "x"), (y, "y"), (z, "z"))))


def rotation(angle: float | Column, axis: tuple[float, float, float]) -> list[list[Column]]:
    """Rotation about a unit axis as rows of Columns (Rodrigues)."""
    a = F.lit(angle) if isinstance(angle, int | float) else angle
    c, s, (x, y, z) = F.cos(a), F.sin(a), axis
    return [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]


def to_polar(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(radius, azimuth, elevation from the z axis)."""
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.atan2(y, x), F.acos(z / r)


def to_cartesian(r: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    return r * F.sin(elevation) * F.cos(azimuth), r * F.sin(elevation) * F.sin(azimuth), r * F.cos(elevation)


def modulus(z: Column) -> Column:
    """Absolute values of an array of structs (re, im)."""
    return F.transform(z, lambda e: F.hypot(e["re"], e["im"]))
