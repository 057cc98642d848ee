"""Spherical harmonics of meshes: radius per direction, coefficients, and the surface they describe.

Directions are (dir_id, azimuth, elevation), elevation from the z axis. Seen from a mesh's centre, triangles and
directions lie in buckets of the sphere; both meet by an equi-join on the bucket, so that a ray is only tested with the
triangles whose outline reaches its bucket. The directions' table is a parameter's size and broadcast behind a check of
its rows; meshes never move but to meet their faces. Coefficients are summed where a mesh's triangles lie: of its radii,
one a direction, none is written or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_sort, once, spread
from ..functions.vectors import dot, to_cartesian
from ..storage import join_counted, materialize
from .mesh import bounding_boxes
from .rays import triangles

#: Slack of the buckets' borders, and relative slack of the crossing test.
SLACK, EDGE = 1e-7, 1e-9
#: Most directions of which a task keeps a mesh's radii, triangles it meets with them at a time, and radii it sums at once.
HELD, STEP, ROOM = 1 << 16, 256, 1 << 19


def basis_terms(l: int, m: int) -> tuple[list[float], float]:  # noqa: E741
    """(coefficients, scale): the harmonic of degree l and order m is scale times the polynomial in the cosine of the
    elevation, highest power first, times the |m|-th power of its sine, times the cosine or sine of |m| azimuths."""
    k = abs(m)
    legendre = np.polynomial.legendre.leg2poly([0] * l + [1])
    scale = (-1) ** k * math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k)) * (math.sqrt(2) if m else 1)
    return [float(c) for c in np.polynomial.polynomial.polyder(legendre, k)[::-1]], scale


def basis_value(l: int, m: int, azimuth: Column, elevation: Column) -> Column:  # noqa: E741
    """Real harmonic of degree l and order m: the root of two times the real part for m > 0, the imaginary part for m < 0."""
    k = abs(m)
    terms, scale = basis_terms(l, m)
    x, out = F.cos(elevation), F.lit(0.0)
    for c in terms:
        out = out * x + c
    turn = F.cos(k * azimuth) if m > 0 else F.sin(k * azimuth) if m < 0 else F.lit(1.0)
    return out * F.pow(F.sin(elevation), F.lit(k)) * turn * scale


def basis(degrees: int, azimuth: Column, elevation: Column) -> Column:
    """All harmonics of degrees 0 to degrees - 1, by degree and order, as an array."""
    return F.array(*(basis_value(d, m, azimuth, elevation) for d in range(degrees) for m in range(-d, d + 1)))


def basis_table(degrees: int, azimuth: np.ndarray, elevation: np.ndarray) -> np.ndarray:
    """``basis`` in numpy, a row a direction."""
    out = []
    for d in range(degrees):
        for m in range(-d, d + 1):
            terms, scale = basis_terms(d, m)
            turn = np.cos(m * azimuth) if m > 0 else np.sin(-m * azimuth) if m < 0 else 1.0
            out.append(np.polyval(terms, np.cos(elevation)) * np.sin(elevation) ** abs(m) * turn * scale)
    return np.stack(out, axis=1)


def sphere_sample(spark: SparkSession, side: int = 100, seed: int = 0) -> DataFrame:
    """(dir_id, azimuth, elevation): side x side directions, one at random in each of as many equal parts of the sphere."""
    md5 = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}")).cast("binary"))
    jitter = lambda k: F.conv(F.substring(md5, 8 * k + 1, 8), 16, 10).cast("long") / (1 << 32)
    x, y = (F.floor(F.col("id") / side) + jitter(0)) / side, (F.col("id") % side + jitter(1)) / side
    return spark.range(side * side).select(F.col("id").alias("dir_id"), (2 * math.pi * y).alias("azimuth"), (2 * F.acos(F.sqrt(1 - x))).alias("elevation"))


def _azimuth_bucket(azimuth: Column, e: int) -> Column:
    return F.floor(azimuth * (e / math.pi)).cast("int")


def _height_bucket(z: Column, e: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(e - 1), F.floor((z + 1) * (e / 2)).cast("int")))


def direction_buckets(directions: DataFrame, e: int) -> DataFrame:
    """(dir_id, bucket, dx, dy, dz): unit vectors in 2 e parts of the azimuth times e of the height, all of one area."""
    d = to_cartesian(F.lit(1.0), F.col("azimuth"), F.col("elevation"))
    v = directions.select("dir_id", *(c.alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)))
    return v.withColumn("bucket", F.pmod(_azimuth_bucket(F.atan2("dy", "dx"), e), F.lit(2 * e)) * e + _height_bucket(F.col("dz"), e))


def triangle_ranges(seen: DataFrame, e: int) -> DataFrame:
    """seen (a0 .. c2: a triangle's corners from the centre) with ``first`` to ``last``, parts of the azimuth, and ``bottom`` to
    ``top``, parts of the height, that its outline may reach; the azimuths' may run over a whole turn's end.

    A triangle's heights end at corners or at the top or bottom of an edge's arc, or at the pole if that is inside; its
    azimuths, less than half a turn, end at corners, and are all of them if a pole is inside or on the border. Triangles
    in a plane with the centre reach none.
    """
    p = [[F.col(f"{c}{k}") for k in range(3)] for c in "abc"]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = [F.sqrt(sum((x * x for x in q), F.lit(0.0))) for q in p]
    seen = once(seen, {f"s{c}": s for s, c in zip(size, "abc", strict=True)})
    seen = seen.filter((F.col("sa") > 0) & (F.col("sb") > 0) & (F.col("sc") > 0))
    p = [[F.try_divide(x, F.col(f"s{c}")) for x in q] for q, c in zip(p, "abc", strict=True)]
    seen = once(seen, {f"u{c}{k}": x for q, c in zip(p, "abc", strict=True) for k, x in enumerate(q)})
    p = [[F.col(f"u{c}{k}") for k in range(3)] for c in "abc"]
    arcs = [(q, p[(i + 1) % 3], cross(q, p[(i + 1) % 3])) for i, q in enumerate(p)]
    det = F.col("ua0") * arcs[1][2][0] + F.col("ua1") * arcs[1][2][1] + F.col("ua2") * arcs[1][2][2]
    seen = once(seen, {"det": det}).filter(F.abs("det") > 1e-14).withColumn("side", F.signum("det"))
    around = [n[2] * F.col("side") for _, _, n in arcs]
    up = F.least(*around) >= -SLACK
    down = F.greatest(*around) <= SLACK
    high, low = [q[2] for q in p], [q[2] for q in p]
    for a, b, n in arcs:
        top = F.try_divide(F.sqrt(n[0] * n[0] + n[1] * n[1]), F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]))
        start, end = n[0] * a[1] - n[1] * a[0], n[1] * b[0] - n[0] * b[1]
        high.append(F.when((start > 0) & (end > 0), top).otherwise(-1.0))
        low.append(F.when((start < 0) & (end < 0), -top).otherwise(1.0))
    seen = seen.withColumns({"up": up, "down": down, "high": F.greatest(*high), "low": F.least(*low), "from": F.atan2("ua1", "ua0")})
    turn = [F.pmod(F.atan2(q[1], q[0]) - F.col("from") + math.pi, F.lit(2 * math.pi)) - math.pi for q in p[1:]]
    seen = seen.withColumns({"least": F.least(F.lit(0.0), *turn) - SLACK + F.col("from"), "most": F.greatest(F.lit(0.0), *turn) + SLACK + F.col("from")})
    all_around = F.col("up") | F.col("down")
    first = F.when(all_around, 0).otherwise(_azimuth_bucket(F.col("least"), e))
    last = F.when(all_around, 2 * e - 1).otherwise(F.least(_azimuth_bucket(F.col("most"), e), first + 2 * e - 1))
    bottom = F.when(F.col("down"), 0).otherwise(_height_bucket(F.col("low") - SLACK, e))
    top = F.when(F.col("up"), e - 1).otherwise(_height_bucket(F.col("high") + SLACK, e))
    return seen.withColumns({"first": first, "last": last, "bottom": bottom, "top": top})


def triangle_buckets(seen: DataFrame, e: int) -> DataFrame:
    """seen with ``bucket``, a row for each of ``triangle_ranges``."""
    seen = triangle_ranges(seen, e)
    seen = seen.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("j", F.explode(F.sequence("bottom", "top")))
    return seen.withColumn("bucket", F.pmod("i", F.lit(2 * e)) * e + F.col("j"))


#: A triangle as four planes, see ``ray_candidates``.
PLANES = [f"{c}{k}" for c in "fghk" for k in range(3)]


def _seen(tri: DataFrame) -> DataFrame:
    """tri (mesh_id, p0, p1, p2, o: the centre) as corners a0 .. c2 from there, planes and ``far``."""
    seen = once(tri, {f"{n}{k}": F.col(f"p{i}.{c}") - F.col(f"o.{c}") for i, n in enumerate("abc") for k, c in enumerate("xyz")})
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    p = [[F.col(f"{n}{k}") for k in range(3)] for n in "abc"]
    n = cross(*([x - y for x, y in zip(p[i], p[0], strict=True)] for i in (1, 2)))
    seen = once(seen, {f"n{k}": c for k, c in enumerate(n)})
    n = [F.col(f"n{k}") for k in range(3)]
    up = sum((x * y for x, y in zip(p[0], n, strict=True)), F.lit(0.0))
    size = F.signum(up) * F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    edges = {f"{g}{k}": F.try_divide(x + EDGE * n[k], size) for g, i, j in (("g", 0, 1), ("h", 1, 2), ("k", 2, 0)) for k, x in enumerate(cross(p[i], p[j]))}
    return once(seen, {"size": size}).filter("size <> 0").select("mesh_id", *(f"{c}{k}" for c in "abc" for k in range(3)), *(c.alias(k) for k, c in edges.items()), *((F.col(f"n{k}") / F.col("size")).alias(f"f{k}") for k in range(3)), (up / F.col("size")).alias("far"))


def _middles(vertices: DataFrame) -> DataFrame:
    middle = F.struct(*(((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(c) for c in "xyz"))
    return bounding_boxes(vertices).select("mesh_id", middle.alias("o"))


def ray_candidates(vertices: DataFrame, faces: DataFrame, directions: DataFrame, centres: DataFrame, e: int | None = None) -> DataFrame:
    """(mesh_id, planes, dir_id, dx, dy, dz): each triangle with each direction of the buckets it reaches.

    A triangle is four planes, facing it from the centre: a direction d meets it if d . f is above ``EDGE`` and d . g, d . h and d . k
    aren't negative, at ``f`` . d = ``far`` from the centre. Those on an edge, within ``EDGE``, meet both its triangles.
    Without ``e`` a bucket has about 4 of evenly spread directions. Triangles, not meshes, are dealt to the tasks.
    """
    e = e or max(2, round(math.sqrt(directions.count() / 8)))
    tri = spread(triangles(vertices, faces).join(by_sort(centres), "mesh_id"), "mesh_id", "face_id")
    return join_counted(triangle_buckets(_seen(tri), e).select("mesh_id", *PLANES, "far", "bucket"), direction_buckets(directions, e), "bucket").drop("bucket")


def radii(vertices: DataFrame, faces: DataFrame, directions: DataFrame, centres: DataFrame | None = None, e: int | None = None) -> DataFrame:
    """(mesh_id, dir_id, r): from the mesh's centre to its nearest crossing; the mean of the others where there's none.

    ``centres`` (mesh_id, o: struct) defaults to the bounding boxes' centres. A mesh that no ray crosses has no rows. The
    rows are written once, and only meshes that lack some direction are filled up.
    """
    if centres is None:
        centres = _middles(vertices)
    along = lambda f: F.col(f"{f}0") * F.col("dx") + F.col(f"{f}1") * F.col("dy") + F.col(f"{f}2") * F.col("dz")
    hit = ray_candidates(vertices, faces, directions, centres, e).filter((along("f") > EDGE) & (along("g") >= 0) & (along("h") >= 0) & (along("k") >= 0))
    near = hit.groupBy("mesh_id", "dir_id").agg(F.min(F.try_divide(F.col("far"), along("f"))).alias("r"))
    near = materialize(near)
    mean = near.groupBy("mesh_id").agg(F.avg("r").alias("mean"), F.count("*").alias("n"))
    lacking = mean.filter(F.col("n") < directions.count()).crossJoin(F.broadcast(directions.select("dir_id")))
    return near.unionByName(lacking.join(by_sort(near), ["mesh_id", "dir_id"], "left_anti").select("mesh_id", "dir_id", F.col("mean").alias("r")))


class _Directions:
    """Directions by bucket: of one part of the azimuth, those of a range of heights lie side by side."""

    def __init__(self, azimuth: np.ndarray, elevation: np.ndarray, degrees: int, e: int):
        d = np.stack([np.sin(elevation) * np.cos(azimuth), np.sin(elevation) * np.sin(azimuth), np.cos(elevation)])
        self.e, self.high = e, 8 * e
        bucket = np.floor(np.arctan2(d[1], d[0]) * (e / math.pi)).astype(np.int64) % (2 * e) * self.high + self._height(d[2])
        order = np.argsort(bucket, kind="stable")
        self.d, self.start = d[:, order], np.searchsorted(bucket[order], np.arange(2 * e * self.high + 1))
        self.basis = basis_table(degrees, azimuth[order], elevation[order]) * (4 * math.pi / len(order))
        middle = (np.arange(2 * e) + 0.5) * (math.pi / e)
        self.cos, self.sin, self.half = np.cos(middle), np.sin(middle), math.pi / (2 * e)

    def _height(self, z: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((z + 1) * (self.high / 2)).astype(np.int64), 0, self.high - 1)

    def _heights(self, planes: np.ndarray, t: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest height that triangles t may have in parts of the azimuth: where z / |(x, y)| fits their edges."""
        low, high = np.full(len(t), -np.inf), np.full(len(t), np.inf)
        cos, sin = self.cos[turn], self.sin[turn]
        for plane in (3, 6, 9):
            x, y, z = (planes[plane + k][t] for k in range(3))
            at, slope = x * cos + y * sin, y * cos - x * sin
            most = np.maximum(at, at * math.cos(self.half)) + np.abs(slope) * math.sin(self.half) + SLACK * (np.abs(x) + np.abs(y) + np.abs(z))
            with np.errstate(divide="ignore", invalid="ignore"):
                end = -most / z
            low = np.where(z > 0, np.maximum(low, end), low)
            high = np.where(z < 0, np.minimum(high, end), np.where((z == 0) & (most < 0), -np.inf, high))
        return tuple(np.sign(c) / np.sqrt(1 + 1 / np.maximum(np.abs(c), 1e-300) ** 2) for c in (low, high))

    def meet(self, first: np.ndarray, last: np.ndarray, planes: np.ndarray, mesh: np.ndarray, radii: np.ndarray) -> None:
        """Lowers radii (mesh, direction) to the crossings with some triangles."""
        turns = last - first + 1
        t = np.repeat(np.arange(len(mesh)), turns)
        turn = (first[t] + np.arange(len(t)) - np.repeat(np.cumsum(turns) - turns, turns)) % (2 * self.e)
        low, high = self._heights(planes, t, turn)
        keep = np.flatnonzero(low <= high + 2 * SLACK)
        t, turn, low, high = t[keep], turn[keep], low[keep], high[keep]
        start = self.start[turn * self.high + self._height(low - SLACK)]
        size = self.start[turn * self.high + self._height(high + SLACK) + 1] - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        t = np.repeat(t, size)
        for plane in (3, 6, 9):
            keep = np.flatnonzero(sum(planes[plane + k][t] * self.d[k][at] for k in range(3)) >= 0)
            t, at = t[keep], at[keep]
        along = sum(planes[k][t] * self.d[k][at] for k in range(3))
        t, at, along = (x[along > EDGE] for x in (t, at, along))
        np.minimum.at(radii.reshape(-1), mesh[t] * radii.shape[1] + at, planes[12][t] / along)

    def sums(self, radii: np.ndarray) -> np.ndarray:
        """Coefficients of meshes that some ray crosses; a direction without a crossing has the mean of the others."""
        real = np.isfinite(radii)
        mean = np.where(real, radii, 0).sum(axis=1) / real.sum(axis=1)
        return np.where(real, radii, mean[:, None]) @ self.basis


def _summed(found: _Directions) -> Callable:
    """Batches of triangles, a mesh's side by side -> (mesh_id, coefficients). Radii of the mesh at hand, and of some that are
    over, are held."""

    def rows(over: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, radii = pa.concat_arrays([x for x, _ in over]), np.concatenate([x for _, x in over])
        over.clear()
        any_ = np.isfinite(radii).any(axis=1)
        sums = found.sums(radii[any_])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(any_)), lists], ["mesh_id", "coefficients"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, over = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                few = batch.slice(at, STEP)
                ids = few.column("mesh_id")
                new = np.append(True, pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))
                mesh, begin = np.cumsum(new) - 1, np.flatnonzero(new)
                radii = np.full((len(begin), found.d.shape[1]), np.inf)
                if last is not None and last[0].equals(ids[0]):
                    radii[0] = held
                elif last is not None:
                    over.append((last, held[None]))
                number = lambda names: np.stack([few.column(c).to_numpy(zero_copy_only=False) for c in names])  # noqa: B023, E731
                found.meet(*number(["first", "last"]).astype(np.int64), number([*PLANES, "far"]), mesh, radii)
                over.append((ids.take(pa.array(begin[:-1])), radii[:-1]))
                last, held = ids.take(pa.array(begin[-1:])), radii[-1].copy()
                if sum(x.size for _, x in over) >= ROOM:
                    yield from rows(over)
        if last is not None:
            yield from rows([*over, (last, held[None])])

    return step


def coefficients(vertices: DataFrame, faces: DataFrame, directions: DataFrame, degrees: int = 10, centres: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """(mesh_id, coefficients): 4 pi / N times the sum of radius times harmonic over the N directions.

    Up to ``held`` directions, a task goes through its meshes' triangles and keeps the radii of one mesh; beyond, radii are
    rows (``radii``).
    """
    many = directions.count()
    if many <= held:
        az, el = np.array(directions.select("azimuth", "elevation").collect(), float).reshape(-1, 2).T  # a parameter
        e = max(2, round(math.sqrt(many / 8)))
        tri = spread(triangles(vertices, faces).join(by_sort(_middles(vertices) if centres is None else centres), "mesh_id"), "mesh_id").sortWithinPartitions("mesh_id")
        seen = triangle_ranges(_seen(tri), e).select("mesh_id", *PLANES, "far", "first", "last")
        kind = seen.schema["mesh_id"].dataType
        step = _summed(_Directions(az, el, degrees, e))
        return seen.mapInArrow(step, f"mesh_id {kind.simpleString()}, coefficients array<double>")
    table = directions.select("dir_id", basis(degrees, F.col("azimuth"), F.col("elevation")).alias("b"))
    each = join_counted(radii(vertices, faces, directions, centres), table, "dir_id")
    total = [F.sum(F.col("r") * F.get("b", F.lit(i))).alias(f"s{i}") for i in range(degrees * degrees)]
    sums = each.groupBy("mesh_id").agg(F.count("*").alias("n"), *total)
    return sums.select("mesh_id", F.array(*(F.col(f"s{i}") * (4 * math.pi) / F.col("n") for i in range(degrees * degrees))).alias("coefficients"))


def surface(coeffs: DataFrame, directions: DataFrame, degrees: int = 10) -> DataFrame:
    """(mesh_id, dir_id, r): the radius that the coefficients describe in each direction, at most 2^20 of them."""
    if directions.count() > 1 << 20:
        raise ValueError("at most 2^20 directions")
    table = directions.select("dir_id", basis(degrees, F.col("azimuth"), F.col("elevation")).alias("b"))
    return coeffs.join(F.broadcast(table), F.lit(True)).select("mesh_id", "dir_id", dot(F.col("coefficients"), F.col("b")).alias("r"))
