"""Light fields: Zernike moments of a mesh's silhouettes from fixed view points, their images, and their distance.

Triangles are projected and cut into spans, one for each row of pixels they cover; a row's spans become one by an
aggregate of bit masks. Only silhouettes whose rows don't hang together are taken apart into components. Moments are sums
of a table of the basis, added up along each row, at the ends of the runs: a table of a parameter's size (pixels x moments),
made in Spark and broadcast behind a check of its rows. The views of a small mesh are drawn and summed in the task that
holds it (``packed``), by the same rules.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import by_sort, once, spread
from ..storage import join_counted, materialize
from .graph import connected_components
from .packed import MOST, Meshes, larger, packed, split, work
from .rays import triangles

#: View directions as (azimuth, elevation) in radians, by the number of views.
VIEWS = {
    3: [(0.0, 0.0), (0.0, math.pi / 2), (math.pi / 2, math.pi / 2)],
    5: [(0.0, 0.0), (0.0, math.pi / 2), (math.pi / 2, math.pi / 2), (math.pi / 3, math.pi / 3), (math.pi / 3, 2 * math.pi / 3)],
    7: [(0.0, 0.0), (0.0, math.pi / 2), (math.pi / 2, math.pi / 2), (math.pi / 3, math.pi / 3), (math.pi / 3, 2 * math.pi / 3), (2 * math.pi / 3, math.pi / 3), (2 * math.pi / 3, 2 * math.pi / 3)],
    10: [(0.0, 0.0), (0.0, math.pi / 2), (0.0, -math.pi / 2), (0.0, math.pi), (-math.pi / 2, math.pi / 2), (math.pi / 2, math.pi / 2), (math.pi / 3, math.pi / 3), (math.pi / 3, 2 * math.pi / 3), (2 * math.pi / 3, math.pi / 3), (2 * math.pi / 3, 2 * math.pi / 3)],
}

#: Bits of a word of a mask's row.
WORD = 60


def degrees(order: int) -> list[tuple[int, int]]:
    """(n, l) of the moments up to ``order``: l from 0 to n with n - l even."""
    return [(n, l) for n in range(order + 1) for l in range(n % 2, n + 1, 2)]  # noqa: E741


@cache
def zernike_basis(side: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(inside, values): the pixels of a side x side image within its circle, and the polynomials there by moment."""
    y, x = np.meshgrid(np.arange(side), np.arange(side))
    x, y = ((a.ravel() - side // 2) / (side // 2) for a in (x, y))
    rho = np.hypot(x, y)
    inside = np.flatnonzero(rho <= 1)
    rho, turn = rho[inside], np.exp(1j * np.arctan2(y, x)[inside])
    power = [rho**k for k in range(order + 1)]
    f = math.factorial
    out = []
    for n, l in degrees(order):  # noqa: E741
        terms = (((-1) ** m * f(n - m) / (f(m) * f((n + l) // 2 - m) * f((n - l) // 2 - m)), n - 2 * m) for m in range((n - l) // 2 + 1))
        out.append(sum(c * power[k] for c, k in terms) * turn**l)
    return inside, np.stack(out, axis=1)


def view_plane(azimuth: float, elevation: float) -> np.ndarray:
    """3 x 2: unit axes of the image plane seen from a direction, by a turn about x and then one about y."""
    d = np.array([math.sin(elevation) * math.cos(azimuth), math.sin(elevation) * math.sin(azimuth), math.cos(elevation)])
    angle = lambda a: math.atan2(a, d[2]) if math.hypot(a, d[2]) > 1e-9 else 0.0
    ay, ax = angle(d[0]), -angle(d[1])
    about_x = np.array([[1, 0, 0], [0, math.cos(ax), -math.sin(ax)], [0, math.sin(ax), math.cos(ax)]])
    about_y = np.array([[math.cos(ay), 0, math.sin(ay)], [0, 1, 0], [-math.sin(ay), 0, math.cos(ay)]])
    return (about_y @ about_x)[:, :2]


def enclosing_circle(p: np.ndarray, with_support: bool = False) -> tuple:
    """(centre, radius) of the smallest circle round a few points: the support grows by the farthest until all are in. With
    ``with_support`` also the points that hold it, three at most."""
    support = p[:1]
    centre, radius = p[0], 0.0
    while True:
        far = np.hypot(*(p - centre).T)
        if far.max() <= radius + 1e-9 * (1 + radius):
            return (centre, radius, support) if with_support else (centre, radius)
        s = np.vstack([support, p[far.argmax()]])
        best = None
        for k in (2, 3):
            for some in combinations(range(len(s)), k):
                q = s[list(some)]
                if k == 2:
                    c = q.mean(axis=0)
                else:
                    a = 2 * (q[1:] - q[0])
                    if abs(np.linalg.det(a)) < 1e-12:
                        continue
                    c = np.linalg.solve(a, (q[1:] ** 2).sum(axis=1) - (q[0] ** 2).sum())
                r = np.hypot(*(q - c).T).max()
                if (np.hypot(*(s - c).T) <= r + 1e-9 * (1 + r)).all() and (best is None or r < best[1]):
                    best = c, r, q
        if best is None or best[1] <= radius:
            return (centre, float(far.max()), support) if with_support else (centre, float(far.max()))
        centre, radius, support = best


def _flat(points: list[list[Column]], views: int) -> Column:
    """An array, by view, of (view, x0, y0, x1, y1, ...): points seen from each direction."""
    seen = []
    for i, view in enumerate(VIEWS[views]):
        plane = view_plane(*view)
        at = [sum((c * float(plane[k, j]) for k, c in enumerate(p)), F.lit(0.0)).alias(f"{'xy'[j]}{n}") for n, p in enumerate(points) for j in range(2)]
        seen.append(F.struct(F.lit(i).alias("view"), *at))
    return F.explode(F.array(*seen))


def enclosing_circles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy, radius): the smallest circle round each group's points (x0, y0), which are never gathered.

    A group's support, three points at most, grows by the point farthest from its circle until that is inside.
    """
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def circle(batches):
        for batch in batches:
            rows = [enclosing_circle(np.array([(q["x"], q["y"]) for q in s]), True) for s in batch.column("support").to_pylist()]
            support = pa.array([[{"x": x, "y": y} for x, y in s.tolist()] for _, _, s in rows], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            out = [*(batch.column(k) for k in keys), support, *(pa.array([float(x) for x in c], pa.float64()) for c in ([r[0][0] for r in rows], [r[0][1] for r in rows], [r[1] for r in rows]))]
            yield pa.RecordBatch.from_arrays(out, [*keys, "support", "cx", "cy", "radius"])

    schema = f"{kinds}, support array<struct<x: double, y: double>>, cx double, cy double, radius double"
    point = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))
    start = points.groupBy(*keys).agg(F.array(F.min(point)).alias("support"))
    now, done = materialize(start.mapInArrow(circle, schema)), []
    while True:
        away = F.hypot(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
        far = points.join(by_sort(now), keys).groupBy(*keys).agg(F.max(F.struct(away.alias("away"), point.alias("p"))).alias("far"), *(F.first(c).alias(c) for c in ("support", "cx", "cy", "radius")))
        far = materialize(far)
        inside = F.col("far.away") <= F.col("radius") + 1e-9 * (1 + F.col("radius"))
        done.append(far.filter(inside).select(*keys, "cx", "cy", "radius"))
        open_ = far.filter(~inside)
        if open_.isEmpty():
            break
        after = open_.withColumn("support", F.concat("support", F.array("far.p"))).select(*keys, "support", F.col("radius").alias("was"))
        grown = after.drop("was").mapInArrow(circle, schema).join(by_sort(after.select(*keys, "was", "support").withColumnRenamed("support", "tried")), keys)
        # without progress, which only rounding can prevent, the circle is widened to the farthest point
        grown = materialize(grown.join(by_sort(open_.select(*keys, F.col("far.away").alias("away"))), keys))
        stuck = F.col("radius") <= F.col("was")
        done.append(grown.filter(stuck).select(*keys, "cx", "cy", F.greatest("radius", "away").alias("radius")))
        now = grown.filter(~stuck).select(*keys, "support", "cx", "cy", "radius")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def silhouette_rows(vertices: DataFrame, faces: DataFrame, views: int = 5, side: int = 200) -> DataFrame:
    """(mesh_id, view, i, lo, hi, n, w0, w1, ...): each row of pixels that a silhouette covers, from ``lo`` to ``hi``, ``n``
    of them, as bits in words; the enclosing circle is scaled to the image. A view without extent has no rows."""
    flat = vertices.select("mesh_id", _flat([[F.col(c) for c in "xyz"]], views).alias("s")).select("mesh_id", "s.*")
    tri = triangles(vertices, faces).select("mesh_id", _flat([[F.col(f"p{i}.{c}") for c in "xyz"] for i in range(3)], views).alias("s")).select("mesh_id", "s.*")
    circles = enclosing_circles(flat, ["mesh_id", "view"]).filter("radius > 0")
    # cutting into rows costs far more than the few bytes a mesh has, by which small partitions would be merged
    tri = spread(tri.join(by_sort(circles), ["mesh_id", "view"]), "mesh_id", "view", "x0", "y1")
    place = lambda c, k: ((F.col(f"{c}{k}") - F.col(f"c{c}")) * (side / 2) / F.col("radius") + side / 2).alias(f"{c}{k}")
    tri = tri.select("mesh_id", "view", *(place(c, k) for k in range(3) for c in "xy"))
    x, y = ([F.col(f"{c}{k}") for k in range(3)] for c in "xy")
    pixel = lambda c: F.greatest(F.lit(0), F.least(F.lit(side - 1), c)).cast("int")
    first, last = F.ceil(F.least(*x) - 1e-9), F.floor(F.greatest(*x) + 1e-9)
    edges = {}
    for k, (a, b) in enumerate(((0, 1), (1, 2), (2, 0))):
        run = x[b] - x[a]
        slope = F.try_divide(y[b] - y[a], F.when(F.abs(run) > 1e-12, run))
        edges |= {f"x{k}0": F.least(x[a], x[b]) - 1e-9, f"x{k}1": F.greatest(x[a], x[b]) + 1e-9, f"y{k}0": F.least(y[a], y[b]), f"y{k}1": F.greatest(y[a], y[b]), f"m{k}": slope, f"c{k}": y[a] - slope * x[a]}
    tri = tri.filter(first <= last).select("mesh_id", "view", *(c.alias(n) for n, c in edges.items()), F.explode(F.sequence(pixel(first), pixel(last))).alias("i"))
    # where each edge is at the row, both its ends for an upright one
    at = {f"t{k}": F.greatest(F.col(f"y{k}0"), F.least(F.col(f"y{k}1"), F.col(f"c{k}") + F.col(f"m{k}") * F.col("i"))) for k in range(3)}
    tri = once(tri, at | {f"r{k}": (F.col("i") >= F.col(f"x{k}0")) & (F.col("i") <= F.col(f"x{k}1")) for k in range(3)})
    end = lambda k, side: F.when(F.col(f"r{k}"), F.when(F.col(f"m{k}").isNull(), F.col(f"y{k}{side}")).otherwise(F.col(f"t{k}")))
    lo, hi = F.ceil(F.least(*(end(k, 0) for k in range(3))) - 1e-9), F.floor(F.greatest(*(end(k, 1) for k in range(3))) + 1e-9)
    spans = once(tri.select("mesh_id", "view", "i", *(c for c in tri.columns if c[0] in "ymtr")), {"lo": lo, "hi": hi}).filter("lo <= hi")
    spans = once(spans.select("mesh_id", "view", "i", "lo", "hi").withColumnsRenamed({"lo": "l", "hi": "h"}), {"lo": pixel(F.col("l")), "hi": pixel(F.col("h"))}).drop("l", "h")
    words = -(-side // WORD)

    def bits(w: int) -> Column:
        a, b = (f"greatest(lo - {WORD * w}, 0)", f"least(hi - {WORD * w}, {WORD - 1})")
        return F.expr(f"case when {a} <= {b} then shiftleft(shiftleft(1L, {b} - {a} + 1) - 1, {a}) else 0L end")

    rows = spans.groupBy("mesh_id", "view", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.bit_or(bits(w)).alias(f"w{w}") for w in range(words)))
    return rows.withColumn("n", sum((F.bit_count(f"w{w}") for w in range(words)), F.lit(0)))


def _runs(rows: DataFrame) -> DataFrame:
    """(mesh_id, view, i, lo, hi) for each unbroken run of a row's pixels."""
    words = sorted((c for c in rows.columns if c[0] == "w"), key=lambda c: int(c[1:]))
    image = F.array(*words)
    at = F.explode(F.sequence("lo", "hi"))
    one = rows.select("mesh_id", "view", "i", image.alias("image"), at.alias("p")).filter(F.expr(f"shiftright(get(image, p div {WORD}), pmod(p, {WORD})) & 1L") == 1)
    start = F.col("p") - F.row_number().over(Window.partitionBy("mesh_id", "view", "i").orderBy("p"))
    return one.withColumn("start", start).groupBy("mesh_id", "view", "i", "start").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).drop("start")


def silhouette_runs(rows: DataFrame) -> DataFrame:
    """(mesh_id, view, i, lo, hi): the runs of pixels of each silhouette's largest part, of equal ones the one that comes first.

    Pixels hang together along rows and columns. ``rows`` must be a written table, as it is read several times.
    """
    order = Window.partitionBy("mesh_id", "view").orderBy("i")
    joined = (F.col("i") == F.lag("i").over(order) + 1) & (F.col("lo") <= F.lag("hi").over(order)) & (F.col("hi") >= F.lag("lo").over(order))
    sound = (F.col("n") == F.col("hi") - F.col("lo") + 1) & F.coalesce(joined, F.row_number().over(order) == 1)
    marked = materialize(rows.withColumn("sound", sound).groupBy("mesh_id", "view").agg(F.min("sound").alias("sound")))
    whole = rows.join(by_sort(marked.filter("sound")), ["mesh_id", "view"], "left_semi").select("mesh_id", "view", "i", "lo", "hi")
    if marked.filter("not sound").isEmpty():
        return whole
    runs = materialize(_runs(rows.join(by_sort(marked.filter("not sound")), ["mesh_id", "view"], "left_semi")))
    below = runs.select("mesh_id", "view", (F.col("i") + 1).alias("i"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
    met = runs.join(by_sort(below), ["mesh_id", "view", "i"]).filter((F.col("lo") <= F.col("hi0")) & (F.col("hi") >= F.col("lo0")))
    node = lambda i, lo: F.struct("mesh_id", "view", i.alias("i"), F.col(lo).alias("lo"))
    roots = connected_components(met.select(node(F.col("i"), "lo").alias("a"), node(F.col("i") - 1, "lo0").alias("b")))
    parts = runs.withColumn("node", node(F.col("i"), "lo")).join(by_sort(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    size = parts.groupBy("mesh_id", "view", "root").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("size"))
    best = size.groupBy("mesh_id", "view").agg(F.max_by("root", F.struct("size", -F.col("root.i"), -F.col("root.lo"))).alias("root"))
    return whole.unionByName(parts.join(by_sort(best), ["mesh_id", "view", "root"], "left_semi").select("mesh_id", "view", "i", "lo", "hi"))


def basis_sums(spark: SparkSession, side: int, order: int) -> DataFrame:
    """(key, sums): for row i and pixel p from -1 on, key i (side + 1) + p + 1, the sums over the row's pixels up to p within
    the image's circle of 1, then of the polynomials' real and imaginary parts."""

    def step(batches):
        inside, values = zernike_basis(side, order)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                row = np.zeros((side + 1, 1 + 2 * values.shape[1]))
                at = np.flatnonzero(inside // side == i)
                row[inside[at] % side + 1] = np.column_stack([np.ones(len(at)), values[at].real, values[at].imag])
                sums = np.cumsum(row, axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(side + 2) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(side + 1) + i * (side + 1), pa.int64()), lists], ["key", "sums"])

    return spark.range(side).mapInArrow(step, "key long, sums array<double>")


@cache
def _sums(side: int, order: int) -> np.ndarray:
    """The table of ``basis_sums`` in its keys' order."""
    inside, values = zernike_basis(side, order)
    out = np.zeros((side, side + 1, 1 + 2 * values.shape[1]))
    out[inside // side, inside % side + 1] = np.column_stack([np.ones(len(inside)), values.real, values.imag])
    return np.cumsum(out, axis=1, out=out).reshape(side * (side + 1), -1)


def _mask(tri: np.ndarray, view: np.ndarray, views: int, side: int) -> np.ndarray:
    """(view and row, pixel): what triangles (triangle, corner, (x, y)), in pixels of their view, cover; see ``silhouette_rows``."""
    x, y = tri[..., 0], tri[..., 1]
    pixel = lambda c: np.clip(c, 0, side - 1).astype(np.int64)
    first, last = np.ceil(x.min(axis=1) - 1e-9), np.floor(x.max(axis=1) + 1e-9)
    keep = first <= last
    x, y, view, first, last = x[keep], y[keep], view[keep], pixel(first[keep]), pixel(last[keep])
    many = last - first + 1
    t = np.repeat(np.arange(len(x)), many)
    i = first[t] + np.arange(len(t)) - np.repeat(np.cumsum(many) - many, many)
    low, high = np.full(len(t), np.inf), np.full(len(t), -np.inf)
    for a, b in ((0, 1), (1, 2), (2, 0)):
        run = x[:, b] - x[:, a]
        upright = ~(np.abs(run) > 1e-12)
        slope = (y[:, b] - y[:, a]) / np.where(upright, 1.0, run)
        y0, y1 = np.minimum(y[:, a], y[:, b]), np.maximum(y[:, a], y[:, b])
        at = np.clip((y[:, a] - slope * x[:, a])[t] + slope[t] * i, y0[t], y1[t])
        reached = (i >= (np.minimum(x[:, a], x[:, b]) - 1e-9)[t]) & (i <= (np.maximum(x[:, a], x[:, b]) + 1e-9)[t])
        low = np.where(reached, np.minimum(low, np.where(upright[t], y0[t], at)), low)
        high = np.where(reached, np.maximum(high, np.where(upright[t], y1[t], at)), high)
    lo, hi = np.ceil(low - 1e-9), np.floor(high + 1e-9)
    keep = lo <= hi
    row, lo, hi = (view[t] * side + i)[keep] * (side + 1), pixel(lo[keep]), pixel(hi[keep])
    ends = np.bincount(row + lo, minlength=views * side * (side + 1)) - np.bincount(row + hi + 1, minlength=views * side * (side + 1))
    return np.cumsum(ends.reshape(views * side, side + 1), axis=1)[:, :side] > 0


def _largest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first pixel, last pixel) of the runs of a mask's largest part, as ``silhouette_runs`` gives them."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, lo), hi = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
    if (np.diff(i) == 1).all() and (lo[1:] <= hi[:-1]).all() and (hi[1:] >= lo[:-1]).all():
        return i, lo, hi
    begin = np.searchsorted(i, np.arange(len(mask) + 1))
    root = list(range(len(i)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k in range(len(i)):
        for j in range(begin[i[k] - 1], begin[i[k]]) if i[k] else ():
            if lo[k] <= hi[j] and hi[k] >= lo[j]:
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    part = np.array([find(k) for k in range(len(i))])
    best = part == np.bincount(part, hi - lo + 1).argmax()
    return i[best], lo[best], hi[best]


def _moments(views: int, order: int, side: int):
    planes = [view_plane(*v) for v in VIEWS[views]]
    scale = np.array([(n + 1) / math.pi for n, _ in degrees(order)])

    def find(meshes: Meshes, m: int, name: str):
        table = _sums(side, order)
        p, tri = meshes.xyz[meshes.at[m] : meshes.at[m + 1]], meshes.corners[meshes.first[m] : meshes.first[m + 1]]
        p, tri = p[~np.isnan(p).any(axis=1)], tri[~np.isnan(tri).any(axis=(1, 2))]
        if not len(p) or not len(tri):
            return None
        drawn, at = [], []
        for k, plane in enumerate(planes):
            flat = p @ plane
            centre, radius = enclosing_circle(flat[np.lexsort(flat.T[::-1])])
            if radius > 0:
                drawn.append((tri @ plane - centre) * (side / 2) / radius + side / 2)
                at.append(k)
        if not at:
            return None
        mask = _mask(np.concatenate(drawn), np.repeat(at, len(tri)), views, side).reshape(views, side, side)
        out = []
        for k in at:
            i, lo, hi = _largest(mask[k])
            sums = (table[i * (side + 1) + hi + 1] - table[i * (side + 1) + lo]).sum(axis=0)
            if sums[0] > 0:
                re, im = np.split(sums[1:] / sums[0], 2)
                out.append((k, re * scale, im * -scale))
        return [np.array([k for k, _, _ in out], np.int32), np.stack([x for _, x, _ in out]), np.stack([x for _, _, x in out])] if out else None

    return find


def light_field(vertices: DataFrame, faces: DataFrame, views: int = 5, order: int = 15, side: int = 200, most: int = MOST) -> DataFrame:
    """(mesh_id, view, moments: array of (re, im)), moments by n and l; the mask is scaled to a sum of 1.

    Another number of views than 3, 5, 7 or 10 is a ValueError. A silhouette counts with its largest part. A mesh without
    extent in a view, or without faces, gives null moments. Meshes of up to ``most`` vertices and faces leave their task as moments.
    """
    if views not in VIEWS:
        raise ValueError(f"views must be one of {sorted(VIEWS)}")
    if most:
        (v, f), rest = split(larger(vertices, faces, most), vertices, faces)
        found = work(packed(v, f), _moments(views, order, side), "view int, re array<double>, im array<double>")
        found = _every(v, found.select("mesh_id", "view", F.arrays_zip("re", "im").alias("moments")), views)
        return found.unionByName(light_field(*rest, views, order, side, 0)) if rest else found
    spark = vertices.sparkSession
    runs = silhouette_runs(materialize(silhouette_rows(vertices, faces, views, side)))
    table = materialize(basis_sums(spark, side, order))
    key = lambda c: (F.col("i") * (side + 1) + c).cast("long")
    met = join_counted(runs.select("mesh_id", "view", key(F.col("hi") + 1).alias("key"), key(F.col("lo")).alias("start")), table, "key")
    met = join_counted(met.drop("key").withColumnsRenamed({"start": "key", "sums": "upto"}), table, "key")
    many = len(degrees(order))
    sums = met.groupBy("mesh_id", "view").agg(*(F.sum(F.get("upto", F.lit(k)) - F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(1 + 2 * many)))
    scale = [(n + 1) / math.pi for n, _ in degrees(order)]
    part = lambda k, sign: F.col(f"s{k}") / F.col("s0") * sign
    moments = F.array(*(F.struct(part(1 + k, s).alias("re"), part(1 + many + k, -s).alias("im")) for k, s in enumerate(scale)))
    found = sums.select("mesh_id", "view", F.when(F.col("s0") > 0, moments).alias("moments"))
    return _every(vertices, found, views)


def _every(vertices: DataFrame, found: DataFrame, views: int) -> DataFrame:
    every = vertices.select("mesh_id").distinct().withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    return every.join(by_sort(found), ["mesh_id", "view"], "left")


def recovered_images(moments: DataFrame, side: int = 30, order: int = 15) -> DataFrame:
    """(mesh_id, view, pixel, value): the image that moments describe, at the pixels within its circle."""
    inside, values = zernike_basis(side, order)
    table = [(int(p), [(float(c.real), float(c.imag)) for c in v]) for p, v in zip(inside, values, strict=True)]
    basis = moments.sparkSession.createDataFrame(table, "pixel int, v array<struct<re: double, im: double>>")
    part = F.zip_with("moments", "v", lambda m, v: m["re"] * v["re"] - m["im"] * v["im"])
    met = moments.filter("moments is not null").join(F.broadcast(basis), F.lit(True))  # pixels are a parameter
    return met.select("mesh_id", "view", "pixel", F.aggregate(part, F.lit(0.0), lambda a, e: a + e).alias("value"))


def light_field_table(moments: DataFrame) -> DataFrame:
    """(mesh_id, views): each mesh's moments by view in one array."""
    rows = moments.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("view", "moments"))).alias("v"))
    return rows.select("mesh_id", F.transform("v", lambda e: e["moments"]).alias("views"))


def light_field_distance(x: Column, y: Column, views: int = 5) -> Column:
    """Least sum of L1 distances over all ways to match the views of x with those of y; a null view costs 0.

    A fold over x's views holds the least cost of every set of y's views that they can have taken.
    """
    gap = lambda a, b: F.coalesce(F.aggregate(F.zip_with(a, b, lambda p, q: F.hypot(p["re"] - q["re"], p["im"] - q["im"])), F.lit(0.0), lambda s, e: s + e), F.lit(0.0))
    inf = F.lit(float("inf"))
    sets = F.array(*(F.lit(m) for m in range(1 << views)))

    def step(best: Column, a: Column) -> Column:
        cost = F.transform(y, lambda b: gap(a, b))

        def taken(m: Column) -> Column:
            return F.array_min(F.array(*(F.when(m.bitwiseAND(F.lit(1 << j)) != 0, F.get(best, m - (1 << j)) + F.get(cost, F.lit(j))).otherwise(inf) for j in range(views))))

        return F.transform(sets, taken)

    start = F.transform(sets, lambda m: F.when(m == 0, F.lit(0.0)).otherwise(inf))
    return F.get(F.aggregate(x, start, step), F.lit((1 << views) - 1))
