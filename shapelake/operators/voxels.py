"""Voxel tables (image_id, i, j, k, value): thresholds, smoothing, surfaces, components, slices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import connected_components, stars

FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def _moved(voxels: DataFrame, offsets, extra: str = "value") -> DataFrame:
    """A copy of every voxel at each offset: (image_id, i, j, k, extra, w)."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(w).alias("w")) for a, b, c, w in offsets)))
    return voxels.select("*", o.alias("o")).select("image_id", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"), extra, F.col("o.w").alias("w"))


def local_threshold(voxels: DataFrame, base: float, weight: float, block: int) -> DataFrame:
    """value 255 where a voxel is above base - weight * (base - median of its block^3 neighbourhood), else 0."""
    h = block // 2
    span = range(-h, h + 1)
    near = _moved(voxels, [(a, b, c, 1.0) for a in span for b in span for c in span])
    median = near.groupBy("image_id", "i", "j", "k").agg(F.percentile("value", 0.5).alias("median"))
    out = voxels.join(median, ["image_id", "i", "j", "k"])
    return out.withColumn("value", F.when(F.col("value") > base - weight * (base - F.col("median")), 255).otherwise(0)).drop("median")


def gaussian_smooth(voxels: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """Separable smoothing of dense images of ``shape``, mirrored at the border; one grouping an axis."""
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    out = voxels.select("image_id", "i", "j", "k", F.col("value").cast("double").alias("value"))
    for axis, n in zip("ijk", shape, strict=True):
        d = F.explode(F.array(*(F.struct(F.lit(d - reach).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights))))
        at = F.pmod(F.col(axis) + F.col("o.d"), F.lit(2 * n))
        # a mirrored neighbour stands for the voxel from which it is mirrored
        to = F.when(at < n, at).otherwise(2 * n - 1 - at).cast("int")
        rows = out.select("*", d.alias("o")).withColumn("to", to)
        keys = [c for c in "ijk" if c != axis]
        out = rows.groupBy("image_id", *keys, F.col("to").alias(axis)).agg(F.sum(F.col("value") * F.col("o.w")).alias("value"))
    return out.select("image_id", "i", "j", "k", "value")


def surface_voxels(voxels: DataFrame) -> DataFrame:
    """Filled voxels (value > 0) with an empty face neighbour; outside the image is empty."""
    filled = voxels.filter("value > 0").select("image_id", "i", "j", "k", F.lit(1).alias("value"))
    inner = _moved(filled, [(*o, 1) for o in FACES]).groupBy("image_id", "i", "j", "k").agg(F.count("*").alias("n"))
    return filled.drop("value").join(inner, ["image_id", "i", "j", "k"], "left").filter("coalesce(n, 0) < 6").drop("n")


def gradient_normals(voxels: DataFrame) -> DataFrame:
    """(image_id, i, j, k, nx, ny, nz) of the surface: minus the image's gradient, one-sided where a neighbour is missing.

    Differences are signed, whatever the values' width.
    """
    for axis, name in zip("ijk", ("nx", "ny", "nz"), strict=True):
        row = Window.partitionBy("image_id", *(c for c in "ijk" if c != axis)).orderBy(axis)
        before = F.when(F.lag(axis).over(row) == F.col(axis) - 1, F.lag("value").over(row))
        after = F.when(F.lead(axis).over(row) == F.col(axis) + 1, F.lead("value").over(row))
        width = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
        voxels = voxels.withColumn(name, (F.coalesce(before, "value") - F.coalesce(after, "value")) / width)
    return voxels.join(surface_voxels(voxels), ["image_id", "i", "j", "k"], "left_semi").select("image_id", "i", "j", "k", "nx", "ny", "nz")


def neighbour_normals(voxels: DataFrame) -> DataFrame:
    """(image_id, i, j, k, nx, ny, nz) of the surface: the unit vector away from the filled ones of 26 neighbours, else (0, 1, 0)."""
    span = (-1, 0, 1)
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in span for b in span for c in span if a or b or c))
    near = voxels.filter("value > 0").select("image_id", "i", "j", "k", F.explode(offsets).alias("o"))
    away = near.groupBy("image_id", *((F.col(x) + F.col(f"o.{y}")).alias(x) for x, y in zip("ijk", "abc", strict=True))).agg(*(F.sum(f"o.{y}").alias(y) for y in "abc"))
    s = surface_voxels(voxels).join(away, ["image_id", "i", "j", "k"], "left").fillna(0, ["a", "b", "c"])
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return s.withColumn("size", size).select("image_id", "i", "j", "k", *(F.when(F.col("size") > 0, F.col(y) / F.col("size")).otherwise(d).alias(n) for y, d, n in zip("abc", (0.0, 1.0, 0.0), ("nx", "ny", "nz"), strict=True)))


def spaced(points: DataFrame, density: tuple[float, float, float]) -> DataFrame:
    """points with x, y, z: the voxel coordinates times the sampling density."""
    return points.withColumns({c: F.col(a) * float(d) for c, a, d in zip("xyz", "ijk", density, strict=True)})


def _blocks_labelled(rows: pa.Table) -> pa.Table:
    """One block of an image: each voxel with ``first``, the smallest voxel that the block's own faces link it to."""
    i, j, k = (rows.column(c).to_numpy().astype(np.int64) for c in "ijk")
    order = np.lexsort((k, j, i))
    rows, (i, j, k) = rows.take(pa.array(order)), (x[order] for x in (i, j, k))
    deep, wide = k.max() - k.min() + 2, j.max() - j.min() + 2  # one more than there are, so that no row meets the next
    place = ((i - i.min()) * wide + (j - j.min())) * deep + (k - k.min())
    ends = []
    for step in (0, 1, deep, wide * deep):  # 0: a voxel given twice
        at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        here = np.flatnonzero(place[at] == place + step)
        ends.append((here, at[here]))
    root = pa.array(stars(len(place), *(np.concatenate(x) for x in zip(*ends, strict=True))))
    for c in "ijk":
        rows = rows.append_column(f"first_{c}", rows.column(c).take(root))
    return rows.drop_columns(["bi", "bj", "bk"])


def voxel_components(voxels: DataFrame, least: int = 10, block: int = 64) -> DataFrame:
    """(image_id, i, j, k, part): components of filled voxels over faces with at least ``least`` voxels.

    An image is cut into blocks of ``block``^3, whose voxels are joined within a task; only parts of blocks that touch each
    other's faces are linked by rounds of joins. An image that fits a block needs none.
    """
    filled = voxels.filter("value > 0").select("image_id", "i", "j", "k")
    cut = filled.withColumns({f"b{c}": F.floor(F.col(c) / block) for c in "ijk"})
    firsts = [f"first_{c}" for c in "ijk"]
    kind = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema), *(f"first_{c} {filled.schema[c].dataType.simpleString()}" for c in "ijk")])
    local = materialize(cut.groupBy("image_id", "bi", "bj", "bk").applyInArrow(_blocks_labelled, kind))
    me = F.struct("image_id", *(F.col(f).alias(c) for f, c in zip(firsts, "ijk", strict=True)))
    links = None
    for axis in "ijk":
        at = F.pmod(axis, F.lit(block))
        low = local.filter(at == block - 1).select("image_id", *((F.col(c) + int(c == axis)).alias(c) for c in "ijk"), me.alias("x"))
        high = local.filter(at == 0).select("image_id", "i", "j", "k", me.alias("y"))
        e = low.join(high, ["image_id", "i", "j", "k"]).select("x", "y")
        links = e if links is None else links.union(e)
    parts = local.select("image_id", "i", "j", "k", me.alias("first"))
    roots = connected_components(links, "x", "y").select(F.col("node").alias("first"), "root")
    parts = parts.join(roots, "first", "left").withColumn("part", F.coalesce("root", "first"))
    large = parts.groupBy("part").count().filter(F.col("count") >= least).select("part", F.col("count").alias("size"))
    return parts.join(large, "part").select("image_id", "i", "j", "k", F.col("part.i").alias("part_i"), F.col("part.j").alias("part_j"), F.col("part.k").alias("part_k"), "size")


def to_bytes(voxels: DataFrame) -> DataFrame:
    """16-bit values as 8-bit ones, rounded half-even."""
    return voxels.withColumn("value", F.bround(F.col("value") * 255 / 65535).cast("int"))


def slices(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    return voxels.filter(F.col(axis) == at)
