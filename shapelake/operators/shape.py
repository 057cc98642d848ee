"""Whole-mesh operations: a sphere of directions, hull ratios, orientation by the junction, closing of holes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import by_sort
from ..functions.vectors import rotation
from .graph import connected_components
from .mesh import face_geometry, hull_volume, junction_faces, volume


def sphere(spark: SparkSession, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(directions, triangles) of an octahedron whose triangles are cut into four ``rounds`` times: fixed small tables."""
    points = [tuple(float(s * (i == k)) for k in range(3)) for i in range(3) for s in (1, -1)]
    tri = [(a, b, c) if (sa * sb * sc) > 0 else (a, c, b) for a, sa in ((0, 1), (1, -1)) for b, sb in ((2, 1), (3, -1)) for c, sc in ((4, 1), (5, -1))]
    at = {p: i for i, p in enumerate(points)}

    def middle(i: int, j: int) -> int:
        m = np.add(points[i], points[j])
        p = tuple((m / np.linalg.norm(m)).round(12).tolist())
        if p not in at:
            at[p] = len(points)
            points.append(p)
        return at[p]

    for _ in range(rounds):
        mids = [(a, b, c, middle(a, b), middle(b, c), middle(c, a)) for a, b, c in tri]
        tri = [t for a, b, c, x, y, z in mids for t in ((a, x, z), (x, b, y), (z, y, c), (x, y, z))]
    directions = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "dir_id int, dx double, dy double, dz double")
    return directions, spark.createDataFrame(tri, "a int, b int, c int")


def hull_ratios(vertices: DataFrame, faces: DataFrame, rounds: int = 3) -> DataFrame:
    """(mesh_id, hull_volume, hull_ratio): the directional hull and how much larger it is than the mesh, in the mesh's volumes."""
    hull = hull_volume(vertices, *sphere(vertices.sparkSession, rounds))
    both = hull.join(by_sort(volume(face_geometry(vertices, faces))), "mesh_id")
    return both.select("mesh_id", "hull_volume", ((F.col("hull_volume") - F.col("volume")) / F.when(F.col("volume") != 0, F.col("volume"))).alias("hull_ratio"))


def _turn(at: list, angle, axis: tuple) -> list:
    return [sum((m * c for m, c in zip(row, at, strict=True)), F.lit(0.0)) for row in rotation(angle, axis)]


def oriented(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices turned about their mesh's mean: the junction's normal to (0, -1, 0), then by the widest axis in x and z.

    The widest axis is that of the mesh as given, with x >= 0. A mesh without junction stays as it is.
    """
    n = junction_faces(face_geometry(vertices, faces)).filter("junction").groupBy("mesh_id").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    n = n.withColumn("size", size).filter("size > 0").select("mesh_id", *((F.col(c) / F.col("size")).alias(c) for c in ("nx", "ny", "nz")))
    side = F.sqrt(F.col("nx") * F.col("nx") + F.col("nz") * F.col("nz"))
    # the axis is normal x (0, -1, 0); where both are parallel, x
    n = n.withColumn("side", side).select("mesh_id", F.atan2("side", -F.col("ny")).alias("tilt"), F.when(F.col("side") > 1e-12, F.col("nz") / F.col("side")).otherwise(1.0).alias("ux"), F.when(F.col("side") > 1e-12, -F.col("nx") / F.col("side")).otherwise(0.0).alias("uz"))
    flat = vertices.groupBy("mesh_id").agg(F.covar_samp("x", "z").alias("xz"), (F.var_samp("x") - F.var_samp("z")).alias("spread"))
    flat = flat.select("mesh_id", (F.lit(np.pi / 2) - F.atan2(2 * F.col("xz"), "spread") / 2).alias("wide"))
    mean = Window.partitionBy("mesh_id")
    v = vertices.select("mesh_id", "vertex_id", "x", "y", "z", *(F.avg(c).over(mean).alias(f"m{c}") for c in "xyz"))
    v = v.join(by_sort(n), "mesh_id", "left").join(by_sort(flat), "mesh_id")
    at = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    v = v.select("*", *(e.alias(f"t{c}") for e, c in zip(_turn(at, F.col("tilt"), (F.col("ux"), F.lit(0.0), F.col("uz"))), "xyz", strict=True)))
    end = _turn([F.col(f"t{c}") for c in "xyz"], F.col("wide"), (0.0, -1.0, 0.0))
    return v.select("mesh_id", "vertex_id", *(F.coalesce(e + F.col(f"m{c}"), c).alias(c) for e, c in zip(end, "xyz", strict=True)))


def closed(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with every hole filled: a vertex at the mean of its border, and a triangle to each border edge.

    New ids follow each mesh's largest. Holes that share a vertex are filled as one.
    """
    side = F.explode(F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    sides = faces.select("mesh_id", side.alias("s")).select("mesh_id", "s.a", "s.b")
    border = sides.join(by_sort(sides.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))), ["mesh_id", "a", "b"], "left_anti")
    node = lambda c: F.struct("mesh_id", F.col(c).alias("v"))
    roots = connected_components(border.select(node("a").alias("x"), node("b").alias("y")), "x", "y")
    loop = border.withColumn("node", node("a")).join(by_sort(roots), "node", "left").select("mesh_id", "a", "b", F.coalesce("root.v", "a").alias("hole"))
    last = vertices.groupBy("mesh_id").agg(F.max("vertex_id").alias("last"))
    at = loop.join(by_sort(vertices.withColumnRenamed("vertex_id", "a")), ["mesh_id", "a"]).groupBy("mesh_id", "hole").agg(*(F.avg(c).alias(c) for c in "xyz")).join(by_sort(last), "mesh_id")
    number = F.row_number().over(Window.partitionBy("mesh_id").orderBy("hole"))
    at = at.select("mesh_id", "hole", (F.col("last") + number).alias("vertex_id"), "x", "y", "z")
    top = faces.groupBy("mesh_id").agg(F.max("face_id").alias("top"))
    order = F.row_number().over(Window.partitionBy("mesh_id").orderBy("hole", "a", "b"))
    fan = loop.join(by_sort(at.select("mesh_id", "hole", "vertex_id")), ["mesh_id", "hole"]).join(by_sort(top), "mesh_id")
    fan = fan.select("mesh_id", (F.col("top") + order).alias("face_id"), F.col("b").alias("v0"), F.col("a").alias("v1"), F.col("vertex_id").alias("v2"))
    return vertices.select("mesh_id", "vertex_id", "x", "y", "z").union(at.select("mesh_id", "vertex_id", "x", "y", "z")), faces.select("mesh_id", "face_id", "v0", "v1", "v2").union(fan)
