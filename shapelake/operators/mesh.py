"""Shape descriptors of triangle meshes: vertices (mesh_id, vertex_id, x, y, z), faces (mesh_id, face_id, v0, v1, v2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_sort


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with corners (x0 .. z2), normal (nx, ny, nz; twice the area long), area, centre (cx, cy, cz), and volume6.

    Corners are looked up in one map per mesh, so a mesh's vertices and faces meet in a single join.
    """
    corner = F.struct("x", "y", "z")
    maps = vertices.groupBy("mesh_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("vertex_id"), corner))).alias("at"))
    g = faces.join(by_sort(maps), "mesh_id")
    for i in range(3):
        g = g.withColumn(f"p{i}", F.element_at("at", F.col(f"v{i}")))
    return _geometry(g.drop("at"))


def face_geometry_by_joins(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The same for meshes whose vertices don't fit one row: three joins by (mesh, vertex)."""
    g = faces
    for i in range(3):
        g = g.join(by_sort(vertices.select("mesh_id", F.col("vertex_id").alias(f"v{i}"), F.struct("x", "y", "z").alias(f"p{i}"))), ["mesh_id", f"v{i}"])
    return _geometry(g)


def _geometry(g: DataFrame) -> DataFrame:
    p = [[F.col(f"p{i}.{c}") for c in "xyz"] for i in range(3)]
    u, v = ([p[k][c] - p[0][c] for c in range(3)] for k in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    a, b, c = p
    volume6 = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    centre = [(a[k] + b[k] + c[k]) / 3 for k in range(3)]
    out = g.select("mesh_id", "face_id", "v0", "v1", "v2", *(x.alias(m) for x, m in zip(n, ("nx", "ny", "nz"), strict=True)), *(x.alias(m) for x, m in zip(centre, ("cx", "cy", "cz"), strict=True)), volume6.alias("volume6"))
    return out.withColumn("area", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2)


def volume(geometry: DataFrame) -> DataFrame:
    return geometry.groupBy("mesh_id").agg(F.abs(F.sum("volume6") / 6).alias("volume"))


def junction_vertices(faces: DataFrame, degree: int = 10) -> DataFrame:
    """(mesh_id, vertex_id) of more than ``degree`` distinct neighbours."""
    ends = F.explode(F.array(*(F.struct(p.alias("a"), q.alias("b")) for p, q in ((F.col(f"v{i}"), F.col(f"v{j}")) for i in range(3) for j in range(3) if i != j))))
    near = faces.select("mesh_id", ends.alias("e")).select("mesh_id", "e.a", "e.b").distinct()
    return near.groupBy("mesh_id", F.col("a").alias("vertex_id")).count().filter(F.col("count") > degree).select("mesh_id", "vertex_id")


def junction_faces(geometry: DataFrame) -> DataFrame:
    """geometry with ``junction``: whether the face has a junction vertex."""
    hit = junction_vertices(geometry.select("mesh_id", "v0", "v1", "v2")).groupBy("mesh_id").agg(F.collect_set("vertex_id").alias("hubs"))
    joined = geometry.join(by_sort(hit), "mesh_id", "left")
    return joined.withColumn("junction", F.coalesce(F.arrays_overlap("hubs", F.array("v0", "v1", "v2")), F.lit(False))).drop("hubs")


def areas(geometry: DataFrame) -> DataFrame:
    """(mesh_id, total_area, junction_area, area): area without the junction's faces."""
    part = F.sum(F.when(F.col("junction"), F.col("area")).otherwise(0.0))
    return junction_faces(geometry).groupBy("mesh_id").agg(F.sum("area").alias("total_area"), part.alias("junction_area"), (F.sum("area") - part).alias("area"))


def junction_centres(vertices: DataFrame, geometry: DataFrame) -> DataFrame:
    """(mesh_id, jx, jy, jz): mean centre of the junction's faces, else the first vertex."""
    mean = [F.avg(F.when(F.col("junction"), F.col(c))).alias(c) for c in ("cx", "cy", "cz")]
    found = junction_faces(geometry).groupBy("mesh_id").agg(*mean)
    first = vertices.groupBy("mesh_id").agg(F.min_by(F.struct("x", "y", "z"), "vertex_id").alias("f"))
    return first.join(by_sort(found), "mesh_id", "left").select("mesh_id", F.coalesce("cx", "f.x").alias("jx"), F.coalesce("cy", "f.y").alias("jy"), F.coalesce("cz", "f.z").alias("jz"))


def junction_distances(vertices: DataFrame, geometry: DataFrame) -> DataFrame:
    """(mesh_id, dx, dy, dz, d): each vertex from its mesh's junction centre."""
    v = vertices.join(by_sort(junction_centres(vertices, geometry)), "mesh_id")
    v = v.select("mesh_id", (F.col("x") - F.col("jx")).alias("dx"), (F.col("y") - F.col("jy")).alias("dy"), (F.col("z") - F.col("jz")).alias("dz"))
    return v.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))


def lengths(distances: DataFrame) -> DataFrame:
    """(mesh_id, average_distance, length, cvd): length is the mean of the distances from their 0.95 quantile on."""
    cut = F.percentile("d", 0.95).over(Window.partitionBy("mesh_id"))  # not a join, which would work the distances out twice
    tail = F.avg(F.when(F.col("d") >= F.col("cut") - 1e-9, F.col("d")))
    return distances.withColumn("cut", cut).groupBy("mesh_id").agg(F.avg("d").alias("average_distance"), tail.alias("length"), (F.stddev_samp("d") / F.avg("d")).alias("cvd"))


def open_angles(distances: DataFrame) -> DataFrame:
    """(mesh_id, open_angle): mean angle between the mean vertex vector and each vertex vector."""
    mean = Window.partitionBy("mesh_id")
    d = distances.select("mesh_id", "dx", "dy", "dz", *(F.avg(c).over(mean).alias(f"m{c}") for c in ("dx", "dy", "dz")))
    m, v = [F.col(c) for c in ("mdx", "mdy", "mdz")], [F.col(c) for c in ("dx", "dy", "dz")]
    cross = [m[1] * v[2] - m[2] * v[1], m[2] * v[0] - m[0] * v[2], m[0] * v[1] - m[1] * v[0]]
    angle = F.atan2(F.sqrt(sum((c * c for c in cross), F.lit(0.0))), sum((p * q for p, q in zip(m, v, strict=True)), F.lit(0.0)))
    return d.groupBy("mesh_id").agg(F.avg(angle).alias("open_angle"))


def scaled(vertices: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    return vertices.withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy, "z": F.col("z") * sz})


def rotated(vertices: DataFrame, matrix) -> DataFrame:
    """Each mesh turned about its vertex mean by a 3 x 3 matrix of numbers or Columns."""
    mean = Window.partitionBy("mesh_id")
    v = vertices.select("mesh_id", "vertex_id", "x", "y", "z", *(F.avg(c).over(mean).alias(f"m{c}") for c in "xyz"))
    turned = [sum((matrix[r][k] * (F.col(c) - F.col(f"m{c}")) for k, c in enumerate("xyz")), F.col(f"m{'xyz'[r]}")) for r in range(3)]
    return v.select("mesh_id", "vertex_id", *(t.alias(c) for t, c in zip(turned, "xyz", strict=True)))


def bounding_boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))


def hull_volume(vertices: DataFrame, directions: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh_id, hull_volume): volume of the body spanned by the farthest vertex in each direction.

    ``directions`` (dir_id, dx, dy, dz) and ``triangles`` (a, b, c of dir_id) are a fixed sphere; the more directions,
    the nearer to the convex hull, from below.
    """
    reach = F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")
    far = vertices.join(F.broadcast(directions), F.lit(True)).groupBy("mesh_id", "dir_id").agg(F.max_by(F.struct("x", "y", "z"), F.struct(reach, -F.col("vertex_id"))).alias("p"))
    spread = far.select("mesh_id", "dir_id", "p.x", "p.y", "p.z").withColumnRenamed("dir_id", "vertex_id")
    faces = far.select("mesh_id").distinct().join(F.broadcast(triangles.select(F.monotonically_increasing_id().alias("face_id"), F.col("a").alias("v0"), F.col("b").alias("v1"), F.col("c").alias("v2"))), F.lit(True))
    return volume(face_geometry(spread, faces)).withColumnRenamed("volume", "hull_volume")


#: Metrics by name: (vertices, faces) -> (mesh_id, value columns). Callers may add their own.
METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "volume": lambda v, f: volume(face_geometry(v, f)),
    "areas": lambda v, f: areas(face_geometry(v, f)),
    "lengths": lambda v, f: lengths(junction_distances(v, face_geometry(v, f))),
    "open_angle": lambda v, f: open_angles(junction_distances(v, face_geometry(v, f))),
}


def mesh_metrics(vertices: DataFrame, faces: DataFrame, names: list[str]) -> DataFrame:
    """One row a mesh with the named metrics' columns; a mesh that a metric can't measure has nulls there."""
    out = vertices.select("mesh_id").distinct()
    for n in names:
        out = out.join(by_sort(METRICS[n](vertices, faces)), "mesh_id", "left")
    return out


def mesh_arrays(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, points, triangles): a mesh as two arrays in the order of its ids; triangles hold places in points, from 0."""
    order = Window.partitionBy("mesh_id").orderBy("vertex_id")
    place = vertices.select("mesh_id", "vertex_id", (F.row_number().over(order) - 1).alias("place"))
    for i in range(3):
        faces = faces.join(by_sort(place.select("mesh_id", F.col("vertex_id").alias(f"v{i}"), F.col("place").alias(f"at{i}"))), ["mesh_id", f"v{i}"])
    points = vertices.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("p"))
    shape = faces.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("face_id", "at0", "at1", "at2"))).alias("t"))
    return points.join(by_sort(shape), "mesh_id", "left").select("mesh_id", F.transform("p", lambda e: F.array(e["x"], e["y"], e["z"])).alias("points"), F.coalesce(F.transform("t", lambda e: F.array(e["at0"], e["at1"], e["at2"])), F.array().cast("array<array<int>>")).alias("triangles"))


def mesh_tables(arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of meshes given as arrays, numbered from 0."""
    v = arrays.select("mesh_id", F.posexplode("points").alias("vertex_id", "p")).select("mesh_id", "vertex_id", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    f = arrays.select("mesh_id", F.posexplode("triangles").alias("face_id", "t")).select("mesh_id", "face_id", *(F.get("t", F.lit(i)).alias(f"v{i}") for i in range(3)))
    return v, f
