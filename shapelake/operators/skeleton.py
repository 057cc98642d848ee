"""Skeletons of meshes as graphs of points: edges, the backbone, and the segmentation by distance from it."""

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_sort
from ..functions.vectors import point_key
from .graph import polyline_segments


def skeleton_edges(points: DataFrame) -> DataFrame:
    """(mesh_id, a, b, w): the distinct edges a < b of lines (mesh_id, line_id, seq, x, y, z); nodes are rounded points as text."""
    lines = points.withColumns({"line_id": F.struct("mesh_id", "line_id")})
    seg = polyline_segments(lines).select("mesh_id", *(F.col(f"{c}{s}") for s in ("", "1") for c in "xyz"))
    name = lambda s: F.concat_ws(" ", *(point_key(*(F.col(f"{c}{s}") for c in "xyz")).getField(c) + 0.0 for c in "xyz"))
    length = F.sqrt(sum((F.pow(F.col(c) - F.col(f"{c}1"), 2) for c in "xyz"), F.lit(0.0)))
    seg = seg.select("mesh_id", name("").alias("p"), name("1").alias("q"), length.alias("w")).filter("p <> q")
    return seg.groupBy("mesh_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("w").alias("w"))


def backbone(edges: DataFrame) -> DataFrame:
    """(mesh_id, seq, node): the longest path of each mesh's skeleton tree, counted in nodes, ties of a sweep to the straighter.

    Straightness is the sum of the cosines at the turns. Two sweeps find the path, the first from the smallest node. In
    a skeleton with cycles each sweep keeps the shortest ways. A mesh's skeleton is one group, as a mesh is one file.
    """
    kind = edges.schema["mesh_id"].dataType.simpleString()

    def sweep(near, start):
        seen, front, still = {start: (0, 0.0, None, (0.0, 0.0, 0.0))}, [start], (0.0, 0.0, 0.0)
        while front:
            after = []
            for u in front:
                for v in near[u]:
                    if v not in seen:
                        step = tuple(q - p for p, q in zip(map(float, u.split()), map(float, v.split()), strict=True))
                        step = tuple(x / math.hypot(*step) for x in step) if any(step) else still
                        seen[v] = (seen[u][0] + 1, seen[u][1] + sum(p * q for p, q in zip(seen[u][3], step, strict=True)), u, step)
                        after.append(v)
            front = after
        return max(sorted(seen), key=lambda n: seen[n][:2]), seen

    def path(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for a, b in sorted(zip(rows["a"], rows["b"], strict=True)):
            near[a].append(b)
            near[b].append(a)
        best, done = [], set()
        for start in sorted(near):  # the longest of all parts
            if start not in done:
                end, seen = sweep(near, start)
                done |= seen.keys()
                node, seen = sweep(near, end)
                nodes = []
                while node is not None:
                    nodes.append(node)
                    node = seen[node][2]
                best = max(best, nodes, key=len)
        return pd.DataFrame({"mesh_id": key[0], "seq": range(len(best)), "node": best})

    return edges.groupBy("mesh_id").applyInPandas(path, f"mesh_id {kind}, seq int, node string")


def segment_by_distance(surface: DataFrame, path: DataFrame, sensitivity: float = 0.75) -> DataFrame:
    """(mesh_id, vertex_id) off the backbone, or farther from it than the quantile ``sensitivity`` of its own points.

    surface: (mesh_id, vertex_id, node, d), each vertex with its skeleton node and the distance from it; path: (mesh_id,
    node). A mesh without backbone is all segment.
    """
    on = path.select("mesh_id", "node").distinct().withColumn("on", F.lit(True))
    s = surface.select("mesh_id", "vertex_id", "node", "d").join(by_sort(on), ["mesh_id", "node"], "left")
    cut = s.filter("on").groupBy("mesh_id").agg(F.percentile("d", sensitivity).alias("cut"))
    return s.join(by_sort(cut), "mesh_id", "left").filter(F.col("on").isNull() | (F.col("d") > F.col("cut"))).select("mesh_id", "vertex_id")


def points_of(vertices: DataFrame) -> DataFrame:
    """(point): the distinct rounded points of meshes."""
    return vertices.select(point_key(F.col("x"), F.col("y"), F.col("z")).alias("point")).distinct()


def vertex_groups(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """vertices with the smallest ``label`` of the parts (x, y, z, label) that hold the same rounded point, else null."""
    at = point_key(F.col("x"), F.col("y"), F.col("z"))
    first = parts.groupBy(at.alias("__p")).agg(F.min("label").alias("label"))
    return vertices.withColumn("__p", at).join(by_sort(first), "__p", "left").drop("__p")


def interior_centres(vertices: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(mesh_id, x, y, z): the bounding box's centre, or, with skeleton segments (mesh_id, x, y, z, x1, y1, z1), its foot
    on the nearest of their lines. A mesh without segments keeps the centre."""
    box = vertices.groupBy("mesh_id").agg(*(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"))
    own = box.select("mesh_id", *(F.col(f"c{c}").alias(c) for c in "xyz"))
    if segments is None:
        return own
    s = segments.join(by_sort(box), "mesh_id")
    along = {c: F.col(f"{c}1") - F.col(c) for c in "xyz"}
    square = sum((d * d for d in along.values()), F.lit(0.0))
    t = sum(((F.col(f"c{c}") - F.col(c)) * along[c] for c in "xyz"), F.lit(0.0)) / square
    foot = s.filter(square > 0).select("mesh_id", *(f"c{c}" for c in "xyz"), *((F.col(c) + t * along[c]).alias(c) for c in "xyz"))
    far = sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in "xyz"), F.lit(0.0))
    near = foot.groupBy("mesh_id").agg(F.min_by(F.struct(*"xyz"), F.struct(far, *"xyz")).alias("f"))
    return own.join(by_sort(near), "mesh_id", "left").select("mesh_id", *(F.coalesce(f"f.{c}", c).alias(c) for c in "xyz"))
