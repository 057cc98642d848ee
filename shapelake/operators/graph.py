"""Graphs as edge tables: connected components, waves over a mesh's edges, segmentation by membership."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_sort
from ..storage import discard, materialize


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge and isn't its own root.

    Alternates large-star and small-star joins until nothing changes; every round is written to shared storage and
    the round before it deleted. A hot node is one row on the unique side of each join, so its neighbours can be
    split over tasks. Null ends and loops are left out; an empty edge table gives an empty result.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(by_sort(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(by_sort(lowest), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def mesh_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b): the distinct undirected edges of triangles, a < b."""
    pairs = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    return faces.select("mesh_id", pairs.alias("e")).select("mesh_id", "e.a", "e.b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("mesh_id", "a", "b").union(edges.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b")))


def expand_segmentation(segment: DataFrame, edges: DataFrame, waves: int) -> DataFrame:
    """(mesh_id, vertex_id): the segment and what ``waves`` steps along mesh edges reach."""
    links = both_ways(edges)
    for _ in range(waves):
        step = segment.withColumnRenamed("vertex_id", "a").join(by_sort(links), ["mesh_id", "a"]).select("mesh_id", F.col("b").alias("vertex_id"))
        segment = materialize(segment.union(step).distinct())
    return segment


def shrink_segmentation(segment: DataFrame, edges: DataFrame, waves: int) -> DataFrame:
    """(mesh_id, vertex_id): the segment less, ``waves`` times, its vertices that have a neighbour outside."""
    links = both_ways(edges)
    for _ in range(waves):
        inside = segment.withColumnRenamed("vertex_id", "b")
        border = links.join(by_sort(segment.withColumnRenamed("vertex_id", "a")), ["mesh_id", "a"], "left_semi").join(by_sort(inside), ["mesh_id", "b"], "left_anti")
        segment = materialize(segment.join(by_sort(border.select("mesh_id", F.col("a").alias("vertex_id")).distinct()), ["mesh_id", "vertex_id"], "left_anti"))
    return segment


def correct_segmentation(segment: DataFrame, edges: DataFrame, delta: int) -> DataFrame:
    """Expand by ``delta`` waves, or shrink by as many if it is negative."""
    return expand_segmentation(segment, edges, delta) if delta >= 0 else shrink_segmentation(segment, edges, -delta)


def faces_within(faces: DataFrame, segment: DataFrame) -> DataFrame:
    """Faces whose three corners all lie in the segment."""
    for corner in ("v0", "v1", "v2"):
        faces = faces.join(by_sort(segment.withColumnRenamed("vertex_id", corner)), ["mesh_id", corner], "left_semi")
    return faces.select("mesh_id", "face_id", "v0", "v1", "v2")


def split_meshes(faces: DataFrame, least: int = 10) -> DataFrame:
    """(mesh_id, face_id, part): parts of faces that share edges, of more than ``least`` faces; part is its first face."""
    edge = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    sides = faces.select("mesh_id", "face_id", edge.alias("e")).select("mesh_id", "face_id", "e.a", "e.b")
    first = sides.groupBy("mesh_id", "a", "b").agg(F.min("face_id").alias("first"))
    links = sides.join(by_sort(first), ["mesh_id", "a", "b"]).select(F.struct("mesh_id", "first").alias("x"), F.struct("mesh_id", F.col("face_id").alias("first")).alias("y"))
    roots = connected_components(links, "x", "y").select("node.mesh_id", F.col("node.first").alias("face_id"), F.col("root.first").alias("root"))
    parts = faces.select("mesh_id", "face_id").join(by_sort(roots), ["mesh_id", "face_id"], "left").withColumn("part", F.coalesce("root", "face_id")).drop("root")
    large = parts.groupBy("mesh_id", "part").count().filter(F.col("count") > least).select("mesh_id", "part")
    return parts.join(by_sort(large), ["mesh_id", "part"]).select("mesh_id", "face_id", "part")


def border_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b): edges of one face only."""
    edge = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    return faces.select("mesh_id", edge.alias("e")).groupBy("mesh_id", "e.a", "e.b").count().filter("count = 1").select("mesh_id", "a", "b")


def polyline_segments(points: DataFrame) -> DataFrame:
    """Each point of a line (line_id, seq, x, y, z) with the one after it: next, x1, y1, z1; the last has none."""
    row = Window.partitionBy("line_id").orderBy("seq")
    ahead = {"next": F.lead("seq").over(row)} | {f"{c}1": F.lead(c).over(row) for c in "xyz"}
    return points.withColumns(ahead).filter("next is not null")


def path_statistics(path: DataFrame, value: str, half: int) -> DataFrame:
    """(line_id, seq, mean, most) of ``value`` over the points up to ``half`` before and after each."""
    near = Window.partitionBy("line_id").orderBy("seq").rowsBetween(-half, half)
    return path.select("line_id", "seq", F.avg(value).over(near).alias("mean"), F.max(value).over(near).alias("most"))
