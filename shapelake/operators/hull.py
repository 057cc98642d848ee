"""Convex hulls of all meshes at once, by insertion: every round is a handful of joins by mesh, whatever their number.

Each point outside is kept with one face that it is outside of. In a round the farthest points of a mesh's faces are its
eyes; an eye sees the faces that it is outside of, and those of them whose faces, with all that border on them, no eye
farther out claims are put in together: their faces go, new ones join the border to the eye, and the points of the faces
that went look for a new face. The farthest eye always goes in, so every round brings a mesh nearer its end.

A mesh of few vertices needs no rounds: the task that holds it puts in its points one by one, the farthest first.

To be in general position, points are moved by up to 1e-9 of the mesh's size, by hash, for every decision; volumes are
those of the points as they were.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_sort, spread
from ..storage import discard, materialize
from .mesh import face_geometry, volume
from .packed import MOST, Meshes, larger, packed, split, work

#: How far points are moved, and how far outside a face a point must be, in the mesh's sizes.
MOVE, LEAST = 1e-9, 1e-14


def _sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _at(p: str) -> list[Column]:
    return [F.col(f"{p}.{c}") for c in "xyz"]


def _with_plane(faces: DataFrame) -> DataFrame:
    """faces (mesh_id, a, b, c: points) with ``face``, a name, and ``plane``: a unit normal and where it lies along it."""
    n = _cross(_sub(_at("b"), _at("a")), _sub(_at("c"), _at("a")))
    f = faces.select("*", *(x.alias(f"n{k}") for k, x in zip("xyz", n, strict=True)))
    size = F.sqrt(_dot([F.col("nx"), F.col("ny"), F.col("nz")], [F.col("nx"), F.col("ny"), F.col("nz")]))
    f = f.withColumn("size", size)
    unit = [F.coalesce(F.try_divide(F.col(f"n{k}"), F.col("size")), F.lit(0.0)) for k in "xyz"]
    plane = F.struct(*(u.alias(k) for u, k in zip(unit, "xyz", strict=True)), _dot(unit, _at("a")).alias("off"))
    return f.select("mesh_id", F.concat_ws(" ", "a.id", "b.id", "c.id").alias("face"), "a", "b", "c", plane.alias("plane"))


def _outside(p: str) -> Column:
    """How far a point is outside of ``plane``."""
    return _dot(_at("plane"), _at(p)) - F.col("plane.off")


def _first(points: DataFrame) -> DataFrame:
    """(mesh_id, a, b, c: points): the faces, facing out, of a tetrahedron of each mesh that has one."""
    far = lambda d: F.max_by("p", F.struct(d, -F.col("p.id")))
    gone = points.groupBy("mesh_id").agg(F.min_by("p", F.struct("p.x", "p.y", "p.z", "p.id")).alias("s0"))
    now = points.join(by_sort(gone), "mesh_id")
    two = _sub(_at("p"), _at("s0"))
    now = now.join(by_sort(now.groupBy("mesh_id").agg(far(_dot(two, two)).alias("s1"))), "mesh_id")
    off = _cross(_sub(_at("s1"), _at("s0")), _sub(_at("p"), _at("s0")))
    now = now.join(by_sort(now.groupBy("mesh_id").agg(far(_dot(off, off)).alias("s2"))), "mesh_id")
    high = _dot(_cross(_sub(_at("s1"), _at("s0")), _sub(_at("s2"), _at("s0"))), _sub(_at("p"), _at("s0")))
    four = now.groupBy("mesh_id", "s0", "s1", "s2").agg(far(F.abs(high)).alias("s3"), F.max_by(high, F.struct(F.abs(high), -F.col("p.id"))).alias("high"), F.first("least").alias("least"))
    # a tetrahedron that is only there because points were moved is none
    long, wide = _sub(_at("s1"), _at("s0")), _cross(_sub(_at("s1"), _at("s0")), _sub(_at("s2"), _at("s0")))
    thin = F.col("least") * (10 * MOVE / LEAST)
    four = four.filter((F.sqrt(_dot(wide, wide)) > thin * F.sqrt(_dot(long, long))) & (F.abs("high") > thin * F.sqrt(_dot(wide, wide))))
    # the last point must lie below the others' face, else two of them change places
    face = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    sides = lambda x, y: F.array(face("s0", x, y), face(x, "s0", "s3"), face(y, x, "s3"), face("s0", y, "s3"))
    return four.select("mesh_id", F.explode(F.when(F.col("high") < 0, sides("s1", "s2")).otherwise(sides("s2", "s1"))).alias("f")).select("mesh_id", "f.*")


def _farthest(met: DataFrame) -> DataFrame:
    """(mesh_id, least, p, face, out): each point with the face that it is farthest outside of, if any."""
    best = F.max_by(F.struct("face", "out"), F.struct("out", "face")).alias("best")
    return met.withColumn("out", _outside("p")).filter(F.col("out") > F.col("least")).groupBy("mesh_id", F.col("p.id").alias("id")).agg(F.first("p").alias("p"), F.first("least").alias("least"), best).select("mesh_id", "least", "p", "best.face", "best.out")


def _edges(faces: DataFrame, *more: str) -> DataFrame:
    """(mesh_id, face, u, v: points) for each side of a face, as it runs round it."""
    side = F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select("mesh_id", "face", *more, side.alias("e")).select("mesh_id", "face", *more, "e.u", "e.v")


def _moves() -> list[Column]:
    """How far a point is moved along each axis, in ``MOVE`` of its mesh's size."""
    return [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / (1 << 19) - 1 for k in range(3)]


def _put_in(p: np.ndarray, size: float) -> np.ndarray:
    """The hull's triangles of points that are in general position, as places in p, facing out; none for a flat mesh."""
    none, least, thin = np.zeros((0, 3), int), size * LEAST, size * 10 * MOVE
    if len(p) < 4:
        return none
    norm = lambda v: np.einsum("ij,ij->i", v, v)
    s0 = np.lexsort(p.T[::-1])[0]
    away = p - p[s0]
    s1 = norm(away).argmax()
    off = np.cross(away[s1], away)
    s2 = norm(off).argmax()
    wide = off[s2]
    high = away @ wide
    s3 = np.abs(high).argmax()
    if not (norm(wide[None])[0] ** 0.5 > thin * norm(away[s1][None])[0] ** 0.5 and abs(high[s3]) > thin * norm(wide[None])[0] ** 0.5):
        return none
    x, y = (s1, s2) if high[s3] < 0 else (s2, s1)
    faces = np.array([(s0, x, y), (x, s0, s3), (y, x, s3), (s0, y, s3)])

    def out(few: np.ndarray) -> np.ndarray:  # how far each point is outside of some faces
        a = p[few[:, 0]]
        u, v = p[few[:, 1]] - a, p[few[:, 2]] - a
        n = np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], axis=1)
        n /= np.maximum(np.sqrt(norm(n)), 1e-300)[:, None]
        return n @ p.T - np.einsum("ij,ij->i", n, a)[:, None]

    far, put = out(faces), np.zeros(len(p), bool)
    put[[s0, s1, s2, s3]] = True
    while True:
        beyond = far.max(axis=0)
        beyond[put] = -np.inf
        eye = beyond.argmax()
        if not beyond[eye] > least:
            return faces
        put[eye] = True
        seen = far[:, eye] > least
        sides = [e for a, b, c in faces[seen].tolist() for e in ((a, b), (b, c), (c, a))]
        inner = set(sides)
        new = np.array([(a, b, eye) for a, b in sides if (b, a) not in inner])
        faces, far = np.concatenate([faces[~seen], new]), np.concatenate([far[~seen], out(new)])


def _hull_of(meshes: Meshes, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles as places, the points' ids, the points) of a packed mesh; points at one place or with one id count once."""
    at = slice(meshes.at[i], meshes.at[i + 1])
    ids, p, move = meshes.id[at], meshes.xyz[at], meshes.more[at]
    order = np.argsort(ids, kind="stable")
    order = order[~np.isnan(p[order]).any(axis=1)]
    order = order[np.unique(ids[order], return_index=True)[1]]
    _, first = np.unique(p[order] + 0.0, axis=0, return_index=True)
    size = np.ptp(p[order], axis=0).max() if len(order) else 0.0
    order = order[np.sort(first)]
    ids, p = ids[order], p[order]
    return _put_in(p + size * MOVE * move[order], size), ids, p


def _packed(vertices: DataFrame) -> DataFrame:
    v = vertices.withColumn("id", F.col("vertex_id").cast("long"))
    return packed(v.withColumns({f"m{k}": m for k, m in enumerate(_moves())}), None, "m0", "m1", "m2")


def convex_hulls(vertices: DataFrame, eyes: int = 8, most: int = MOST) -> DataFrame:
    """(mesh_id, v0, v1, v2): the hulls' triangles, facing out. ``eyes`` points of a mesh at most are put in in a round.

    Vertices at one place, or with the same id in a mesh, count once; those with a null are left out. A mesh that is flat,
    or has fewer than four vertices, has no hull. The state is written every round and a round's former state deleted.
    Meshes of up to ``most`` vertices take no part in the rounds.
    """
    if most:

        def find(meshes: Meshes, i: int, name: str):
            faces, ids, _ = _hull_of(meshes, i)
            return list(ids[faces].T) if len(faces) else None

        (few,), rest = split(larger(vertices, None, most), vertices)
        found = work(_packed(few), find, "v0 long, v1 long, v2 long")
        return found.unionByName(convex_hulls(*rest, eyes, 0)) if rest else found
    v = vertices.select("mesh_id", F.col("vertex_id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna().dropDuplicates(["mesh_id", "id"])
    box = v.groupBy("mesh_id").agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("size")).filter("size > 0")
    moved = [(F.col(c) + F.col("size") * MOVE * m).alias(c) for m, c in zip(_moves(), "xyz", strict=True)]
    points = v.dropDuplicates(["mesh_id", "x", "y", "z"]).join(by_sort(box), "mesh_id").select("mesh_id", (F.col("size") * LEAST).alias("least"), F.struct("id", *moved).alias("p"))
    points = materialize(points)
    faces = materialize(_with_plane(_first(points)))
    outside = materialize(_farthest(points.join(by_sort(faces), "mesh_id")))
    discard(points)
    done = []
    while not outside.isEmpty():
        open_ = outside.select("mesh_id").distinct()
        done.append(materialize(faces.join(by_sort(open_), "mesh_id", "left_anti").select("mesh_id", *(F.col(f"{c}.id").alias(n) for c, n in zip("abc", ("v0", "v1", "v2"), strict=True))), tidy=False))
        faces, outside = _round(faces.join(by_sort(open_), "mesh_id", "left_semi"), outside, eyes, (faces, outside))
    out = faces.select("mesh_id", *(F.col(f"{c}.id").alias(n) for c, n in zip("abc", ("v0", "v1", "v2"), strict=True)))
    for d in done:
        out = out.unionByName(d)
    return out


def _round(faces: DataFrame, outside: DataFrame, eyes: int, old: tuple) -> tuple[DataFrame, DataFrame]:
    far = outside.groupBy("mesh_id", "face").agg(F.max_by(F.struct("p", "out"), F.struct("out", F.col("p.id"))).alias("e"), F.first("least").alias("least"))
    order = Window.partitionBy("mesh_id").orderBy(F.desc("e.out"), "e.p.id")
    looking = far.select("mesh_id", "least", F.col("e.p").alias("eye"), F.row_number().over(order).alias("rank")).filter(F.col("rank") <= eyes)
    seen = spread(faces, "mesh_id", "face").join(by_sort(looking), "mesh_id").filter(_outside("eye") > F.col("least")).select("mesh_id", "face", "a", "b", "c", "eye", "rank")
    sides = _edges(seen, "eye", "rank").select("mesh_id", "face", "rank", "eye", "u", "v", F.col("u.id").alias("i"), F.col("v.id").alias("j"))
    across = _edges(faces).select("mesh_id", F.col("face").alias("next"), F.col("v.id").alias("i"), F.col("u.id").alias("j"))
    sides = sides.join(by_sort(across), ["mesh_id", "i", "j"]).persist()
    # an eye goes in if it is the first to claim every face that it sees or that borders on one
    claims = sides.select("mesh_id", "rank", "face").union(sides.select("mesh_id", "rank", "next")).distinct()
    first = claims.withColumn("first", F.min("rank").over(Window.partitionBy("mesh_id", "face")))
    chosen = first.groupBy("mesh_id", "rank").agg(F.min(F.col("first") == F.col("rank")).alias("in")).filter("in").select("mesh_id", "rank")
    put = sides.join(by_sort(chosen), ["mesh_id", "rank"])
    gone = put.select("mesh_id", "rank", "face").distinct()
    border = put.join(by_sort(gone.select("mesh_id", "rank", F.col("face").alias("next"))), ["mesh_id", "rank", "next"], "left_anti")
    new = (_with_plane(border.select("mesh_id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("eye").alias("c")))).persist()
    gone = gone.join(by_sort(put.select("mesh_id", "rank", F.col("eye.id").alias("eye_id")).distinct()), ["mesh_id", "rank"]).select("mesh_id", "face", "eye_id").persist()
    lost = outside.join(by_sort(gone), ["mesh_id", "face"]).filter(F.col("p.id") != F.col("eye_id")).select("mesh_id", "least", "p", "eye_id")
    found = _farthest(lost.join(by_sort(new.withColumn("eye_id", F.col("c.id"))), ["mesh_id", "eye_id"]))
    outside = materialize(outside.join(by_sort(gone), ["mesh_id", "face"], "left_anti").unionByName(found), tidy=False)
    faces = materialize(faces.join(by_sort(gone), ["mesh_id", "face"], "left_anti").select(*new.columns).unionByName(new), tidy=False)
    for t in (sides, new, gone):
        t.unpersist()
    for t in old:
        discard(t)
    return faces, outside


def hull_volumes(vertices: DataFrame, eyes: int = 8, most: int = MOST) -> DataFrame:
    """(mesh_id, hull_volume): 0 for a mesh that has no hull."""
    if most:

        def find(meshes: Meshes, i: int, name: str):
            faces, _, p = _hull_of(meshes, i)
            a, b, c = (p[faces] - p[:1]).transpose(1, 0, 2) if len(faces) else np.zeros((3, 0, 3))
            return [np.array([np.einsum("ij,ij->", a, np.cross(b, c)) / 6])]

        (few,), rest = split(larger(vertices, None, most), vertices)
        found = few.select("mesh_id").distinct().join(by_sort(work(_packed(few), find, "hull_volume double")), "mesh_id", "left").fillna(0.0, ["hull_volume"])
        return found.unionByName(hull_volumes(*rest, eyes, 0)) if rest else found
    hulls = convex_hulls(vertices, eyes, 0)
    for i in range(3):
        hulls = hulls.join(by_sort(vertices.select("mesh_id", F.col("vertex_id").cast("long").alias(f"v{i}"), F.struct("x", "y", "z").alias(f"p{i}")).dropDuplicates(["mesh_id", f"v{i}"])), ["mesh_id", f"v{i}"])
    # from a point of the hull, so that small meshes far from the origin keep their digits
    first = Window.partitionBy("mesh_id")
    hulls = hulls.withColumn("o", F.min(F.struct("v0", "p0")).over(first)["p0"])
    corner = [_sub(_at(f"p{i}"), _at("o")) for i in range(3)]
    found = hulls.groupBy("mesh_id").agg((F.sum(_dot(corner[0], _cross(corner[1], corner[2]))) / 6).alias("hull_volume"))
    return vertices.select("mesh_id").distinct().join(by_sort(found), "mesh_id", "left").fillna(0.0, ["hull_volume"])


def hull_ratios(vertices: DataFrame, faces: DataFrame, eyes: int = 8, most: int = MOST) -> DataFrame:
    """(mesh_id, hull_volume, hull_ratio): the convex hull's volume and how much larger it is than the mesh's, in the mesh's
    volumes; null for a mesh without volume."""
    both = hull_volumes(vertices, eyes, most).join(by_sort(volume(face_geometry(vertices, faces))), "mesh_id")
    return both.select("mesh_id", "hull_volume", F.try_divide(F.col("hull_volume") - F.col("volume"), F.col("volume")).alias("hull_ratio"))
