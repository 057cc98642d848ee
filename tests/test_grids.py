"""Crossings by grid, rays by buckets, pieces by arithmetic, hulls by insertion and light fields by spans against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import grid, harmonics, hull, rays, views, voxels

from .test_queries import cube

POINT = "struct<x: double, y: double, z: double>"


def meshes(spark, points, triangles):
    """(vertices, faces) of {mesh: points} and {mesh: triangles}."""
    v = [(m, i, *map(float, p)) for m, ps in points.items() for i, p in enumerate(ps)]
    f = [(m, i, *map(int, t)) for m, ts in triangles.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(v, "mesh_id string, vertex_id int, x double, y double, z double"), spark.createDataFrame(f, "mesh_id string, face_id int, v0 int, v1 int, v2 int")


def soup(spark, seed=1):
    """Random triangles: many small ones, a few large ones, and a flat mesh."""
    r = np.random.default_rng(seed)
    points = {"many": (r.normal(size=(300, 1, 3)) + r.normal(size=(300, 3, 3)) * 0.2).reshape(-1, 3), "few": r.normal(size=(12, 3)) * [1, 5, 0.1], "flat": np.c_[r.normal(size=(9, 2)), np.zeros(9)]}
    return meshes(spark, points, {m: np.arange(len(p)).reshape(-1, 3) for m, p in points.items()})


def test_grid_finds_what_all_pairs_find(spark):
    v, f = soup(spark)
    tri = rays.triangles(v, f)
    r = np.random.default_rng(2)
    lines = [(m, i, tuple(map(float, o)), tuple(map(float, d))) for m in ("many", "few", "flat", "none") for i, (o, d) in enumerate(r.normal(size=(60, 2, 3)))]
    lines += [("few", 100, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), ("few", 101, (9.0, 9.0, 9.0), (0.0, 0.0, 0.0)), ("many", 102, (0.0, 0.0, 0.0), (0.0, 0.0, -2.0)), ("many", 103, None, None)]
    lines = spark.createDataFrame(lines, f"mesh_id string, chord int, o {POINT}, d {POINT}")
    key = lambda df: sorted((x["mesh_id"], x["chord"], x["face_id"], round(x["t"], 6)) for x in df.collect())
    found = key(grid.grid_crossings(lines, tri, ["chord"], ["face_id"]))
    assert found == key(rays.crossings(lines.filter("o is not null"), tri)) and len(found) > 100
    many = grid.candidates(lines, tri, ["chord"], ["face_id"]).filter("mesh_id = 'many'").dropDuplicates(["chord", "face_id"]).count()
    assert many < 0.35 * 61 * 300
    assert grid.grid_crossings(lines.limit(0), tri, ["chord"], ["face_id"]).count() == 0


@pytest.mark.parametrize("kind,rounds", [(4, 3), (3, 7)])
def test_pieces_without_cutting(spark, kind, rounds):
    tri = rays.triangles(*cube(spark))
    deep = [] if kind == 4 else [F.col("depth")]
    cut = rays.with_centres(rays.subdivided(tri, rounds) if kind == 4 else rays.subdivided_by_area(tri))
    flat = rays._flat(tri, "face_id") if kind == 4 else rays._flat(rays.area_depths(tri), "face_id", "depth")
    at = rays.piece_centre(cut.select("mesh_id", "face_id", "part", "centre").join(flat, ["mesh_id", "face_id"]), kind, rounds, *deep)
    off = sum((F.abs(rays._place(c, "cu", "cv") - F.col(f"centre.{c}")) for c in "xyz"), F.lit(0.0))
    back = rays.piece_at(at.withColumn("off", off).withColumnsRenamed({"cu": "u", "cv": "v", "part": "want"}), kind, rounds, *deep)
    n, far, wrong = back.agg(F.count("*"), F.max("off"), F.sum((F.col("part") != F.col("want")).cast("int"))).first()
    assert n == cut.count() and far < 1e-9 and wrong == 0


def test_drawn_chords(spark):
    tri = rays.triangles(*cube(spark))
    parts = rays.with_centres(rays.subdivided(tri, 2))
    key = lambda df: {(x["chord"], *(round(c, 9) for p in "od" for c in x[p])) for x in df.collect()}
    assert key(rays.chords_of_faces(tri, 2, 50)) == key(rays.random_chords(parts, 50))
    uneven = parts.filter("face_id > 0 or part = 0")  # face 0 has one piece, the others 16
    starts = [rays.random_chords(uneven, 600, per_face=x).join(uneven.filter("face_id = 0").select("mesh_id", "centre"), "mesh_id").filter("o = centre").count() for x in (False, True)]
    assert starts[0] < 20 < 30 < starts[1] < 75  # one in 177, one in 12
    assert rays.random_chords(parts.limit(1), 5).count() == 0


def test_chords_by_area(spark):
    """Lines against whole faces give the lengths that lines against all pieces give."""
    v, f = cube(spark)
    tri = rays.triangles(v, f)
    got = rays.mesh_chords(v, f, chords=40, largest=0.01).toPandas()
    parts = rays.with_centres(rays.subdivided_by_area(tri, 0.01))
    hits = rays.crossings(rays.random_chords(parts, 40), parts).toPandas()
    want = {}
    for chord, h in hits.groupby("chord"):
        if len(h) == 2:  # others pass a border between pieces
            a, b = (np.array(x) for x in h["centre"])
            want[chord] = np.linalg.norm(a - b)
    assert len(want) > 20
    got = got.set_index("chord")["length"].to_dict()
    assert all(got[c] == pytest.approx(x) for c, x in want.items() if x > 0)


def test_radii_by_buckets(spark):
    """Triangles round the poles and the turn of the azimuth, an open mesh, several crossings, and a mesh without any."""
    r = np.random.default_rng(4)
    v, f = soup(spark, 5)
    c, g = cube(spark)
    v, f = v.filter("mesh_id <> 'flat'").union(c), f.filter("mesh_id <> 'flat'").union(g.filter("face_id <> 3"))
    centres = spark.createDataFrame([("many", (0.1, 0.2, 0.1)), ("few", (0.0, 0.0, 0.0)), ("c", (0.3, -0.2, 0.4)), ("gone", (0.0, 0.0, 0.0))], f"mesh_id string, o {POINT}")
    d = harmonics.sphere_sample(spark, 15).union(spark.createDataFrame([(1000, 0.0, 0.0), (1001, 0.0, math.pi), (1002, -3.0, 1.0)], "dir_id long, azimuth double, elevation double"))
    rows = {(x["mesh_id"], x["dir_id"]): x["r"] for x in harmonics.radii(v, f, d, centres).collect()}
    at = {x["mesh_id"]: np.array(x["o"]) for x in centres.collect()}
    corner = {(x["mesh_id"], x["vertex_id"]): np.array([x["x"], x["y"], x["z"]]) for x in v.collect()}
    want, shape = {}, f.collect()
    for x in d.collect():
        ray = np.array([math.sin(x["elevation"]) * math.cos(x["azimuth"]), math.sin(x["elevation"]) * math.sin(x["azimuth"]), math.cos(x["elevation"])])
        for t in shape:
            m = t["mesh_id"]
            a, b, e = (corner[m, t[k]] - at[m] for k in ("v0", "v1", "v2"))
            both = np.column_stack([ray, a - b, a - e])
            if abs(np.linalg.det(both)) < 1e-9:  # within the triangle's plane
                continue
            s, u, w = np.linalg.solve(both, a)
            if s > 0 and u >= -1e-9 and w >= -1e-9 and u + w <= 1 + 1e-9:
                want[m, x["dir_id"]] = min(s, want.get((m, x["dir_id"]), math.inf))
    assert {m for m, _ in rows} == {"many", "few", "c"} and len(rows) == 3 * 228 > len(want)
    for m in ("many", "few", "c"):
        mean = np.mean([s for (n, _), s in want.items() if n == m])
        assert all(rows[k] == pytest.approx(want.get(k, mean)) for k in rows if k[0] == m)
    assert harmonics.radii(v.limit(0), f.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        harmonics.surface(spark.createDataFrame([], "mesh_id string, coefficients array<double>"), spark.range((1 << 20) + 1).withColumnRenamed("id", "dir_id"))


def hull_by_hand(p):
    total, mid = 0.0, p.mean(axis=0)
    for i in itertools.combinations(range(len(p)), 3):
        a, b, c = p[list(i)]
        n = np.cross(b - a, c - a)
        side = (p - a) @ n
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            total += abs(np.dot(a - mid, np.cross(b - mid, c - mid))) / 6
    return total


def test_hulls(spark):
    r = np.random.default_rng(6)
    ball = r.normal(size=(26, 3))
    points = {"ball": ball / np.linalg.norm(ball, axis=1)[:, None] + 50, "cloud": r.normal(size=(40, 3)) * [1, 1, 3], "box": list(itertools.product((0, 1, 2), repeat=3)), "flat": [(x, y, 0) for x in range(3) for y in range(3)], "line": [(x, 0, 0) for x in range(5)], "one": [(1, 1, 1)] * 4}
    v, _ = meshes(spark, points, {"ball": [(0, 1, 2)]})
    found = {x["mesh_id"]: x["hull_volume"] for x in hull.hull_volumes(v).collect()}
    assert {m: found[m] for m in ("flat", "line", "one")} == {"flat": 0, "line": 0, "one": 0}
    assert found["box"] == pytest.approx(8, abs=1e-9)
    for m in ("ball", "cloud"):
        assert found[m] == pytest.approx(hull_by_hand(np.array(points[m])), rel=1e-9)


def mask_by_hand(tri, side):
    """Pixels of triangles (n, 3, 2), each tested for itself."""
    centre, radius = views.enclosing_circle(tri.reshape(-1, 2))
    x, y = np.meshgrid(np.arange(side), np.arange(side), indexing="ij")
    mask = np.zeros((side, side), bool)
    for t in (tri - centre) * (side / 2 / radius) + side / 2:
        s = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(t, np.roll(t, -1, axis=0), strict=True)]
        mask |= (np.min(s, axis=0) >= -1e-9) | (np.max(s, axis=0) <= 1e-9)
    return mask


def largest(mask):
    left, parts = {*zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, part = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                part.add(p)
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        parts.append(part)
    out = np.zeros_like(mask)
    out[tuple(zip(*max(parts, key=len), strict=True))] = True
    return out


def test_light_field_of_parts(spark):
    """A mesh in two parts, one with a notch that breaks rows, and one without extent."""
    bent = np.array([[0, 0, 0], [4, 0, 0], [4, 1, 0], [0, 1, 0], [0, 3, 0], [4, 3, 0], [4, 4, 0], [0, 4, 0], [1, 0, 0], [1, 4, 0]], float) @ np.array([[0.9, 0.1, 0.3], [-0.2, 1, 0], [0, 0.3, 1]])
    strips = [(0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7), (0, 8, 9), (0, 9, 7)]
    v, f = meshes(spark, {"bent": bent, "two": np.r_[bent, bent * 0.3 + [9, 1, 2]], "point": [(1, 1, 1)] * 3}, {"bent": strips, "two": strips + [(a + 10, b + 10, c + 10) for a, b, c in strips], "point": [(0, 1, 2)]})
    rows = {(x["mesh_id"], x["view"]): x["moments"] for x in views.light_field(v, f, 3, 4, 64).collect()}
    inside, values = views.zernike_basis(64, 4)
    scale = np.array([(n + 1) / math.pi for n, _ in views.degrees(4)])
    corner = {(x["mesh_id"], x["vertex_id"]): (x["x"], x["y"], x["z"]) for x in v.collect()}
    assert len(rows) == 9
    for (m, view), got in rows.items():
        tri = np.array([[corner[m, t[k]] for k in ("v0", "v1", "v2")] for t in f.filter(F.col("mesh_id") == m).collect()]) @ views.view_plane(*views.VIEWS[3][view])
        if m == "point":
            assert got is None
            continue
        mask = largest(mask_by_hand(tri, 64)).ravel()[inside]
        want = values[mask].sum(axis=0).conj() / mask.sum() * scale
        assert np.allclose([complex(x["re"], x["im"]) for x in got], want)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_components_over_blocks(spark, block):
    """Snakes through several blocks, negative coordinates, two images: as by joins of all neighbours."""
    from shapelake.operators.graph import connected_components

    filled = [(m, i, j, k) for m in (1, 2) for i in range(-3, 5) for j in range(-2, 6) for k in range(3) if (i * 7 + j * 5 + k * 3 + m) % 4 < 2]
    v = spark.createDataFrame([(*p, 9) for p in filled] + [(1, 20, 20, 20, 0)], "image_id int, i int, j int, k int, value int")
    pairs = [(p, (p[0], p[1] + a, p[2] + b, p[3] + c)) for p in filled for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    edges = spark.createDataFrame([e for e in pairs if e[1] in set(filled)], "a struct<m int, i int, j int, k int>, b struct<m int, i int, j int, k int>")
    root = {tuple(r["node"]): tuple(r["root"]) for r in connected_components(edges).collect()}
    root = {p: root.get(p, p) for p in filled}
    size = {r: list(root.values()).count(r) for r in root.values()}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in voxels.voxel_components(v, least=2, block=block).collect()}
    assert got == {p: (*r[1:], size[r]) for p, r in root.items() if size[r] >= 2} and len({g[:3] for g in got.values()}) > 1


def test_components_of_small_images_need_no_joins(spark, monkeypatch):
    """Links between voxels of one block don't reach the rounds of joins."""
    seen = []
    real = voxels.connected_components
    monkeypatch.setattr(voxels, "connected_components", lambda e, *n: (seen.append(e.count()), real(e, *n))[1])
    v = spark.createDataFrame([(1, i, j, 0, 1) for i in range(5) for j in range(5)], "image_id int, i int, j int, k int, value int")
    assert {r["size"] for r in voxels.voxel_components(v).collect()} == {25} and seen == [0]
