"""Every query with SQL gives the SQL's rows on the smallest tables; shapes with known answers."""

import math
import random

import pytest

from shapelake import catalog
from shapelake.operators import cluster, graph, groups, harmonics, mesh, pairs, rays, voxels
from shapelake.functions import vectors as V
from shapelake.sources.off import read_off, write_off
from shapelake.storage import scratch_dir

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def tetrahedron(spark):
    v = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0), ("t", 1, 1.0, 0.0, 0.0), ("t", 2, 0.0, 1.0, 0.0), ("t", 3, 0.0, 0.0, 1.0)], "mesh_id string, vertex_id int, x double, y double, z double")
    f = spark.createDataFrame([("t", 0, 0, 2, 1), ("t", 1, 0, 1, 3), ("t", 2, 0, 3, 2), ("t", 3, 1, 2, 3)], "mesh_id string, face_id int, v0 int, v1 int, v2 int")
    return v, f


def test_tetrahedron(spark):
    v, f = tetrahedron(spark)
    for g in (mesh.face_geometry(v, f), mesh.face_geometry_by_joins(v, f)):
        assert mesh.volume(g).first()["volume"] == pytest.approx(1 / 6)
        assert mesh.areas(g).first()["junction_area"] == 0
    turned = mesh.rotated(v, V.rotation(1.1, (0.0, 0.0, 1.0)))
    assert mesh.volume(mesh.face_geometry(turned, f)).first()["volume"] == pytest.approx(1 / 6)


def test_off_round_trip(spark):
    v, f = tetrahedron(spark)
    path = scratch_dir(spark)
    write_off(v, f, path)
    v2, f2 = read_off(spark, path, "*.txt")
    assert mesh.volume(mesh.face_geometry(v2, f2)).first()["volume"] == pytest.approx(1 / 6)


def test_components_and_linkage(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert {roots.get(i, i) for i in range(21)} == {0} and {roots.get(i, i) for i in range(21, 41)} == {21}
    items = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 10, 11, 12, 50])], "item long, x array<double>")
    p = pairs.pair_table(items, "item", "x", V.euclidean, blocks=3)
    assert p.count() == 15
    assert {(r["item"], r["label"]) for r in cluster.complete_linkage(p, 3).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (5, 5)}


def test_votes(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y"), ("a", 2, "x"), ("b", 2, "y"), ("a", 3, None), ("b", 3, None)]
    v = spark.createDataFrame(rows, "annotator string, item long, label string")
    assert {(r["item"], r["label"]) for r in groups.merge_votes(v).collect()} == {(1, "x"), (2, "x"), (3, None)}
    assert [r["item"] for r in groups.contested_items(v).collect()] == [2]


def test_lowest_merges(spark):
    r = random.Random(2)
    rows = [(i, i + 1, r.choice([0.5, 2.0, 1e-9, r.random(), 1e6 * r.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, d double")
    order = sorted(rows, key=lambda x: (x[2], x[0], x[1]))
    for n, ranges in ((-1, 4), (0, 4), (1, 2), (70, 2), (100, 1024), (299, 8), (300, 8), (500, 8)):
        assert sorted(map(tuple, cluster.lowest(df, n, ranges).collect())) == sorted(order[: max(0, n)])


def test_linkage_of_random_points(spark):
    r = random.Random(4)
    points = [(r.random(), r.random()) for _ in range(24)]
    d = {(i, j): math.dist(points[i], points[j]) for i in range(24) for j in range(i + 1, 24)}
    groups = [{i} for i in range(24)]
    while len(groups) > 5:
        far = lambda g, h: max(d[min(i, j), max(i, j)] for i in g for j in h)
        g, h = min(((g, h) for k, g in enumerate(groups) for h in groups[k + 1 :]), key=lambda p: far(*p))
        groups = [x for x in groups if x is not g and x is not h] + [g | h]
    got = cluster.complete_linkage(spark.createDataFrame([(i, j, x) for (i, j), x in d.items()], "a long, b long, d double"), 5)
    assert {(x["item"], x["label"]) for x in got.collect()} == {(i, min(g)) for g in groups for i in g}


def test_solid_block(spark):
    r = range(1, 6)
    v = spark.createDataFrame([("a", i, j, k, 255) for i in r for j in r for k in r], "image_id string, i int, j int, k int, value int")
    assert voxels.surface_voxels(v).count() == 98
    assert {x["size"] for x in voxels.voxel_components(v).collect()} == {125}
    full = spark.createDataFrame([("a", i, j, k, 7) for i in range(4) for j in range(4) for k in range(4)], "image_id string, i int, j int, k int, value int")
    assert all(math.isclose(x["value"], 7) for x in voxels.gaussian_smooth(full, (4, 4, 4)).collect())


def cube(spark, half=1.0):
    c = [(x * half, y * half, z * half) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    f = [t for a, b, d, e in quads for t in ((a, b, d), (a, d, e))]
    v = spark.createDataFrame([("c", i, *map(float, p)) for i, p in enumerate(c)], "mesh_id string, vertex_id int, x double, y double, z double")
    return v, spark.createDataFrame([("c", i, *t) for i, t in enumerate(f)], "mesh_id string, face_id int, v0 int, v1 int, v2 int")


def test_chords_of_a_cube(spark):
    v, f = cube(spark)
    parts = rays.with_centres(rays.subdivided(rays.triangles(v, f), 2))
    assert parts.count() == 12 * 16 and parts.agg({"area": "sum"}).first()[0] == pytest.approx(24)
    lines = rays.random_chords(parts, 200)
    found = rays.chord_lengths(lines, rays.triangles(v, f), 4, 2).toPandas()
    assert lines.count() == 200 and 0 < len(found) < 400 and found["length"].max() <= 2 * math.sqrt(3)
    out = rays.chord_distribution(v, f, chords=200, bins=10, rounds=1).toPandas()
    assert len(out) == 10 and out["density"].mean() == pytest.approx(1) and out["bin"].nunique() == 10


def test_harmonics(spark):
    d = harmonics.sphere_sample(spark, 40).cache()
    b = d.select(harmonics.basis(3, d["azimuth"], d["elevation"]).alias("b")).toPandas()["b"]
    gram = sum([[x * y for y in row] for x in row][i][j] for row in b for i, j in [(4, 4)]) * 4 * math.pi / len(b)
    assert gram == pytest.approx(1, abs=0.05)
    assert abs(sum(row[4] * row[6] for row in b)) * 4 * math.pi / len(b) < 0.05
    v, f = cube(spark, 2.0)
    c = harmonics.coefficients(v, f, d, degrees=5)
    r = harmonics.radii(v, f, d).toPandas()["r"]
    assert r.min() >= 2 - 1e-9 and r.max() <= 2 * math.sqrt(3) and len(r) == 1600
    assert c.first()["coefficients"][0] == pytest.approx(r.mean() * math.sqrt(4 * math.pi))
    assert harmonics.surface(c, d, degrees=5).toPandas()["r"].mean() == pytest.approx(r.mean(), rel=0.02)


def test_best_parameter(spark):
    rows = [(2, 0.5), (3, float("nan")), (5, 0.7), (4, 0.7), (9, None)]
    assert tuple(groups.best_parameter(spark.createDataFrame(rows, "k int, s double"), "k", "s").first()) == (4, 0.7)
