"""Hulls, orientation, holes, light fields and skeletons of shapes with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import graph, harmonics, hull, mesh, rays, shape, skeleton, views
from shapelake.plans import tables as T

from .test_queries import SF, cube


def test_hull(spark):
    v, f = cube(spark)
    assert shape.hull_ratios(v, f, 2).first()["hull_volume"] == pytest.approx(8)
    out = shape.hull_ratios(*T.prisms(spark, SF)).toPandas()  # prisms are convex
    assert len(out) and out["hull_ratio"].between(-0.1, 1e-6).all()


def test_closing_a_hole(spark):
    v, f = cube(spark)
    v2, f2 = shape.closed(v, f.filter("face_id >= 4"))  # two sides are missing
    assert v2.count() == 10 and f2.count() == 8 + 8
    assert graph.border_edges(f2).count() == 0
    assert mesh.volume(mesh.face_geometry(v2, f2)).first()["volume"] == pytest.approx(8)
    v3, f3 = shape.closed(v, f)
    assert v3.count() == 8 and f3.count() == 12


def test_orientation(spark):
    v, f = T.prisms(spark, SF)
    v = mesh.scaled(v, 2.0, 1.0, 1.0)
    out = shape.oriented(v, f)
    n = mesh.junction_faces(mesh.face_geometry(out, f)).filter("junction").groupBy("mesh_id").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz"))).toPandas()
    assert np.allclose(n[["nx", "nz"]], 0, atol=1e-6) and (n["ny"] < 0).all()
    a, b = (mesh.volume(mesh.face_geometry(x, f)).toPandas().sort_values("mesh_id")["volume"] for x in (v, out))
    assert np.allclose(a, b)
    c, g = cube(spark)  # no junction
    assert sorted(map(tuple, shape.oriented(c, g).collect())) == sorted(map(tuple, c.collect()))


def test_light_field(spark):
    inside, values = views.zernike_basis(200, 6)
    gram = values.conj().T @ values / len(inside) * [n + 1 for n, _ in views.degrees(6)]
    assert np.allclose(gram, np.eye(len(gram)), atol=0.05)
    points = np.random.default_rng(1).normal(size=(30, 2))
    centre, radius = views.enclosing_circle(points)
    far = np.hypot(*(points - centre).T)
    assert far.max() == pytest.approx(radius) and (far > radius - 1e-6).sum() >= 2
    v, f = cube(spark)
    m = views.light_field(v, f, views=5, order=6, side=100)
    rows = m.toPandas()
    assert len(rows) == 5 and all(x[0]["re"] == pytest.approx(1 / math.pi) for x in rows["moments"])
    square = views.silhouette_rows(v, f, 3, 200).filter("view = 0").toPandas()  # in a circle of radius 100
    assert square["n"].sum() / 200**2 == pytest.approx(2 / math.pi * math.pi / 4, abs=0.02)
    image = views.recovered_images(m.filter("view = 0"), 30, 6).toPandas()
    assert image.loc[image["value"].idxmax(), "value"] > 3 * abs(image["value"].min())
    with pytest.raises(ValueError):
        views.light_field(v, f, views=4)


def test_light_field_distance(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(2, 3, 4, 2))
    df = spark.createDataFrame([(*([[(float(p), float(q)) for p, q in view] for view in x] for x in (a, b)),)], "x array<array<struct<re: double, im: double>>>, y array<array<struct<re: double, im: double>>>")
    cost = np.hypot(*np.moveaxis(a[:, None] - b[None], -1, 0)).sum(axis=-1)
    least = min(sum(cost[i, p] for i, p in enumerate(q)) for q in itertools.permutations(range(3)))
    got = df.select(views.light_field_distance(F.col("x"), F.col("y"), 3).alias("d"), views.light_field_distance(F.col("x"), F.col("x"), 3).alias("z")).first()
    assert got["d"] == pytest.approx(least) and got["z"] == 0


def test_skeleton(spark):
    line = lambda k, pts: [("m", k, i, *map(float, p)) for i, p in enumerate(pts)]
    rows = line(0, [(x, 0, 0) for x in range(6)]) + line(1, [(3, 0, 0), (3, 1, 0), (3, 2, 0)]) + line(2, [(3.001, 0, 0), (2, 0, 0)])
    e = skeleton.skeleton_edges(spark.createDataFrame(rows, "mesh_id string, line_id int, seq int, x double, y double, z double"))
    assert e.count() == 7
    path = skeleton.backbone(e)
    nodes = [r["node"] for r in path.orderBy("seq").collect()]
    assert len(nodes) == 6 and {nodes[0], nodes[-1]} == {"0.0 0.0 0.0", "5.0 0.0 0.0"}
    s = spark.createDataFrame([("m", i, "1.0 0.0 0.0", float(i)) for i in range(5)] + [("m", 9, "3.0 1.0 0.0", 0.0)], "mesh_id string, vertex_id int, node string, d double")
    assert {r["vertex_id"] for r in skeleton.segment_by_distance(s, path).collect()} == {4, 9}


def test_coefficients_keep_no_radii(spark, monkeypatch):
    """No direction's radius is written; a mesh's triangles over several batches and steps, and directions as rows, give the same."""
    v, f = cube(spark)
    v = v.unionByName(v.withColumn("mesh_id", F.concat("mesh_id", F.lit("!"))).withColumn("z", F.col("z") * 3))
    f = f.unionByName(f.withColumn("mesh_id", F.concat("mesh_id", F.lit("!")))).unionByName(spark.createDataFrame([("q", 0, 0, 1, 2)], f.schema))
    d = harmonics.sphere_sample(spark, 30)
    rows = lambda df: {r["mesh_id"]: r["coefficients"] for r in df.collect()}
    want = rows(harmonics.coefficients(v, f, d, held=0))
    monkeypatch.setattr(harmonics, "materialize", None)
    monkeypatch.setattr(harmonics, "STEP", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(harmonics.coefficients(v, f, d))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == 2 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_chords_of_small_meshes_are_no_rows(spark):
    """Chords worked off in a task, by joins, and both at once: the same; only a mesh's bins leave the task."""
    v, f = T.prisms(spark, SF)
    v, f = (t.filter("mesh_id <= 3").withColumn("mesh_id", F.col("mesh_id").cast("string")) for t in (v, f))
    cv, cf = cube(spark)
    v, f = v.unionByName(cv), f.unionByName(cf)
    rows = lambda df: {(r["mesh_id"], r["chord"]): r["length"] for r in df.collect()}
    want = rows(rays.mesh_chords(v, f, 40, most=0))
    for most in (256, 20):
        got = rows(rays.mesh_chords(v, f, 40, most=most))
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)
    one = rays.chord_distribution(v, f, chords=40, bins=10)
    assert "hashpartitioning(mesh_id, bin" not in one._jdf.queryExecution().toString() and "Window" not in one._jdf.queryExecution().toString()
    bins = lambda df: sorted((r["mesh_id"], r["bin"], r["n"], round(r["density"], 9)) for r in df.collect())
    assert bins(one) == bins(rays.chord_distribution(v, f, chords=40, bins=10, most=0))


def test_small_hulls_need_no_rounds(spark, monkeypatch):
    """Against all triples of points with the others on one side. Copies, a flat mesh, a null, one far away."""
    r = np.random.default_rng(6)
    rows = [(m, i, *map(float, p)) for m in range(4) for i, p in enumerate(r.normal(size=(12 + 4 * m, 3)) + 1e4 * m)]
    more = [(9, i, float(i % 3), float(i // 3), 0.0) for i in range(9)] + [(0, 90, *rows[3][2:]), (1, 91, None, 0.0, 0.0)]
    v = spark.createDataFrame([*rows, *more], "mesh_id long, vertex_id int, x double, y double, z double")
    want, size = set(), {9: 0.0}
    for m in range(4):
        p = np.array([q[2:] for q in rows if q[0] == m])
        for t in itertools.combinations(range(len(p)), 3):
            a, b, c = p[list(t)]
            away = np.delete((p - a) @ np.cross(b - a, c - a), t)
            if (away < 0).all() or (away > 0).all():
                want.add((m, *t))
                size[m] = size.get(m, 0.0) + abs((a - p.mean(axis=0)) @ np.cross(b - p.mean(axis=0), c - p.mean(axis=0))) / 6
    monkeypatch.setattr(hull, "_round", None)
    got = {x["mesh_id"]: x["hull_volume"] for x in hull.hull_volumes(v).collect()}
    assert got == pytest.approx(size, rel=1e-7)
    assert {(x["mesh_id"], *sorted(x[f"v{k}"] for k in range(3))) for x in hull.convex_hulls(v.filter("vertex_id < 90")).collect()} == want


def test_light_field_of_small_meshes_writes_no_rows(spark, monkeypatch):
    """A small mesh's rows of pixels don't leave its task: two cubes apart count as the larger, with moments as the old way gave."""
    v, f = cube(spark)
    small, far = (v.select("mesh_id", (F.col("vertex_id") + 8 * k).alias("vertex_id"), *((F.col(c) * size + at).alias(c) for c in "xyz")) for k, size, at in ((0, 1.0, 0.0), (1, 0.4, 5.0)))
    f2 = f.unionByName(f.select("mesh_id", (F.col("face_id") + 20).alias("face_id"), *((F.col(f"v{i}") + 8).alias(f"v{i}") for i in range(3))))
    monkeypatch.setattr(views, "silhouette_rows", None)
    rows = lambda *m: {r["view"]: np.array(r["moments"]) for r in views.light_field(*m, views=3, order=6, side=60).collect()}
    both, apart = rows(small.unionByName(far), f2), rows(small.unionByName(far), f)  # the same circle, one cube drawn
    assert both.keys() == {0, 1, 2} and all(both[k] == pytest.approx(apart[k], abs=1e-12) for k in both)


@pytest.mark.parametrize("seed", range(4))
def test_largest_part_of_a_mask(seed):
    mask = np.random.default_rng(seed).random((20, 30)) < 0.55
    seen, parts = set(), []
    for i, p in zip(*np.nonzero(mask), strict=True):
        part, todo = set(), [(int(i), int(p))]
        while todo:
            at = todo.pop()
            if at not in seen and 0 <= at[0] < 20 and 0 <= at[1] < 30 and mask[at]:
                seen.add(at)
                part.add(at)
                todo += [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        parts.append(part)
    runs = zip(*views._largest(mask), strict=True)
    assert {(int(i), p) for i, lo, hi in runs for p in range(lo, hi + 1)} == max(parts, key=len)
