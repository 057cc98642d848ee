"""Files that are written and read back, and clusterings and classifiers with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import vectors as V
from shapelake.operators import classify, cluster, datasets, features, pairs, skeleton
from shapelake.sources import tables as S
from shapelake.storage import scratch_dir
from shapelake.streaming import edits


def test_metrics_and_groupings(spark):
    df = spark.createDataFrame([("a/x.off", 1.5, [1.0, 2.0]), ("a/y.off", None, [])], "item_id string, v double, h array<double>")
    S.write_metrics(df, path := scratch_dir(spark))
    back = {r["item_id"]: r for r in S.read_metrics(spark, path, ["v"], ["h"]).collect()}
    assert back["a/x.off"]["v"] == 1.5 and back["a/x.off"]["h"] == [1.0, 2.0] and back["a/y.off"]["v"] is None
    S.write_flat_vectors(df, path := scratch_dir(spark), "h")
    assert {r["value"] for r in spark.read.text(path).collect()} == {"a/x.off,1.0,2.0", "a/y.off,"}
    g = spark.createDataFrame([("g", "a", "1"), ("g", "b", "2"), ("g", "c", None)], "grouping_id string, item_id string, label string")
    S.write_groupings(g, path := scratch_dir(spark))
    assert {(r["item_id"], r["label"]) for r in S.read_groupings(spark, path).collect()} == {("a", "1"), ("b", "2"), ("c", None)}
    assert S.read_clusters(spark, path).count() == 2
    a = g.select(F.col("item_id").alias("item"), "label")
    S.write_ratios(a, a, ["1", "2"], path := scratch_dir(spark))
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "1.0", "0.0"), ("2", "0.0", "1.0")]
    S.write_long(a, path := scratch_dir(spark), by="label")
    assert spark.read.option("header", True).csv(path).count() == 3


def test_segmentation_round_trip(spark):
    s = spark.createDataFrame([("m", "1.0 2.0 3.0"), ("m", "0.0 0.0 0.0"), ("n", "1.0 2.0 3.0")], "mesh_id string, point string")
    S.write_segmentation(s, path := scratch_dir(spark))
    assert sorted(map(tuple, S.read_segmentation(spark, path).collect())) == sorted(map(tuple, s.collect()))


def test_fourier_features(spark):
    x = np.random.default_rng(5).normal(size=(2, 4)).tolist()
    df = spark.createDataFrame([tuple(x)], "x array<double>, y array<double>")
    for kind, kernel in (("rbf", V.gaussian), ("laplacian", V.laplacian)):
        near = V.dot(*(classify.fourier_features(F.col(c), 4, 3000, kind=kind) for c in "xy"))
        got = df.select(near.alias("a"), kernel(F.col("x"), F.col("y")).alias("b")).first()
        assert got["a"] == pytest.approx(got["b"], abs=0.06)


def test_clusterings(spark):
    rows = [(i, [float(i % 2 * 20 + i * 0.1), 1.0, float(i % 3)]) for i in range(16)]
    items = spark.createDataFrame(rows, "item long, x array<double>")
    kernel = pairs.pair_table(items, "item", "x", lambda a, b: V.gaussian(a, b, 0.05)).withColumnRenamed("d", "k")
    halves = [cluster.spectral(kernel, 2), cluster.reduced_clusters(items, "item", "x", lambda d, k, v: cluster.kmeans(d, k, v, 2), dim=1)]
    for out in halves:
        found = {r["item"]: r["label"] for r in out.collect()}
        assert len({found[i] for i in range(0, 16, 2)}) == len({found[i] for i in range(1, 16, 2)}) == 1 and found[0] != found[1]
    grid = cluster.experiment({"all": items}, {"kmeans": lambda d, p: cluster.kmeans(d, "item", "x", int(p))}, {"kmeans": [2, 3]})
    assert grid.count() == 32 and grid.filter("param = 3").select("label").distinct().count() == 3
    labelled = items.withColumn("label", F.when(F.col("item") % 2 == 0, "even").otherwise("odd"))
    assert classify.transfer_accuracy(labelled, labelled, "item", "x", "label").first()[0] == 1


def test_points(spark):
    one = spark.createDataFrame([(1.0, -2.0, 0.5)], "x double, y double, z double")
    back = one.select(*V.to_cartesian(*V.to_polar(F.col("x"), F.col("y"), F.col("z")))).first()
    assert [round(c, 9) for c in back] == [1.0, -2.0, 0.5]
    z = spark.createDataFrame([([(3.0, 4.0)],)], "z array<struct<re: double, im: double>>")
    assert z.select(V.modulus(F.col("z"))).first()[0] == [5.0]
    assert one.select(V.composite([F.lit(3.0), F.lit(4.0)], root=True), V.composite([F.lit(3.0), F.lit(4.0)], [1.0, 0.5])).first() == (5.0, 5.0)
    assert one.select(V.combined_kernel(F.array("x"), F.array("z"), F.array("x"), F.array("z"))).first()[0] == pytest.approx(0.5 + math.exp(-0.5))


def test_latest_labels_of_a_stream(spark):
    rows = [("a", 1, "x", "2024-01-02"), ("a", 1, "y", "2024-01-01"), ("b", 1, "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "annotator string, item long, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(path := scratch_dir(spark))
    stream = edits.latest_labels(spark.readStream.schema(df.schema).parquet(path))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", scratch_dir(spark)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["annotator"], r["label"]) for r in spark.table("latest").collect()} == {("a", "x"), ("b", "z")}


def test_bundles_curves_and_polylines(spark):
    pc = spark.createDataFrame([("g", "a", 1.0, 2.0), ("g", "b", 3.0, 4.0), ("h", "c", 5.0, 6.0)], "label string, item string, pc1 double, pc2 double")
    S.write_reduced(pc, path := scratch_dir(spark), ["a", "b", "c"])
    back = {(r["label"], r["axis"]): (r["a"], r["b"], r["c"]) for r in spark.read.option("header", True).csv(path).collect()}
    assert back[("g", "pc2")] == ("2.0", "4.0", None) and back[("h", "pc1")] == (None, None, "5.0")
    curve = spark.createDataFrame([("Classic", 0.3, 0.5), ("Classic", 0.7, 0.75), ("Chord", 0.3, 0.25)], "label string, ratio double, accuracy double")
    S.write_accuracy_curves(curve, path := scratch_dir(spark), [0.3, 0.7])
    assert {r["label"]: (r["0.3"], r["0.7"]) for r in spark.read.option("header", True).csv(path).collect()} == {"Classic": ("0.5", "0.75"), "Chord": ("0.25", None)}
    path = scratch_dir(spark)
    for run in ("one", "two"):
        S.write_bundle(run, {"clusters": pc, "scores": curve}, path)
    assert spark.read.parquet(f"{path}/scores").groupBy("run_id").count().count() == 2 and spark.read.parquet(f"{path}/clusters").count() == 6
    S.write_long(curve, path := scratch_dir(spark), kind="json")
    assert spark.read.json(path).count() == 3
    path = scratch_dir(spark)
    spark.createDataFrame([('{"graph_id": "m", "line_id": 0, "points": [[0.005, 1, 2], [3.015, 4, 5]]}',)], "value string").write.text(path)
    assert [tuple(r) for r in S.read_polylines(spark, path).orderBy("seq").collect()] == [("m", 0, 0, 0.005, 1.0, 2.0), ("m", 0, 1, 3.015, 4.0, 5.0)]
    c = S.read_correspondence(spark, path).first()
    assert tuple(c["node"]) == (np.around(0.005, 2), 1.0, 2.0) and tuple(c["point"]) == (np.around(3.015, 2), 4.0, 5.0)


def test_grouping_files_by_pattern(spark, tmp_path):
    for name, label in (("manual_1", "x"), ("manual_2", "y"), ("other", "z")):
        (tmp_path / f"{name}.json").write_text(f'{{"groups": {{"{label}": ["a"]}}, "samples": ["a", "b"]}}')
    g = S.read_groupings(spark, str(tmp_path), "manual_?.json").collect()
    assert sorted((r["grouping_id"], r["item_id"], r["label"] or "") for r in g) == [("manual_1", "a", "x"), ("manual_1", "b", ""), ("manual_2", "a", "y"), ("manual_2", "b", "")]


def test_point_keys_round_as_binary_numbers(spark):
    x = [0.005, 0.015, 0.025, 1.005, 2.675, 9.015, 8.995, -0.005, 1 / 3, 90.705]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(V.point_key(F.col("x"), F.col("x"), F.col("x")).alias("k")).collect()
    assert [r["k"]["x"] for r in got] == [float(v) + 0.0 for v in np.around(x, 2)]


def test_flat_vectors_and_grids(spark):
    df = spark.createDataFrame([(1.5, 2, [3.0, 4.0])], "a double, b int, h array<double>")
    flat, grid = df.select(features.flat_vector(["a", "b"], ["h"]).alias("v"), features.parameter_grid(0.5, 1.5, 0.5).alias("g")).first()
    assert flat == [1.5, 2.0, 3.0, 4.0] and grid == pytest.approx([0.5, 1.0, 1.5])


def test_datasets(spark):
    items = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("c", [5.0, 5.0])], "item string, x array<double>")
    assert datasets.cluster_counts(10, items) == [2, 3] and datasets.metric_names(items, "item") == ["x"]
    by_first = lambda df, v: df.select("item", F.when(F.col("x")[0] < v, "1").otherwise("2").alias("label"))
    assert [tuple(r) for r in datasets.sweep(items, [1, 9], by_first, "within").collect()] == [(1.0, 0.5), (9.0, pytest.approx(25.333333))]
    assert [tuple(r) for r in datasets.sweep(items, [1, 9], by_first, "groups").collect()] == [(1.0, 2.0), (9.0, 1.0)]
    g = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1")], "item string, label string")
    assert [tuple(r) for r in datasets.clusters(g).collect()] == [("1", 2, ["a", "c"])]
    assert datasets.outliers(g).first()[0] == "b" and datasets.cluster(g, "1").count() == 2
    z = spark.createDataFrame([("[[1.5+2.e-1j 0.-1.j]\n [ 3+0j -4.+.5j]]",)], "t string").select(datasets.parse_complex_rows(F.col("t")).alias("z")).first()["z"]
    assert [[(p["re"], p["im"]) for p in row] for row in z] == [[(1.5, 0.2), (0.0, -1.0)], [(3.0, 0.0), (-4.0, 0.5)]]
    name = spark.createDataFrame([("data\\\\old\\\\x.off",), ("other/y",)], "n string").select(datasets.clean_name(F.replace("n", F.lit("\\\\"), F.lit("\\")), {"old": "new"}, "data/").alias("n"))
    assert [r["n"] for r in name.collect()] == ["new/x.off", "other/y"]
    wide = items.select("item", *(F.lit(1.0).alias(c) for c in datasets.FEATURE_SETS["Classic"][0]), "x")
    assert len(datasets.feature_set(wide, "Classic", "item").columns) == 12 and datasets.feature_set(wide, "Combined").columns == wide.columns


def test_js_is_the_fourth_root(spark):
    x, y = np.array([1.0, 3.0, 0.0]), np.array([2.0, 2.0, 4.0])
    p, q = x / x.sum(), y / y.sum()
    m = (p + q) / 2
    kl = lambda a: sum(v * math.log(v / w) for v, w in zip(a, m, strict=True) if v > 0)
    got = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>").select(V.jensen_shannon(F.col("x"), F.col("y"))).first()[0]
    assert got == pytest.approx(((kl(p) + kl(q)) / 2) ** 0.25)


def test_interior_centre_falls_on_the_nearest_line(spark):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 4.0, 2.0, 2.0), ("n", 0, 0.0, 0.0, 0.0), ("n", 1, 2.0, 2.0, 2.0)], "mesh_id string, vertex_id int, x double, y double, z double")
    s = spark.createDataFrame([("m", 0.0, 0.0, 1.0, 1.0, 0.0, 1.0), ("m", 0.0, 9.0, 9.0, 1.0, 9.0, 9.0), ("m", 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)], "mesh_id string, x double, y double, z double, x1 double, y1 double, z1 double")
    assert {r["mesh_id"]: (r["x"], r["y"], r["z"]) for r in skeleton.interior_centres(v, s).collect()} == {"m": (2.0, 0.0, 1.0), "n": (1.0, 1.0, 1.0)}
