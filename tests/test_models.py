"""Kernel features against the kernels, the grid's models against plain numpy, spectral vectors against an eigensolver."""

import re

import numpy as np
import pytest

from shapelake.operators import cluster, models


def table(spark, x, labels):
    return spark.createDataFrame([(i, [float(e) for e in v], l) for i, (v, l) in enumerate(zip(x, labels, strict=True))], "item long, x array<double>, label string")


@pytest.mark.parametrize("kind", ["rbf", "laplacian", "histogram"])
def test_landmark_features(spark, kind):
    x = np.random.default_rng(1).dirichlet(np.ones(12), 60)
    t = table(spark, x, ["a"] * 60)
    exact = models.kernel_values(kind, x, x, 1 / 12)
    pair = [sum(min(p, q) for p, q in zip(x[0], x[1], strict=True)), np.exp(-((x[0] - x[1]) ** 2).sum() / 12), np.exp(-np.abs(x[0] - x[1]).sum() / 12)]
    assert exact[0, 1] == pytest.approx(pair[["histogram", "rbf", "laplacian"].index(kind)])
    for n in (60, 40):
        z = np.stack(models.nystrom_features(t, "item", "x", kind, landmarks=n).toPandas().sort_values("item")["x"].to_numpy())
        rest = exact - z @ z.T  # zero at the landmarks, and what the landmarks leave of the kernel elsewhere: a kernel too
        assert (np.abs(rest).max(axis=1) < 1e-6).sum() == n and np.linalg.eigvalsh(rest)[0] > -1e-6
        print(kind, n, "largest error", np.abs(rest).max())


def test_grid_search(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [4, 0], [0, 4]])
    y = np.arange(90) % 3
    x = centres[y] + rng.normal(size=(90, 2)) * 0.7
    t = table(spark, x, [f"c{k}" for k in y]).union(spark.createDataFrame([(900, None, "c0"), (901, [0.0, 0.0], None)], "item long, x array<double>, label string"))
    out, predict = models.grid_search(t, "item", "x", "label", [0.2, 0.6], rounds=50)
    rows = {r["ratio"]: r for r in out.collect()}
    assert set(rows) == {0.2, 0.6} and all(r["accuracy"] > 0.85 and r["cost"] in (1.0, 10.0) for r in rows.values())
    got = predict(t, 0.6).toPandas().set_index("item")["label"]
    assert len(got) == 91 and np.mean([got[i] == f"c{k}" for i, k in enumerate(y)]) > 0.9
    assert models.grid_search(t.limit(0), "item", "x", "label", [0.5])[0].count() == 0


def test_spectral_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(12, 2)), rng.normal(size=(12, 2)) + 2.5])
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2)
    pairs = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(24) for j in range(i, 24)], "a long, b long, k double")
    v = cluster.spectral_coordinates(pairs, 2).toPandas().sort_values("item")[["v1", "v2"]].to_numpy()
    d = np.sqrt(k.sum(axis=1))
    want = np.linalg.eigh(k / d[:, None] / d[None])[1][:, ::-1][:, :2]
    assert np.allclose(np.abs((v * want).sum(axis=0)), 1, atol=1e-3)
    labels = {r["item"]: r["label"] for r in cluster.spectral(pairs, 2).collect()}
    assert sum(labels[i] == labels[0] for i in range(12)) >= 11 and sum(labels[i] != labels[0] for i in range(12, 24)) >= 11


def test_a_label_is_ranked_in_parts(spark):
    """Places are those of one sort by hash and key, but no task has all rows of a label."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("label"))
    want = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("key", F.lit(3)), "key"))
    got = models._ranked(rows, 3)
    assert re.search(r"hashpartitioning\(label#\d+, __part#\d+L?, ", got._jdf.queryExecution().executedPlan().toString())
    assert got.withColumn("want", want).filter("rank <> want").count() == 0 and got.count() == 6000
