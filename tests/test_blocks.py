"""Distances by blocks and what is folded in them, against the Column functions over all pairs."""

import pytest
from pyspark.sql import functions as F

from shapelake.functions import vectors as V
from shapelake.operators import blocks, pairs

ROWS = [(i, "xyz"[i % 3] if i % 7 else None, [float((i * k) % 5) for k in (1, 2, 3, 4)]) for i in range(1, 26)]
ROWS += [(30, "y", ROWS[3][2]), (31, "alone", [9.0, 1.0, 0.0, 2.0])]  # the same vector twice, and a group of one


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*ROWS, (99, "x", None)], "item long, label string, x array<double>").cache()


@pytest.mark.parametrize("name", sorted(blocks.METRICS))
def test_pairs(spark, items, name):
    some = items.filter("x is not null and aggregate(x, 0d, (a, b) -> a + b) > 0")
    want = {(r["a"], r["b"]): r["d"] for r in pairs.pair_table(some, "item", "x", V.DISTANCES[name], blocks=3).collect()}
    got = {(r["a"], r["b"]): r["d"] for r in blocks.block_pairs(some, "item", "x", name, blocks=3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_within(items):
    every = blocks.block_pairs(items, "item", "x").filter("d <= 2").collect()
    assert sorted(every) == sorted(blocks.block_pairs(items, "item", "x", within=2.0, blocks=2).collect()) and every


@pytest.mark.parametrize("n", [1, 4])
def test_folds(spark, items, n):
    whole = items.filter("x is not null")
    p = pairs.pair_table(whole, "item", "x", V.euclidean, blocks=2)
    near = lambda df: sorted((r["item"], r["nearest"], round(r["d_near"], 9), r["farthest"], round(r["d_far"], 9)) for r in df.collect())
    assert near(blocks.nearest_and_farthest(items, "item", "x", blocks=n)) == near(pairs.nearest_and_farthest(p))
    kth = lambda df: sorted((r["item"], round(r["kth"], 9)) for r in df.collect())
    assert kth(blocks.kth_neighbours(items, "item", "x", 4, blocks=n)) == kth(pairs.knn_elbow(p, 4))
    score = lambda df: sorted((r["item"], r["label"], round(r["s"], 9)) for r in df.collect())
    assert score(blocks.silhouette(items, "item", "x", "label", blocks=n)) == score(pairs.silhouette(p, whole.select("item", "label")))


def test_few(spark, items):
    none, one = items.limit(0), items.filter("item = 1")
    for few in (none, one):
        assert blocks.block_pairs(few, "item", "x").count() == 0
        assert blocks.nearest_and_farthest(few, "item", "x").count() == 0
        assert blocks.kth_neighbours(few, "item", "x", 3).count() == 0
        assert blocks.silhouette(few, "item", "x", "label").count() == 0
    assert blocks.silhouette(items.select("item", F.lit("a").alias("label"), "x"), "item", "x", "label").filter("s <> 0").count() == 0


def test_zeros_have_one_sign(spark, tmp_path):
    """Histograms that differ by a last digit: whether their kl rounds to 0 or to -0 was left to the order of a sum."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from shapelake import catalog

    base = np.random.default_rng(3).normal(size=(4, 64)).astype("float32")
    x = np.repeat(base, 40, axis=0)
    for i in range(len(x)):
        x[i, i % 40] = np.nextafter(x[i, i % 40], np.float32(9))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(len(x), "int32")}), tmp_path / "embeddings.parquet")
    got = {(r["a"], r["b"]): str(r["d"]) for r in catalog.queries()["dist_kl"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert got == {(a, b): str(d) for a, b, d in c.sql(catalog.oracle_sql()["dist_kl"]).fetchall()}
    assert "0.0" in got.values() and "-0.0" not in got.values()


def test_near_vectors_by_table(spark):
    """Distances of which a part is worked out once a vector, where rounding would show: equal and nearly equal histograms."""
    rows = [(0, [0.5, 0.25, 0.25, 0.0]), (1, [0.5, 0.25, 0.25, 0.0]), (2, [0.5, 0.25 + 1e-9, 0.25 - 1e-9, 0.0]), (3, [0.0, 0.25, 0.25, 0.5])]
    some = spark.createDataFrame(rows, "item long, x array<double>")
    for name in blocks.TABLES:
        want = {(r["a"], r["b"]): r["d"] for r in pairs.pair_table(some, "item", "x", V.DISTANCES[name]).collect()}
        got = {(r["a"], r["b"]): r["d"] for r in blocks.block_pairs(some, "item", "x", name, blocks=2).collect()}
        assert got == pytest.approx(want, abs=1e-9), name


def test_kernel_kmeans_keeps_no_pairs(spark, items):
    from shapelake.operators import cluster

    f = items.filter("x is not null").select("item", F.coalesce("label", F.lit("z")).alias("label"), "x")
    half = pairs.pair_table(f, "item", "x", V.gaussian).withColumnRenamed("d", "k")
    kernel = half.union(half.select("b", "a", "k")).union(f.select("item", "item", F.lit(1.0)))
    want = {tuple(r) for r in cluster.kernel_kmeans(kernel, f.select("item", "label"), rounds=3).collect()}
    assert {tuple(r) for r in blocks.kernel_kmeans(f, "item", "x", "label", rounds=3).collect()} == want


def test_copies_of_an_item_are_bounded():
    """What is sent to cells grows as the items do from 32,768 items to 1,048,576; it grew as their square."""
    assert {blocks._blocks(n) for n in (40_000, 102_560, 615_000, 1 << 20)} == {blocks.BLOCKS}
    assert blocks._blocks(10) == 8 and blocks._blocks(1 << 22) == 128


def test_far_from_the_origin(spark):
    """Products alone would lose these distances, and equal vectors must tie exactly, in blocks of different sizes."""
    rows = [(i, "ab"[i % 2], [1e6 + (i * k % 11) * 1e-3 for k in (1, 2, 3, 4, 5)]) for i in range(1, 40)]
    rows += [(100 + i, "a", rows[i][2]) for i in range(0, 39, 3)]
    far = spark.createDataFrame(rows, "item long, label string, x array<double>")
    p = pairs.pair_table(far, "item", "x", V.euclidean, blocks=2)
    want = {r["item"]: tuple(r) for r in pairs.nearest_and_farthest(p).collect()}
    got = {r["item"]: tuple(r) for r in blocks.nearest_and_farthest(far, "item", "x", blocks=3).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][i] == pytest.approx(want[k][i], abs=1e-12) for k in want for i in (2, 4))
    want = {r["item"]: r["kth"] for r in pairs.knn_elbow(p, 4).collect()}
    assert {r["item"]: r["kth"] for r in blocks.kth_neighbours(far, "item", "x", 4, blocks=3).collect()} == pytest.approx(want, abs=1e-12)


def test_strips_fold_in_the_cell(spark, items, monkeypatch):
    """A strip of two rows at a time: what is kept of the other block is folded over all of them."""
    monkeypatch.setattr(blocks, "ROWS", 2)
    import numpy as np
    import pyarrow as pa

    table = pa.table({"k": [r[0] for r in ROWS], "x": [np.array(r[2]).tobytes() for r in ROWS]})
    side = blocks.Side(table)
    assert np.concatenate([d for _, d in blocks._strips(side, side, "l2")]) == pytest.approx(np.sqrt(((side.x[:, None] - side.x) ** 2).sum(axis=2)))


def test_rounded_as_spark(spark):
    import numpy as np

    x = [0.00005, 0.00015, 0.12345, 1.00005, 2.5e-5, -0.00004, 0.0, 1e13 + 0.12, float("inf"), float("nan"), 3.00025, 123456.78905, 1e30]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 4) + 0.0).collect()]
    assert [str(v) for v in blocks.rounded(np.array(x), 4).tolist()] == [str(v) for v in want]


def test_sql_distances_by_cells(spark, tmp_path):
    """Distances within classes of different sizes, one of them a single item, one null."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from shapelake import catalog

    x = np.random.default_rng(5).normal(size=(90, 64)).astype("float32")
    x[7] = x[8]
    label = pa.array([None if i % 11 == 0 else 9 if i == 89 else i % 3 for i in range(90)], pa.int32())
    pq.write_table(pa.table({"vec_id": np.arange(90), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": label}), tmp_path / "embeddings.parquet")
    for name in ("events", "lineitem", "part"):  # views that the statement leaves alone
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    found = catalog.queries()["sql_distances"](spark, str(tmp_path))
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "shape_l2" not in found._jdf.queryExecution().toString()
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert sorted(tuple(r) for r in found.collect()) == sorted(c.sql(catalog.oracle_sql()["sql_distances"]).fetchall())


@pytest.mark.parametrize("n", [1, 3])
def test_cluster_distances(spark, monkeypatch, n):
    """Clusters of one to six items over strips of a few rows: the greatest distance of their items, the nearest of a cluster."""
    import numpy as np

    monkeypatch.setattr(blocks, "ROWS", 8)
    monkeypatch.setattr(blocks, "VALUES", 64)
    r = np.random.default_rng(8)
    x, c = r.normal(size=(60, 3)), np.sort(r.integers(0, 25, 60)) * 5
    items = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(60)], "item long, c long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    names = np.unique(c).tolist()
    want = {(a, b): d[np.ix_(c == a, c == b)].max() for a in names for b in names if a < b}
    got = blocks.cluster_distances(items, "item", "x", "c", nearest=False, blocks=n).collect()
    assert len(got) == len(want) and {(g["a"], g["b"]): g["d"] for g in got} == pytest.approx(want)
    least = {a: min((want[min(a, b), max(a, b)], b) for b in names if b != a) for a in names}
    found = {}
    for g in blocks.cluster_distances(items, "item", "x", "c", blocks=n).collect():
        found[g["a"]] = min(found.get(g["a"], (9e9, 0)), (g["d"], g["b"]))
    assert {a: b for a, (_, b) in found.items()} == {a: b for a, (_, b) in least.items()}


def test_linkage_keeps_no_pairs_of_items(spark, monkeypatch):
    import numpy as np

    from shapelake.operators import cluster

    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(40)]
    items = spark.createDataFrame([*rows, (41, rows[3][1]), (42, None)], "item long, x array<double>")
    want = {tuple(r) for r in cluster.complete_linkage(blocks.block_pairs(items, "item", "x"), 4).collect()}
    monkeypatch.setattr(blocks, "block_pairs", None)
    assert {tuple(r) for r in cluster.linkage(items, "item", "x", 4, few=12).collect()} == want and len(want) == 41


def test_dbscan_keeps_no_pairs(spark, monkeypatch):
    """Cells pass on forests: fewer rows than pairs, the labels of all pairs; an item at just the limit, one without a vector."""
    from shapelake.operators import cluster

    rows = [(i, [float(i * 7 % 20), float(i % 3)]) for i in range(70)] + [(80, [40.0, 0.0]), (81, [42.0, 0.0]), (82, [44.0, 0.0]), (83, None)]
    items = spark.createDataFrame(rows, "item long, x array<double>")
    eps = [1.0, 2.0]
    want = {tuple(r) for r in cluster.dbscan(items, pairs.pair_table(items.filter("x is not null"), "item", "x", V.euclidean, blocks=2), spark.createDataFrame([(e,) for e in eps], "eps double"), least=3).collect()}
    links = blocks.near_links(items.withColumn("c", F.lit(3)), "item", "x", "c", eps, blocks=1)
    assert links.filter("inner and e = 1").count() < 73 < blocks.block_pairs(items, "item", "x", within=2.0).count()
    monkeypatch.setattr(blocks, "block_pairs", None)
    assert {tuple(r) for r in cluster.dbscan_of_vectors(items, "x", eps, least=3).collect()} == want and (2.0, 80, 81) in {(w[0], w[1], w[2]) for w in want}
