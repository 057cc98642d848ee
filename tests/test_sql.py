"""Every SQL function gives what the Column function of the same name does."""

import pytest
from pyspark.sql import functions as F

from shapelake.functions import vectors as V
from shapelake.sources import sql

from .test_queries import SF


def test_functions(spark):
    sql.register(spark, SF)
    rows = spark.createDataFrame([([0.2, 0.0, 0.3, 0.5], [0.1, 0.4, 0.0, 0.5]), ([1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0]), ([0.0, 0.0, 1.0, 3.0], [2.0, 0.0, 1.0, 0.5])], "x array<double>, y array<double>")
    for name, f in (V.DISTANCES | {"dot": V.dot}).items():
        both = rows.select(F.expr(f"shape_{name}(x, y)").alias("got"), f(F.col("x"), F.col("y")).alias("want")).collect()
        assert [r["got"] for r in both] == pytest.approx([r["want"] for r in both]), name
    got = rows.select(F.expr("shape_combined(x, y, y, x)").alias("got"), V.combined_kernel(*map(F.col, "xyyx")).alias("want")).collect()
    assert [r["got"] for r in got] == pytest.approx([r["want"] for r in got])


def test_views(spark):
    sql.register(spark, SF, "other_")
    assert spark.sql("select count(*) from other_voxels join other_votes on false").first()[0] == 0
    assert spark.sql("select max(other_rbf(x, x)) from other_features").first()[0] == 1
