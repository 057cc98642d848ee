"""Metric tables as CSV and groupings as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import point_key
from ..operators.features import parse_vector
from ..operators.groups import intersection_ratios

KEY = "Spine File"


def write_metrics(df: DataFrame, path: str, key: str = "item_id") -> None:
    """Header, key column first; arrays as bracketed text."""
    text = [F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit("]")).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c != key]
    df.select(F.col(key).alias(KEY), *text).write.option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, scalars: list[str], vectors: list[str]) -> DataFrame:
    """Columns by name; cells that don't parse are null, paths get forward slashes."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    key = F.replace(F.col(f"`{KEY}`"), F.lit("\\"), F.lit("/")).alias("item_id")
    return raw.select(key, *(F.col(c).try_cast("double").alias(c) for c in scalars), *(parse_vector(F.col(c)).alias(c) for c in vectors))


def write_groupings(assignments: DataFrame, path: str) -> None:
    """{"groups": {label: [item]}, "samples": [item]} in one folder a grouping_id."""
    groups = assignments.filter("label is not null").groupBy("grouping_id", "label").agg(F.array_sort(F.collect_set("item_id")).alias("m"))
    groups = groups.groupBy("grouping_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("groups"))
    samples = assignments.groupBy("grouping_id").agg(F.array_sort(F.collect_set("item_id")).alias("samples"))
    samples.join(groups, "grouping_id", "left").write.partitionBy("grouping_id").json(path)


def read_groupings(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(grouping_id, item_id, label) of all files below ``path`` whose name fits ``pattern``: grouping_id is the file's
    name; samples in no group have a null label."""
    raw = spark.read.schema("groups map<string,array<string>>, samples array<string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    raw = raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("grouping_id"), "groups", "samples")
    norm = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    own = raw.select("grouping_id", F.explode("groups").alias("label", "m")).select("grouping_id", "label", F.explode("m").alias("item_id"))
    own = own.select("grouping_id", norm(F.col("item_id")).alias("item_id"), "label")
    rest = raw.select("grouping_id", F.explode("samples").alias("item_id")).select("grouping_id", norm(F.col("item_id")).alias("item_id")).distinct()
    return own.union(rest.join(own, ["grouping_id", "item_id"], "left_anti").withColumn("label", F.lit(None).cast("string")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(grouping_id, item_id, label) of files that hold only groups; every member is a sample."""
    return read_groupings(spark, path).filter("label is not null")


def write_flat_vectors(df: DataFrame, path: str, vector: str, key: str = "item_id") -> None:
    """Rows ``key, v0, v1, ...`` as CSV without a header; vectors may differ in length."""
    df.select(F.concat_ws(",", F.col(key), F.array_join(F.transform(vector, lambda x: x.cast("string")), ",", "")).alias("value")).write.text(path)


def write_ratios(a: DataFrame, b: DataFrame, labels: list[str], path: str, normalize: bool = False) -> None:
    """Contingency table of two groupings (item, label) as CSV: a row a group of a, a column a label of b."""
    r = intersection_ratios(a, b, normalize).filter("a_label is not null")
    wide = r.groupBy(F.col("a_label").alias("denominator_group")).pivot("b_label", labels).agg(F.first("ratio"))
    numeric = F.col("denominator_group").try_cast("double")
    wide.orderBy(numeric.asc_nulls_last(), "denominator_group").coalesce(1).write.option("header", True).csv(path)  # labels x labels


def write_long(df: DataFrame, path: str, by: str | None = None, kind: str = "csv") -> None:
    """Result tables (score graphs, per-group distributions) as CSV with a header or as JSON, in a folder a value of ``by``."""
    out = df.write.option("header", True)
    (out.partitionBy(by) if by else out).format(kind).save(path)


def write_reduced(coordinates: DataFrame, path: str, items: list[str], key: str = "item") -> None:
    """Reduced coordinates (label, item, pc1, pc2, ...) as CSV in a folder a label: a row an axis, a column an item."""
    axes = [c for c in coordinates.columns if c not in (key, "label")]
    long = coordinates.select("label", key, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in axes))).alias("p"))
    wide = long.groupBy("label", F.col("p.axis").alias("axis")).pivot(key, items).agg(F.first("p.v"))
    wide.write.option("header", True).partitionBy("label").csv(path)


def write_accuracy_curves(curves: DataFrame, path: str, ratios: list[float]) -> None:
    """Training curves (label, ratio, accuracy) as CSV: a row a label, a column a ratio."""
    wide = curves.groupBy("label").pivot("ratio", ratios).agg(F.first("accuracy"))
    wide.coalesce(1).write.option("header", True).csv(path)  # a row a feature set


def write_bundle(run_id: str, tables: dict[str, DataFrame], path: str) -> None:
    """The tables of one run (clusters, classes, scores, contingency tables, ...) as Parquet, each below its name and run_id."""
    for name, table in tables.items():
        table.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def read_polylines(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, line_id, seq, x, y, z) from JSON lines {"graph_id", "line_id", "points": [[x, y, z], ...]}."""
    raw = spark.read.schema("graph_id string, line_id int, points array<array<double>>").json(path)
    return raw.select("graph_id", "line_id", F.posexplode("points").alias("seq", "p")).select("graph_id", "line_id", "seq", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def read_correspondence(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, point, node): surface points and their skeleton points, as keys of rounded points, from lines of two points."""
    rows = read_polylines(spark, path).filter("seq < 2")
    end = lambda i: F.max(F.when(F.col("seq") == i, point_key(F.col("x"), F.col("y"), F.col("z"))))
    return rows.groupBy(F.col("graph_id").alias("mesh_id"), "line_id").agg(end(1).alias("point"), end(0).alias("node")).drop("line_id")


def write_segmentation(segment: DataFrame, path: str) -> None:
    """{point: true} with one JSON line a mesh (mesh_id=...), from (mesh_id, point: text)."""
    marks = F.map_from_entries(F.collect_list(F.struct("point", F.lit(True).alias("in"))))
    segment.select("mesh_id", "point").distinct().groupBy("mesh_id").agg(F.to_json(marks).alias("value")).write.partitionBy("mesh_id").text(path)


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, point): the points that are marked true."""
    raw = spark.read.text(path).select("mesh_id", F.explode(F.from_json("value", "map<string,boolean>")).alias("point", "in"))
    return raw.filter("in").select("mesh_id", "point")
