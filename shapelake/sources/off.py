"""OFF meshes: text files to vertex and face tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_off(spark: SparkSession, folder: str, pattern: str = "*.off") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces); mesh_id is the file's path. A file is one mesh and one row while it is parsed."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    numbers = F.filter(F.split(F.regexp_replace("value", r"(?m)#.*$", ""), r"\s+"), lambda x: ~x.isin("", "OFF"))
    t = files.select(F.replace(F.col("_metadata.file_path"), F.lit("\\"), F.lit("/")).alias("mesh_id"), numbers.alias("n"))
    t = t.withColumns({"nv": F.get("n", F.lit(0)).cast("int"), "nf": F.get("n", F.lit(1)).cast("int")})
    v = t.select("mesh_id", "n", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("vertex_id")).filter("vertex_id >= 0")
    at = lambda i, k, start: F.get(F.col("n"), start + i + k)
    vertices = v.select("mesh_id", "vertex_id", *(at(F.col("vertex_id") * 3, k, F.lit(3)).cast("double").alias(c) for k, c in enumerate("xyz")))
    f = t.filter("nf > 0").select("mesh_id", "n", (F.col("nv") * 3 + 3).alias("s"), F.explode(F.sequence(F.lit(0), F.col("nf") - 1)).alias("face_id"))
    faces = f.select("mesh_id", "face_id", *(at(F.col("face_id") * 4, k + 1, F.col("s")).cast("int").alias(f"v{k}") for k in range(3)))
    return vertices, faces


def with_parents(meshes: DataFrame, parent: str = "surface_mesh.off") -> DataFrame:
    """mesh_id with the path of the parent mesh in the same folder."""
    return meshes.withColumn("parent_id", F.regexp_replace("mesh_id", r"/[^/]+$", f"/{parent}"))


def write_off(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One folder a mesh (mesh_id=...), each with its OFF text."""
    rows = vertices.select("mesh_id", F.struct(F.lit(1).alias("part"), F.col("vertex_id").alias("i"), F.concat_ws(" ", "x", "y", "z").alias("line")).alias("r"))
    rows = rows.union(faces.select("mesh_id", F.struct(F.lit(2).alias("part"), F.col("face_id").alias("i"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("line"))))
    text = rows.groupBy("mesh_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    count = lambda p: F.size(F.filter("r", lambda e: e["part"] == p)).cast("string")
    head = F.concat(F.lit("OFF\n"), count(1), F.lit(" "), count(2), F.lit(" 0\n"))
    text.select("mesh_id", F.concat(head, F.array_join(F.transform("r", lambda e: e["line"]), "\n")).alias("value")).write.partitionBy("mesh_id").text(path)
