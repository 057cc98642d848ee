"""The engine's tables, derived from the driver's: features, prisms, votes, voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, label, x): embeddings as doubles with their class."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, label, x): each embedding shifted to a least value of 0 and scaled to one."""
    f = once(features(spark, sf_dir), {"least": F.array_min("x")})
    f = once(f, {"up": F.transform("x", lambda e: e - F.col("least"))})
    f = once(f, {"total": F.aggregate("up", F.lit(0.0), lambda a, b: a + b)})
    return f.select("item", "label", F.transform("up", lambda e: e / F.col("total")).alias("x"))


#: A prism on a 12-gon: bottom fan round vertex 24, two triangles a side, top in a zigzag.
RING = 12
ZIGZAG = (0, 1, 11, 2, 10, 3, 9, 4, 8, 5, 7, 6)


def prism_faces() -> list[tuple[int, int, int]]:
    n = [(i, (i + 1) % RING) for i in range(RING)]
    top = [(ZIGZAG[i], ZIGZAG[i + 1], ZIGZAG[i + 2])[:: 1 if i % 2 == 0 else -1] for i in range(RING - 2)]
    return [(24, j, i) for i, j in n] + [(i, j, i + 12) for i, j in n] + [(j, j + 12, i + 12) for i, j in n] + [tuple(v + 12 for v in t) for t in top]


def prisms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): one prism a part, radius p_size and height p_retailprice / 100."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_size").cast("double").alias("r"), (F.col("p_retailprice").cast("double") / 100).alias("h"))
    v = part.select("mesh_id", "r", "h", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("vertex_id"))
    turn = F.col("vertex_id") % RING * (2 * 3.141592653589793 / RING)
    x = F.when(F.col("vertex_id") == 24, 0.0).otherwise(F.col("r") * F.cos(turn))
    y = F.when(F.col("vertex_id") == 24, 0.0).otherwise(F.col("r") * F.sin(turn))
    z = F.when((F.col("vertex_id") >= RING) & (F.col("vertex_id") < 24), F.col("h")).otherwise(0.0)
    shape = F.array(*(F.struct(F.lit(a).alias("v0"), F.lit(b).alias("v1"), F.lit(c).alias("v2")) for a, b, c in prism_faces()))
    faces = part.select("mesh_id", F.posexplode(shape).alias("face_id", "f")).select("mesh_id", "face_id", "f.v0", "f.v1", "f.v2")
    return v.select("mesh_id", "vertex_id", x.alias("x"), y.alias("y"), z.alias("z")), faces


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(annotator, item, label): per user and day of the week the latest event type."""
    e = table(spark, sf_dir, "events").select(F.dayofweek("ts").cast("string").alias("annotator"), F.col("user_id").alias("item"), "event_type", "ts", "event_id")
    return e.groupBy("annotator", "item").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, i, j, k, value): an image for every 15,000 order keys, their lines in 24 x 24 x 8 cells, value 5 times
    the mean quantity, 0 to 255. The number of images grows with lineitem."""
    cell = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_orderkey", 24, "i"), ("l_partkey", 24, "j"), ("l_suppkey", 8, "k"))]
    image = F.floor(F.col("l_orderkey") / 15_000).cast("int").alias("image_id")
    rows = table(spark, sf_dir, "lineitem").select(image, *cell, F.col("l_quantity").cast("double").alias("q")).groupBy("image_id", "i", "j", "k").agg(F.avg("q").alias("q"))
    return rows.select("image_id", "i", "j", "k", F.least(F.lit(255), F.floor(F.col("q") * 5)).cast("int").alias("value"))


# --- the same tables in DuckDB's SQL ---------------------------------------------------------------------------------

FEATURES = "feat as (select vec_id as item, label::varchar as label, list_transform(embedding, lambda e: e::double) as x from embeddings)"
HISTOGRAMS = FEATURES + """,
hist0 as (select item, label, list_transform(x, lambda e: e - list_min(x)) as x from feat),
hist as (select item, label, list_transform(x, lambda e: e / list_sum(x)) as x from hist0)"""
PRISMS = """part0 as (select p_partkey as mesh_id, p_size::double as r, p_retailprice::double / 100 as h from part),
vert as (select mesh_id, v as vertex_id, case when v = 24 then 0 else r * cos(v % 12 * (2 * 3.141592653589793 / 12)) end as x,
  case when v = 24 then 0 else r * sin(v % 12 * (2 * 3.141592653589793 / 12)) end as y, case when v >= 12 and v < 24 then h else 0 end as z
  from part0, range(25) t(v)),
shape(face_id, v0, v1, v2) as (values """ + ", ".join(str((i, *f)) for i, f in enumerate(prism_faces())) + """),
face as (select mesh_id, face_id, v0, v1, v2 from part0, shape),
geo as (select f.mesh_id, face_id, v0, v1, v2,
    (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny,
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz, (a.x + b.x + c.x) / 3 as cx, (a.y + b.y + c.y) / 3 as cy, (a.z + b.z + c.z) / 3 as cz,
    a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x) as volume6
  from face f join vert a on a.mesh_id = f.mesh_id and a.vertex_id = f.v0 join vert b on b.mesh_id = f.mesh_id and b.vertex_id = f.v1
  join vert c on c.mesh_id = f.mesh_id and c.vertex_id = f.v2),
geom as (select *, sqrt(nx * nx + ny * ny + nz * nz) / 2 as area from geo),
hub as (select mesh_id, a as vertex_id from (select distinct mesh_id, a, b from (
    select mesh_id, unnest([v0, v0, v1, v1, v2, v2]) as a, unnest([v1, v2, v0, v2, v0, v1]) as b from face)) group by all having count(distinct b) > 10),
geoj as (select g.*, exists (select 1 from hub where hub.mesh_id = g.mesh_id and hub.vertex_id in (g.v0, g.v1, g.v2)) as junction from geom g),
jc as (select mesh_id, avg(cx) as jx, avg(cy) as jy, avg(cz) as jz from geoj where junction group by mesh_id),
dist as (select vert.mesh_id, x - jx as dx, y - jy as dy, z - jz as dz, sqrt((x - jx) ** 2 + (y - jy) ** 2 + (z - jz) ** 2) as d from vert join jc using (mesh_id))"""
PRISMS = PRISMS.replace("select mesh_id, a as vertex_id from (select distinct mesh_id, a, b from (", "select mesh_id, a as vertex_id from (select mesh_id, a, b from (").replace("group by all having", "group by mesh_id, a having")
VOTES = """votes as (select (dayofweek(ts) + 1)::varchar as annotator, user_id as item, arg_max(event_type, (ts, event_id)) as label from events group by all)"""
VOXELS = """vox as (select image_id, i, j, k, least(255, floor(avg(q) * 5))::int as value from (
  select (l_orderkey // 15000)::int as image_id, (l_orderkey % 24)::int as i, (l_partkey % 24)::int as j, (l_suppkey % 8)::int as k, l_quantity::double as q from lineitem) group by image_id, i, j, k)"""
