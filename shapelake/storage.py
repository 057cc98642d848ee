"""Tables written once to the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Unset, it is the temp folder on a local master and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.gettempdir()}/shapelake"
    return f"{base.rstrip('/')}/shapelake-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, tidy: bool = True) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives lost executors, computes nothing twice.

    ``tidy`` also frees the disk of shuffles that are over, which takes longer than writing a small table does."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    if tidy:
        spark._jvm.System.gc()  # Spark deletes a finished job's shuffle files when the driver collects what refers to them
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_counted(rows: DataFrame, small: DataFrame, on: str, most: int = 1 << 20) -> DataFrame:
    """rows joined with a materialized ``small``, which is broadcast if it has at most ``most`` rows."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, on)


def join_skewed(rows: DataFrame, keys: DataFrame, on: list[str], hot: int = 10_000, most: int = 1 << 20) -> DataFrame:
    """rows joined with materialized ``keys``, unique by ``on``, whose column ``rows`` counts the rows of each key.

    Keys of over ``hot`` rows are joined by broadcast, so that a key's rows stay spread over tasks; over ``most`` of
    those, the join is left to Spark's own treatment of skew. Both sides' rows are read twice where there are hot keys.
    """
    few = keys.filter(F.col("rows") > hot)
    if not 0 < few.count() <= most:
        return rows.join(keys.drop("rows"), on)
    cold = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keys.filter(F.col("rows") <= hot).drop("rows"), on)
    return cold.unionByName(rows.join(F.broadcast(few.drop("rows")), on))
