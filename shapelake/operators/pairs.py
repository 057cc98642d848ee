"""Pairs of items under a distance, and what is read off them: neighbours, extremes, silhouette, elbow.

All pairs are the operation itself here, so they are made block against block: items are dealt to blocks, and each unordered pair of blocks is a group of its own. Every row of a group meets only its partner block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Items a block, about.
BLOCK = 4096


def pair_table(items: DataFrame, key: str, vector: str, distance: Callable[[Column, Column], Column], blocks: int | None = None, within: float | None = None) -> DataFrame:
    """(a, b, d) for a < b; with ``within`` only pairs that near.

    Without ``blocks`` there is a block for every ``BLOCK`` items, and at least 8: a cell holds two blocks, on any executor.
    """
    blocks = blocks or max(8, -(-items.count() // BLOCK))
    side = items.select(F.col(key).alias("k"), F.col(vector).alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("blk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # each item once per partner block: as the first of the cell or as the second
    left = side.withColumn("o", other).filter("blk <= o").select(F.col("k").alias("ka"), F.col("x").alias("xa"), F.col("blk").alias("i"), F.col("o").alias("j"))
    right = side.withColumn("o", other).filter("o <= blk").select(F.col("k").alias("kb"), F.col("x").alias("xb"), F.col("o").alias("i"), F.col("blk").alias("j"))
    met = left.join(right, ["i", "j"]).filter((F.col("i") != F.col("j")) | (F.col("ka") < F.col("kb")))
    first = F.col("ka") < F.col("kb")
    met = met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.when(first, F.col("xa")).otherwise(F.col("xb")).alias("x"), F.when(first, F.col("xb")).otherwise(F.col("xa")).alias("y"))
    out = met.select("a", "b", distance(F.col("x"), F.col("y")).alias("d"))
    return out if within is None else out.filter(F.col("d") <= within)


def both_sides(pairs: DataFrame) -> DataFrame:
    """(a, b, d) with each pair both ways."""
    return pairs.select(F.inline(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))))


def nearest_and_farthest(pairs: DataFrame) -> DataFrame:
    """(item, nearest, d_near, farthest, d_far), ties to the smaller key."""
    p = both_sides(pairs)
    near, far = F.struct("d", "b"), F.struct(-F.col("d"), "b")
    return p.groupBy(F.col("a").alias("item")).agg(F.min_by("b", near).alias("nearest"), F.min("d").alias("d_near"), F.min_by("b", far).alias("farthest"), F.max("d").alias("d_far"))


def knn_elbow(pairs: DataFrame, k: int) -> DataFrame:
    """(item, kth): distance of the k-th neighbour, the item itself the first."""
    order = Window.partitionBy("a").orderBy("d", "b")
    return both_sides(pairs).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == k - 1).select(F.col("a").alias("item"), F.col("d").alias("kth"))


def beyond(kth: DataFrame, eps: DataFrame) -> DataFrame:
    """(eps, n): how many items' k-th neighbour is at ``eps`` or farther, for every value in the small table ``eps``."""
    hit = F.sum(F.when(F.col("kth") >= F.col("eps"), 1).otherwise(0))
    return kth.join(F.broadcast(eps), F.lit(True)).groupBy("eps").agg(hit.alias("n"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, label, s): labels (item, label), null labels left out; alone in its group: 0."""
    labels = labels.filter("label is not null")
    p = both_sides(pairs).join(labels.select(F.col("item").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("item").alias("b"), F.col("label").alias("lb")), "b")
    mean = p.groupBy("a", "la", "lb").agg(F.avg("d").alias("d"))
    parts = mean.groupBy("a", "la").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("next"))
    s = F.when(F.col("own").isNull() | F.col("next").isNull() | (F.greatest("own", "next") == 0), 0.0).otherwise((F.col("next") - F.col("own")) / F.when(F.greatest("own", "next") != 0, F.greatest("own", "next")))
    return parts.select(F.col("a").alias("item"), F.col("la").alias("label"), s.alias("s"))
