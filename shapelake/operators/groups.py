"""Groupings as tall assignments (item, label), null label for an outlier: votes, agreement, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote_counts(votes: DataFrame, outlier_votes: bool = False) -> DataFrame:
    """(item, label, n) from (annotator, item, label)."""
    return (votes if outlier_votes else votes.filter("label is not null")).groupBy("item", "label").agg(F.count("*").alias("n"))


def merge_votes(votes: DataFrame, outlier_votes: bool = False) -> DataFrame:
    """(item, label): the label with most votes, ties to the smallest; an item without votes is an outlier."""
    won = vote_counts(votes, outlier_votes).groupBy("item").agg(F.min_by("label", F.struct(-F.col("n"), F.coalesce("label", F.lit("￿")))).alias("label"))
    return votes.select("item").distinct().join(won, "item", "left")


def contested_items(votes: DataFrame, outlier_votes: bool = False) -> DataFrame:
    """(item): items whose two most frequent labels have equally many votes."""
    top = vote_counts(votes, outlier_votes).groupBy("item").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))  # a label each
    return top.filter((F.size("n") > 1) & (F.get("n", F.lit(0)) == F.get("n", F.lit(1)))).select("item")


def consensus_table(votes: DataFrame, annotators: list) -> DataFrame:
    """(item, one column per annotator, label, n): each annotator's label and the most frequent one with its votes."""
    wide = votes.groupBy("item").pivot("annotator", annotators).agg(F.max("label"))
    best = vote_counts(votes).groupBy("item").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.max("n").alias("n"))
    return wide.join(best, "item", "left")


def intersection_ratios(a: DataFrame, b: DataFrame, normalize: bool = False) -> DataFrame:
    """(a_label, b_label, n, ratio): of each group of a, the share in each group of b; outliers are a group (null).

    With ``normalize`` shares are divided by the size of b's group and rescaled to add up to one per group of a.
    """
    x, y = a.select("item", F.col("label").alias("a_label")), b.select("item", F.col("label").alias("b_label"))
    n = x.join(y, "item").groupBy("a_label", "b_label").agg(F.count("*").alias("n"))
    grid = x.select("a_label").distinct().crossJoin(y.select("b_label").distinct())  # labels x labels
    full = grid.alias("g").join(n.alias("n"), F.col("g.a_label").eqNullSafe(F.col("n.a_label")) & F.col("g.b_label").eqNullSafe(F.col("n.b_label")), "left").select("g.a_label", "g.b_label", F.coalesce("n.n", F.lit(0)).alias("n"))
    sizes = y.groupBy("b_label").agg(F.count("*").alias("size"))
    value = F.col("n").cast("double")
    if normalize:
        full = full.alias("f").join(sizes.alias("s"), F.col("f.b_label").eqNullSafe(F.col("s.b_label"))).select("f.*", "size")
        value = F.col("n") / F.col("size")
    row = Window.partitionBy("a_label")
    all_ = F.sum(value).over(row)
    return full.select("a_label", "b_label", "n", (value / F.when(all_ != 0, all_)).alias("ratio"))


def ratio_distance(ratios: DataFrame) -> DataFrame:
    """(distance): mean Euclidean distance between the rows of a contingency table."""
    r = ratios.filter("ratio is not null")
    x, y = r.alias("x"), r.alias("y")
    pair = x.join(y, F.col("x.b_label").eqNullSafe(F.col("y.b_label")) & (F.coalesce("x.a_label", F.lit("")) < F.coalesce("y.a_label", F.lit(""))))
    d = pair.groupBy(F.col("x.a_label").alias("p"), F.col("y.a_label").alias("q")).agg(F.sqrt(F.sum(F.pow(F.col("x.ratio") - F.col("y.ratio"), 2))).alias("d"))
    return d.agg(F.avg("d").alias("distance"))


def accuracy(truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of truth's items that have the same label; an item without prediction counts as an outlier."""
    both = truth.select("item", F.col("label").alias("true_label")).join(predicted.select(*(by or []), "item", "label"), "item", "left")
    hit = F.avg(F.col("true_label").eqNullSafe(F.col("label")).cast("double")).alias("accuracy")
    return both.groupBy(*by).agg(hit) if by else both.agg(hit)


def per_group_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    both = truth.select("item", F.col("label").alias("true_label")).join(predicted.select("item", "label"), "item", "left")
    return both.groupBy("true_label").agg(F.avg(F.col("true_label").eqNullSafe(F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def centroids(items: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, mean): long form, added up map-side."""
    return items.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("mean"))


def centroid_arrays(items: DataFrame, label: str, vector: str) -> DataFrame:
    rows = centroids(items, label, vector).groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("c"))
    return rows.select(label, F.transform("c", lambda e: e["mean"]).alias("centre"))


def representatives(items: DataFrame, key: str, label: str, vector: str, distance, k: int) -> DataFrame:
    """(label, key, d, rank): the k items nearest to their group's mean."""
    d = items.join(centroid_arrays(items, label, vector), label).select(label, key, distance(F.col(vector), F.col("centre")).alias("d"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("d", key))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k)


def balanced_subset(items: DataFrame, key: str, label: str, order: Column) -> DataFrame:
    """As many items of each group as the smallest group has, the first by ``order``."""
    least = items.groupBy(label).count().agg(F.min("count").alias("least"))
    ranked = items.select(label, key, F.row_number().over(Window.partitionBy(label).orderBy(order, key)).alias("rank"))
    return ranked.join(F.broadcast(least), F.lit(True)).filter("rank <= least").drop("least")


def within_score(items: DataFrame, label: str, vector: str, distance) -> DataFrame:
    """(label, wss): sum of squared distances to the group's mean."""
    d = items.join(centroid_arrays(items, label, vector), label).select(label, distance(F.col(vector), F.col("centre")).alias("d"))
    return d.groupBy(label).agg(F.sum(F.col("d") * F.col("d")).alias("wss"))


def purity(truth: DataFrame, clusters: DataFrame) -> DataFrame:
    """(purity, entropy): share in each cluster's main class; class entropy weighted by size, scaled by ln k."""
    n = clusters.select("item", F.col("label").alias("c")).join(truth.select("item", F.col("label").alias("t")), "item").groupBy("c", "t").agg(F.count("*").alias("n"))
    per = n.withColumn("all", F.sum("n").over(Window.partitionBy("c"))).withColumn("r", F.col("n") / F.col("all"))
    sums = per.groupBy("c").agg(F.max("n").alias("most"), F.first("all").alias("all"), F.sum(-F.col("r") * F.ln(F.col("r") + 1e-20)).alias("h"))
    k = truth.agg(F.count_distinct("label").alias("k"))
    return sums.join(F.broadcast(k), F.lit(True)).agg((F.sum("most") / F.sum("all")).alias("purity"), (F.sum(F.col("h") * F.col("all") / F.ln("k")) / F.sum("all")).alias("entropy"))


def union_groupings(parts: dict[str, DataFrame]) -> DataFrame:
    """(item, label) of groupings of different items in one, items marked by each part's prefix."""
    out = [g.select(F.concat(F.lit(p), "item").alias("item"), "label") for p, g in parts.items()]
    for g in out[1:]:
        out[0] = out[0].unionByName(g)
    return out[0]


def best_parameter(scores: DataFrame, param: str, score: str) -> DataFrame:
    """One row: the parameter with the best score, ties to the smallest; scores that are null or no number don't count."""
    good = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    return good.agg(F.min_by(param, F.struct(-F.col(score), F.col(param))).alias(param), F.max(score).alias(score))
