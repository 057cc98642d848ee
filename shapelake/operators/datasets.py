"""Metric datasets: names, feature sets, distances by metric, distributions, clean-ups, groupings compared, sweeps."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import vectors as V
from . import groups

#: The feature sets by name, with the kernel that classifiers use on each.
FEATURE_SETS = {
    "Classic": (["OpenAngle", "CVD", "AverageDistance", "LengthVolumeRatio", "LengthAreaRatio", "JunctionArea", "Length", "Area", "Volume", "ConvexHullVolume", "ConvexHullRatio"], "rbf"),
    "Combined": (None, "laplace"),
    "Chord": (["OldChordDistribution"], "laplace"),
}


def feature_set(items: DataFrame, name: str, key: str = "item_id") -> DataFrame:
    """The key and the columns of a feature set; ``Combined`` takes all."""
    columns = FEATURE_SETS[name][0]
    return items if columns is None else items.select(key, *columns)


def names(items: DataFrame, key: str) -> DataFrame:
    """The distinct keys in ascending order."""
    return items.select(key).distinct().orderBy(key)


def metric_names(items: DataFrame, key: str) -> list[str]:
    return [c for c in items.columns if c != key]


def metric_distance(items: DataFrame, distances: dict[str, str | Callable], default: str = "l2", root: bool = True) -> Callable[[Column, Column], Column]:
    """A distance of two structs of metrics: each metric by the distance assigned to it, else ``default``; put together as
    the root of the squares, or as a sum. Scalars count as vectors of one place."""
    kinds = {f.name: f.dataType for f in items.schema}

    def distance(x: Column, y: Column) -> Column:
        parts = []
        for name, kind in kinds.items():
            d = distances.get(name, default)
            d = V.DISTANCES[d] if isinstance(d, str) else d
            side = [s[name] if isinstance(kind, ArrayType) else F.array(s[name].cast("double")) for s in (x, y)]
            parts.append(d(*side))
        return V.composite(parts, root=root)

    return distance


def metric_distribution(items: DataFrame, column: str) -> DataFrame:
    """(pos, value): of a vector metric the mean of each place; of a scalar one its values, in order."""
    if isinstance(items.schema[column].dataType, ArrayType):
        return items.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("value"))
    return items.select(F.lit(0).alias("pos"), F.col(column).cast("double").alias("value")).orderBy("value")


def clean_name(name: Column, rename: dict[str, str] | None = None, prefix: str | None = None) -> Column:
    """Forward slashes, parts renamed, a leading ``prefix`` taken off."""
    out = F.replace(name, F.lit("\\"), F.lit("/"))
    for old, new in (rename or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out if prefix is None else F.when(F.startswith(out, F.lit(prefix)), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)


def parse_complex_rows(text: Column) -> Column:
    """Array of arrays of structs (re, im) from the text of a complex matrix: ``[[1.+2.j 0.-1.j] [ ...]]``."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    rows = F.filter(F.split(text, r"\]\s*"), lambda r: F.rlike(r, F.lit(r"\d")))

    def place(cell: Column) -> Column:
        pair = F.regexp_extract_all(cell, F.lit(f"{number}"), F.lit(0))
        return F.struct(F.get(pair, F.lit(0)).cast("double").alias("re"), F.coalesce(F.get(pair, F.lit(1)), F.lit("0")).cast("double").alias("im"))

    cells = lambda r: F.regexp_extract_all(r, F.lit(f"{number}(?:{number}j)?"), F.lit(0))
    return F.transform(rows, lambda r: F.transform(cells(r), place))


def real_parts(z: Column) -> Column:
    """Real parts of an array of structs (re, im)."""
    return F.transform(z, lambda e: e["re"])


def clusters(assignments: DataFrame) -> DataFrame:
    """(label, n, members): the clusters, outliers (null label) left out, members in order."""
    return assignments.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item")).alias("members"))


def outliers(assignments: DataFrame) -> DataFrame:
    return assignments.filter("label is null").select("item")


def cluster(assignments: DataFrame, label) -> DataFrame:
    return assignments.filter(F.col("label") == label).select("item")


def compare_groupings(assignments: DataFrame, reference: DataFrame) -> DataFrame:
    """(grouping_id, n, accuracy, purity) of many groupings (grouping_id, item, label) against one (item, label).

    n counts the items that both know; accuracy is the share of these with the reference's label; purity is the share in
    its group's commonest reference label. Null labels agree with nothing and are a group of their own.
    """
    both = assignments.join(reference.select("item", F.col("label").alias("truth")), "item")
    cells = both.groupBy("grouping_id", "label", "truth").agg(F.count("*").alias("n"))
    rows = cells.groupBy("grouping_id", "label").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("label") == F.col("truth"), F.col("n")).otherwise(0)).alias("hits"))
    return rows.groupBy("grouping_id").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("most") / F.sum("n")).alias("purity"))


def keep_components(labelled: DataFrame, selection: DataFrame, on: list[str]) -> DataFrame:
    """The rows of the components named in ``selection``."""
    return labelled.join(selection.select(*on).distinct(), on, "left_semi")


def within_groups(assignments: DataFrame, items: DataFrame, vector: str = "x") -> DataFrame:
    """One row, score: sum of squared distances to the groups' means."""
    labelled = items.select("item", vector).join(assignments.filter("label is not null"), "item")
    return groups.within_score(labelled, "label", vector, V.euclidean).agg(F.sum("wss").alias("score"))


def group_count(assignments: DataFrame, items: DataFrame) -> DataFrame:
    """One row, score: the number of groups."""
    return assignments.agg(F.count_distinct("label").cast("double").alias("score"))


#: Scores of a clustering by name: (assignments, items) -> one row, score. Callers may give their own.
SCORES = {"within": within_groups, "groups": group_count}


def cluster_counts(most: int, items: DataFrame, step: int = 1) -> list[int]:
    """2, 2 + step, ... up to ``most``, or the number of items if that is smaller."""
    return list(range(2, min(most, items.count()) + 1, step))


def sweep(items: DataFrame, values: Iterable, fit: Callable, score: str | Callable) -> DataFrame:
    """(value, score): ``fit(items, value)`` gives assignments (item, label), and ``score`` judges them."""
    judge = SCORES[score] if isinstance(score, str) else score
    rows = [judge(fit(items, v), items).select(F.lit(float(v)).alias("value"), F.col("score").cast("double").alias("score")) for v in values]
    return functools.reduce(DataFrame.unionByName, rows)
