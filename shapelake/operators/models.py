"""Kernel classifiers over a grid of train ratios, costs and folds, all trained at once.

A kernel becomes features by landmarks (Nystrom): a bounded number of items, whose own kernel matrix is whitened on the
driver. A model is one class against the rest for one (ratio, cost, fold); a step reads the items once and adds up
the gradients of all models in each task, so a step moves models x features numbers a task whatever the items' number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Rows of a file of the items that every step reads, about.
FILE = 1 << 13


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def kernel_values(kind: str, x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel of each row of x with each of y: rbf, laplacian or histogram (sum of the smaller bins)."""
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
    if kind == "laplacian":
        return np.stack([np.exp(-gamma * np.abs(x - v).sum(axis=1)) for v in y], axis=1)
    if kind == "histogram":
        return np.stack([np.minimum(x, v).sum(axis=1) for v in y], axis=1)
    raise ValueError(f"no kernel {kind!r}")


def nystrom_features(items: DataFrame, key: str, vector: str, kind: str = "rbf", gamma: float | None = None, landmarks: int = 128) -> DataFrame:
    """``items`` with ``vector`` replaced by features whose dot products are near the kernel, and equal to it between landmarks.

    Landmarks are the ``landmarks`` items with the least hashes of their keys, the bound on what is collected. gamma is 1 / length unless
    given. Items without a vector go.
    """
    items = items.filter(F.col(vector).isNotNull())
    taken = [r[0] for r in items.orderBy(F.xxhash64(key), key).select(vector).limit(landmarks).collect()]
    if not taken:
        return items
    marks = np.unique(np.array(taken, float), axis=0)
    gamma = gamma or 1 / marks.shape[1]
    values, axes = np.linalg.eigh(kernel_values(kind, marks, marks, gamma))
    good = values > 1e-10 * values[-1]
    white = axes[:, good] / np.sqrt(values[good])
    others = [c for c in items.columns if c != vector]

    def step(batches):
        for b in batches:
            if b.num_rows:
                z = kernel_values(kind, _rows(b.column(vector)), marks, gamma) @ white
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(list(z), pa.list_(pa.float64()))], [*others, vector])

    schema = ", ".join([*(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in others), f"`{vector}` array<double>"])
    return items.select(*others, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(step, schema)


#: A task hands on so many rows of its matrix as one.
SPAN = 64


def _emitted(total: np.ndarray) -> pa.RecordBatch:
    spans = [total[at : at + SPAN].tobytes() for at in range(0, len(total), SPAN)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(spans), dtype=np.int32)), pa.array(spans, pa.binary())], ["i", "v"])


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of tasks' matrices, given as rows (i, v) by ``_emitted``: a group has one row a task."""

    def add(table):
        v = sum(np.frombuffer(x.as_buffer()) for x in table.column("v"))
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    found = {r["i"]: np.frombuffer(r["v"]) for r in parts.groupBy("i").applyInArrow(add, "i int, v binary").collect()}
    return np.concatenate([found[i] for i in range(len(found))]).reshape(shape) if found else np.zeros(shape)


#: Ranks are counted in so many parts a class, by the upper bits of a hash.
PARTS_BITS = 10


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their place ``rank`` in their label's order by a hash of the key, then the key, from 1."""
    hashed = rows.withColumn("__h", F.xxhash64("key", F.lit(seed))).withColumn("__part", F.shiftright("__h", 64 - PARTS_BITS))
    sizes = hashed.groupBy("label", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("label").orderBy("__part")) - F.col("__n")
    sizes = F.broadcast(sizes.select("label", "__part", before.alias("__before")))
    within = F.row_number().over(Window.partitionBy("label", "__part").orderBy("__h", "key"))
    return hashed.join(sizes, ["label", "__part"]).withColumn("rank", F.col("__before") + within).drop("__h", "__part", "__before")


def grid_search(items: DataFrame, key: str, vector: str, label: str, ratios: list[float], costs: list[float] = (1.0, 10.0), folds: int = 4, rounds: int = 60, seed: int = 0):
    """(table, predict): table has a row a ratio: ratio, cost, cv_accuracy, accuracy; predict(items, ratio) gives (key, label).

    For each ratio, the first floor(n * ratio) + 1 of a class' n items in a seeded order are the training rows. The cost with
    the best mean accuracy over ``folds`` folds of these, the least of equal ones, is fitted on all of them; ``accuracy``
    is its share of hits among the other items (null if there are none). The models are linear with squared hinge loss
    and a bias: least |w|^2 / 2 + cost * sum of losses, by ``rounds`` accelerated gradient steps, one job each. Items without label or vector are left out.
    """
    spark = items.sparkSession
    rows = items.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = materialize(rows)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a class
    if not sizes:
        return spark.createDataFrame([], "ratio double, cost double, cv_accuracy double, accuracy double"), None
    names = sorted(sizes)
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, y int")
    placed = _ranked(rows, seed).join(F.broadcast(index), "label").select("key", "y", "rank", "x")
    ranked = materialize(placed.repartition(max(8, -(-sum(sizes.values()) // FILE)), "key").sortWithinPartitions("rank"))  # alike rows side by side
    discard(rows)
    counts, classes = np.array([sizes[n] for n in names]), len(names)
    grid = [(r, c, f) for r in range(len(ratios)) for c in range(len(costs)) for f in range(-1, folds)]  # fold -1 trains on all
    at_ratio, at_cost, at_fold = (np.array(v) for v in zip(*grid, strict=True))
    takes = np.floor(counts[:, None] * np.array(ratios)) + 1  # training rows by class and ratio
    cost = np.repeat(np.array(costs)[at_cost], classes)
    d = len(ranked.first()["x"]) + 1

    def parts(b):
        x = _rows(b.column("x"))
        y, place = (b.column(c).to_numpy() for c in ("y", "rank"))
        chosen = (place[:, None] <= takes[y])[:, at_ratio]
        held = (place[:, None] % folds == at_fold) & (at_fold >= 0)
        return np.concatenate([x, np.ones((len(x), 1))], axis=1), y, chosen, held

    values = np.array(ratios, float)
    larger = (values[:, None] <= values).sum(axis=1)  # ratios that are not smaller: those of a row are the largest ones

    def alike(b):
        """(x, classes, models) of rows that the same (ratio, cost, fold) train on: the others' gradients there are nothing."""
        x = np.concatenate([_rows(b.column("x")), np.ones((b.num_rows, 1))], axis=1)
        y, place = (b.column(c).to_numpy() for c in ("y", "rank"))
        group = (place[:, None] <= takes[y]).sum(axis=1) * folds + place % folds
        order = np.argsort(group, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            many, fold = divmod(int(group[at[0]]), folds)
            yield x[at], y[at], np.flatnonzero((larger[at_ratio] <= many) & (at_fold != fold))

    def gram(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = parts(b)[0]
            total += x.T @ x
        yield _emitted(total)

    def slopes(w):
        def step(batches):
            total = np.zeros((len(cost), d))
            for whole in batches:
                for x, y, models in alike(whole):
                    if not len(models):
                        continue
                    trained = w.reshape(len(grid), classes, d)[models].reshape(-1, d).T
                    sum_ = np.zeros((len(models) * classes, d))
                    for a in range(0, len(x), 1024):
                        some, at = x[a : a + 1024], np.arange(len(x[a : a + 1024]))
                        z = some @ trained
                        z += 1
                        by_class = z.reshape(len(some), len(models), classes)
                        own = by_class[at, :, y[a : a + 1024]]
                        np.maximum(z, 0, out=z)
                        by_class[at, :, y[a : a + 1024]] = -np.maximum(0, 2 - own)
                        sum_ += z.T @ some
                    total.reshape(len(grid), classes, d)[models] += sum_.reshape(len(models), classes, d)
            yield _emitted(2 * cost[:, None] * total)

        return step

    def hits(w):
        def step(batches):
            total = np.zeros((len(grid), 2))
            for whole in batches:
                for a in range(0, whole.num_rows, 2048):
                    x, y, chosen, held = parts(whole.slice(a, 2048))
                    guess = (x @ w.T).reshape(len(x), len(grid), classes).argmax(axis=2)
                    tested = np.where(at_fold >= 0, chosen & held, ~chosen)
                    total += np.stack([(tested & (guess == y[:, None])).sum(axis=0), tested.sum(axis=0)], axis=1)
            yield _emitted(total)

        return step

    run = lambda step, shape: _added(ranked.mapInArrow(step, "i int, v binary"), shape)
    steep = 1 + 2 * cost * np.linalg.eigvalsh(run(gram, (d, d)))[-1]
    w = ahead = np.zeros((len(cost), d))
    pace = np.ones((len(cost), 1))
    for _ in range(rounds):
        slope = ahead + run(slopes(ahead), w.shape)
        new = ahead - slope / steep[:, None]
        again = ((slope * (new - w)).sum(axis=1) > 0)[:, None]  # overshot: start anew from here
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = np.where(again, new, new + (pace - 1) / later * (new - w))
        pace = np.where(again, 1.0, later)
        w = new
    n = run(hits(w), (len(grid), 2))
    share = np.where(n[:, 1] > 0, n[:, 0] / np.maximum(n[:, 1], 1), np.nan)
    number = {g: i for i, g in enumerate(grid)}
    table, best = [], {}
    for r, ratio in enumerate(ratios):
        means = [np.nanmean(s) if (s := share[[number[(r, c, f)] for f in range(folds)]]).size and not np.isnan(s).all() else 0.0 for c in range(len(costs))]
        c = int(np.argmax(means))
        i = number[(r, c, -1)]
        best[ratio] = w[i * classes : (i + 1) * classes]
        table.append((float(ratio), float(costs[c]), float(means[c]), None if np.isnan(share[i]) else float(share[i])))

    def predict(items: DataFrame, ratio: float) -> DataFrame:
        weights = best[ratio]

        def step(batches):
            for b in batches:
                if b.num_rows:
                    x = _rows(b.column("x"))
                    guess = (x @ weights[:, :-1].T + weights[:, -1]).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(key), pa.array([names[g] for g in guess])], [key, "label"])

        kind = items.schema[key].dataType.simpleString()
        return items.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x")).mapInArrow(step, f"`{key}` {kind}, label string")

    return spark.createDataFrame(table, "ratio double, cost double, cv_accuracy double, accuracy double"), predict
