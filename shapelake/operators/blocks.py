"""All pairs of items block against block: each cell is a table of distances in numpy, of which only its folds leave it.

Items are dealt to blocks; a cell has the items of two blocks, and works them off some rows at a time. Neighbours, extremes
and sums by label are folded in the cell, so that no pair is shuffled; only ``block_pairs`` returns the pairs themselves.
The number of blocks stays the same from BLOCKS * BLOCK to BLOCKS * MOST items, where each item is sent to BLOCKS cells: what
is shuffled grows as the items do, not as their pairs.
Keys are whole numbers without repeats. Items with a null vector are left out; vectors must have one length, without nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Items a block, about, if they fill fewer than BLOCKS blocks; the most items a block has on average; the blocks between.
BLOCK, MOST, BLOCKS = 1024, 1 << 15, 32
#: Rows of a cell worked off at a time, values they hold at most, and vectors taken at once where bins are summed one by one.
ROWS, VALUES, TILE = 128, 1 << 20, 128


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b != 0)


def _log(a: np.ndarray) -> np.ndarray:
    return np.log(a, out=np.zeros_like(a), where=a > 0)


def _kl(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(x == 0, y, np.where(y == 0, np.inf, x * _log(_ratio(x, y)) - x + y))
    return out.sum(axis=1)


def _symmetric_kl(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    x, y = x + 1e-6, y + 1e-6
    x, y = x / x.sum(), y / y.sum(axis=1, keepdims=True)
    return ((x - y) * np.log(x / y)).sum(axis=1) / len(x)


def _jensen_shannon(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    x, y = x / x.sum(), y / y.sum(axis=1, keepdims=True)
    m = (x + y) / 2
    total = (x * _log(_ratio(np.broadcast_to(x, y.shape), m)) + y * _log(_ratio(y, m))).sum(axis=1)
    return np.maximum(0, total / 2) ** 0.25


#: Distances and kernels by name: (vectors y, one vector x) -> the value of (x, y) for each y; the vectors module's, in numpy.
#: Cells make those in TABLES otherwise.
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": lambda y, x: np.sqrt(((x - y) ** 2).sum(axis=1)),
    "l1": lambda y, x: np.abs(x - y).sum(axis=1),
    "chi2": lambda y, x: _ratio((x - y) ** 2, x + y).sum(axis=1) / 2,
    "kl": _kl,
    "symkl": _symmetric_kl,
    "js": _jensen_shannon,
    "ks": lambda y, x: np.abs(np.cumsum(x - y, axis=1)).max(axis=1),
    "hist": lambda y, x: np.minimum(x, y).sum(axis=1),
    "laplace": lambda y, x: np.exp(-np.abs(x - y).sum(axis=1) / len(x)),
    "rbf": lambda y, x: np.exp(-((x - y) ** 2).sum(axis=1) / len(x)),
}


def root_of_squares(parts: list[tuple[str, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The root of the squared distances of a vector's parts, each given by a name in METRICS and a length."""
    ends = np.cumsum([0, *(n for _, n in parts)])
    return lambda y, x: np.sqrt(sum(METRICS[m](y[:, i:j], x[i:j]) ** 2 for (m, _), i, j in zip(parts, ends[:-1], ends[1:], strict=True)))


def _kl_parts(x: np.ndarray) -> list[np.ndarray]:
    return [x, _log(x), (x * _log(x) - x).sum(axis=1), x.sum(axis=1), (x == 0).astype(float)]


def _kl_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    out = np.maximum(a[2][:, None] + b[3] - a[0] @ b[1].T, 0)
    out[(1 - a[4]) @ b[4].T > 0] = np.inf  # b is 0 where a isn't
    return out


def _symkl_parts(x: np.ndarray) -> list[np.ndarray]:
    x = x + 1e-6
    x = x / x.sum(axis=1, keepdims=True)
    return [x, np.log(x), (x * np.log(x)).sum(axis=1)]


def _symkl_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.maximum(a[2][:, None] + b[2] - a[0] @ b[1].T - a[1] @ b[0].T, 0) / a[0].shape[1]


def _js_parts(x: np.ndarray) -> list[np.ndarray]:
    x = x / x.sum(axis=1, keepdims=True)
    return [x, (x * _log(x)).sum(axis=1)]


def _js_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(a[0]), len(b[0])))
    tiny = np.finfo(float).tiny  # its product with its logarithm is nothing beside the rest, that of 0 is none
    for r, x in enumerate(a[0]):
        m = (x + b[0]) / 2
        out[r] = (a[1][r] + b[1]) / 2 - np.einsum("ij,ij->i", m, np.log(np.maximum(m, tiny)))
        # the fourth root of what is left by rounding isn't small: near ones are summed bin by bin
        near = np.flatnonzero(out[r] < 1e-6)
        y, m = b[0][near], m[near]
        out[r, near] = (x * _log(_ratio(np.broadcast_to(x, y.shape), m)) + y * _log(_ratio(y, m))).sum(axis=1) / 2
    return np.maximum(0, out) ** 0.25


def _ks_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.abs(b[0] - x).max(axis=1) for x in a[0]])


def _mend(out: np.ndarray, few: np.ndarray, a: np.ndarray, b: np.ndarray, f: Callable) -> np.ndarray:
    """The values of ``few`` pairs, those that rounding could spoil, by ``f`` instead."""
    at = np.flatnonzero(few)
    for n in range(0, len(at), 1 << 14):
        i, j = np.divmod(at[n : n + (1 << 14)], out.shape[1])
        out[i, j] = f(b[j], a[i])
    return out


def _square_parts(x: np.ndarray, origin: np.ndarray) -> list[np.ndarray]:
    c = x - origin
    return [x, c, np.einsum("ij,ij->i", c, c)]


def _square_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Squared distances by products; those that are small beside the vectors, or not finite, bin by bin."""
    size = a[2][:, None] + b[2]
    out = a[1] @ b[1].T
    out *= -2
    out += size
    size *= 1e-3
    return _mend(out, ~(out >= size), a[0], b[0], lambda y, x: ((x - y) ** 2).sum(axis=1))


def _by_bin(a: np.ndarray, b: np.ndarray, step: Callable) -> np.ndarray:
    """Sums over bins of what ``step(y, x, out)`` writes for some vectors y and a vector x, in pieces that stay in cache."""
    out, one, room = np.empty((len(a), len(b))), np.ones(a.shape[1]), np.empty((TILE, a.shape[1]))
    for at in range(0, len(b), TILE):
        y = b[at : at + TILE]
        for r, x in enumerate(a):
            step(y, x, room[: len(y)])
            np.dot(room[: len(y)], one, out=out[r, at : at + len(y)])
    return out


def _apart(y: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    np.subtract(y, x, out=out)
    np.abs(out, out=out)


def _shared(y: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    np.add(y, x, out=out)
    np.divide(1.0, out, out=out)


def _chi2_parts(x: np.ndarray) -> list[np.ndarray]:
    with np.errstate(divide="ignore", over="ignore"):
        return [x, 1 / x, x.sum(axis=1), np.isfinite(x).all(axis=1) & (x >= 0).all(axis=1) & (x.max(axis=1, initial=0) < 1e150)]


def _chi2_table(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(x - y)^2 / (x + y) is x + y - 4 / (1 / x + 1 / y) where neither is negative; near vectors, and others, bin by bin."""
    size = (a[2][:, None] + b[2]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = size - 2 * _by_bin(a[1], b[1], _shared)
    return _mend(out, ~(out >= 1e-3 * size) | ~(a[3][:, None] & b[3]), a[0], b[0], METRICS["chi2"])


def _alone(x: np.ndarray) -> list[np.ndarray]:
    return [x]


#: Those of which a part is worked out once a vector, or in pieces: (vectors -> their parts, the parts of some and of others
#: -> their table).
TABLES: dict[str, tuple[Callable, Callable]] = {
    "kl": (_kl_parts, _kl_table),
    "symkl": (_symkl_parts, _symkl_table),
    "js": (_js_parts, _js_table),
    "ks": (lambda x: [np.cumsum(x, axis=1)], _ks_table),
    "l2": (_square_parts, lambda a, b: np.sqrt(_square_table(a, b))),
    "rbf": (_square_parts, lambda a, b: np.exp(_square_table(a, b) / -a[0].shape[1])),
    "l1": (_alone, lambda a, b: _by_bin(a[0], b[0], _apart)),
    "laplace": (_alone, lambda a, b: np.exp(_by_bin(a[0], b[0], _apart) / -a[0].shape[1])),
    "hist": (_alone, lambda a, b: _by_bin(a[0], b[0], lambda y, x, out: np.minimum(y, x, out=out))),
    "chi2": (_chi2_parts, _chi2_table),
}


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round``: half up, by the shortest decimals that stand for a number; no zero has a sign."""
    size = np.abs(d) * 10.0**digits
    with np.errstate(invalid="ignore"):
        out = np.copysign(np.floor(size + 0.5) / 10.0**digits, d) + 0.0
        close = np.flatnonzero(np.isfinite(d) & ((np.abs(size - np.floor(size) - 0.5) <= 1e-15 * size + 1e-12) | (size > 1e12)))
    unit = Decimal(1).scaleb(-digits)
    for i in close.tolist():
        x = Decimal(repr(float(d[i])))
        out[i] = float(x.quantize(unit, ROUND_HALF_UP)) + 0.0 if x.adjusted() < 20 else d[i]
    return out


class Side:
    """A block's items in the order of their labels, if they have any, and keys."""

    def __init__(self, table: pa.Table):
        key = table.column("k").to_numpy()
        self.label = table.column("l").to_numpy() if "l" in table.column_names else None
        order = np.argsort(key, kind="stable") if self.label is None else np.lexsort((key, self.label))
        self.key = key[order]
        vectors = b"".join(table.column("x").to_pylist())
        self.x = np.frombuffer(vectors).reshape(len(order), -1)[order] if len(order) else np.zeros((0, 0))
        if self.label is not None:
            self.label = self.label[order]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(labels, where each begins)."""
        begin = np.flatnonzero(np.append(True, self.label[1:] != self.label[:-1])) if len(self.label) else np.zeros(0, np.int64)
        return self.label[begin].astype(np.int64), begin


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, which are sent to a cell as one value."""
    for b in batches:
        at = b.schema.get_field_index("x")
        x = b.column(at)
        ends = pa.array(np.append(0, np.cumsum(x.value_lengths().to_numpy() * 8)).astype(np.int64))
        values = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False))
        packed = pa.Array.from_buffers(pa.large_binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(values)])
        yield b.set_column(at, "x", packed.cast(pa.binary()))


def _blocks(n: int, most: int = MOST) -> int:
    return max(8, min(BLOCKS, -(-n // BLOCK)), -(-n // most))


def _cells(items: DataFrame, key: str, vector: str, blocks: int | None, fold: Callable, schema: str, label: str | None = None, most: int = MOST, within: bool = False, whole: bool = False) -> DataFrame:
    """What fold(one block's Side, the other's, whether they are the same) yields, arrays by column, as one table of all cells.

    Without ``blocks`` their number is that of ``_blocks``, by the items as counted when the query is built. With ``within``
    only items of one label meet, in blocks of about BLOCK to ``most`` of them, and a cell's label is in the column ``l``. With
    ``whole`` the items of a label, a long, are in one block.
    """
    more = [F.col(label).cast("long").alias("l") if whole else F.col(label).alias("l") if within else F.col(label).cast("int").alias("l")] if label else []
    side = items.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("x"), *more).filter("x is not null")
    side = side.mapInArrow(_packed, ", ".join(f"{f.name} {'binary' if f.name == 'x' else f.dataType.simpleString()}" for f in side.schema))
    n = 1 if within else blocks or _blocks(items.count(), most)
    if within:
        size = side.groupBy("l").agg(F.count("*").alias("n"))
        side = side.join(size, "l").withColumn("n", F.greatest(F.least(F.lit(8), F.ceil(F.col("n") / BLOCK)), F.ceil(F.col("n") / most)).cast("int"))
    side = side.withColumn("n", F.col("n") if within else F.lit(n))
    side = side.withColumns({"own": F.pmod(F.xxhash64("l" if whole else "k"), F.col("n")).cast("int"), "o": F.explode(F.sequence(F.lit(0), F.col("n") - 1))})
    by = ["i", "j", *(["l"] if within else [])]
    cell = side.select(F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") <= F.col("o")).alias("first"), "k", "x", *(["l"] if label else []))
    columns = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        rows = rows.drop_columns("l") if within else rows
        same = key[0] == key[1]
        first = rows.column("first").combine_chunks()
        a = Side(rows.filter(first))
        b = a if same else Side(rows.filter(pa.array(~first.to_numpy(zero_copy_only=False))))
        del rows
        for found in fold(a, b, same):
            for at in range(0, len(found[0]), VALUES // 8):
                out = [pa.array(x[at : at + VALUES // 8]) for x in found]
                if within:
                    out.insert(0, pa.array([key[2].as_py()] * len(out[0]), key[2].type))
                yield pa.RecordBatch.from_arrays(out, columns)

    if not within:  # a number of tasks that isn't lowered: rows tell little of a cell's work
        cell = cell.repartition(min(n * (n + 1) // 2, 1024), "i", "j")
    return cell.groupBy(*by).applyInArrow(step, schema)


def _strips(a: Side, b: Side, metric: str | Callable):
    """(first row, distances of some of a's items to all of b's). The value is that of the item with the smaller key first."""
    whole = TABLES.get(metric) if isinstance(metric, str) else None
    f = None if whole else METRICS[metric] if isinstance(metric, str) else metric
    if whole and len(a.key) and len(b.key):
        origin = [a.x.mean(axis=0)] if whole[0] is _square_parts else []
        mine = whole[0](a.x, *origin)
        other = mine if b is a else whole[0](b.x, *origin)
    rows = max(8, min(ROWS, VALUES // max(1, len(b.key))))
    for at in range(0, len(a.key) if len(b.key) else 0, rows):
        n = min(rows, len(a.key) - at)
        if whole:
            few = [p[at : at + n] for p in mine]
            out = whole[1](few, other)
            if metric == "kl":  # the other way round where b's key is the smaller
                out = np.where(b.key < a.key[at : at + n, None], whole[1](other, few).T, out)
        else:
            out = np.empty((n, len(b.key)))
            for r in range(n):
                out[r] = f(b.x, a.x[at + r])
        yield at, out


def block_pairs(items: DataFrame, key: str, vector: str, metric: str | Callable = "l2", within: float | None = None, blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, d) for a < b; with ``within`` only pairs that near, with ``digits`` d rounded to as many. A cell passes on its
    pairs some rows at a time."""

    def fold(a: Side, b: Side, same: bool):
        for at, d in _strips(a, b, metric):
            ka, kb = np.broadcast_arrays(a.key[at : at + len(d), None], b.key[None])
            take = ka < kb if same else None
            if within is not None:
                take = d <= within if take is None else take & (d <= within)
            ka, kb, d = (x.ravel() if take is None else x[take] for x in (ka, kb, d))
            yield np.minimum(ka, kb), np.maximum(ka, kb), d if digits is None else rounded(d, digits)

    return _cells(items, key, vector, blocks, fold, "a long, b long, d double")


def _strips_at(a: Side, b: Side, limits: list[float]):
    """``_strips`` by l2, in which distances next to one of some limits are worked out bin by bin: every cell has the same."""
    for at, d in _strips(a, b, "l2"):
        close = np.zeros(d.shape, bool)
        for e in limits:
            close |= np.abs(d - e) <= 1e-9 * e
        yield at, _mend(d, close, a.x[at : at + len(d)], b.x, METRICS["l2"])


def near_counts(items: DataFrame, key: str, vector: str, limits: list[float], blocks: int | None = None) -> DataFrame:
    """(item, e, n): how many others lie within the e-th limit, a row for each cell and item that has any there."""

    def fold(a: Side, b: Side, same: bool):
        theirs = np.zeros((len(limits), len(b.key)), np.int64)
        for at, d in _strips_at(a, b, limits):
            mine = np.arange(at, at + len(d))
            if same:
                d[mine - at, mine] = np.inf
            for e, limit in enumerate(limits):
                near = d <= limit
                n = near.sum(axis=1)
                theirs[e] += 0 if same else near.sum(axis=0)
                yield a.key[mine][n > 0], np.full(int((n > 0).sum()), e, np.int32), n[n > 0]
        e, j = np.nonzero(theirs)
        yield b.key[j], e.astype(np.int32), theirs[e, j]

    return _cells(items, key, vector, blocks, fold, "item long, e int, n long")


def near_links(items: DataFrame, key: str, vector: str, cores: str, limits: list[float], blocks: int | None = None) -> DataFrame:
    """(e, a, b, inner): which items hang together within the e-th limit; bit e of the column ``cores`` marks that limit's cores.

    ``inner`` rows join cores, as a forest for each cell, the others an item that isn't a core with each core near it.
    """

    def fold(a: Side, b: Side, same: bool):
        key = a.key if same else np.concatenate([a.key, b.key])
        shift = 0 if same else len(a.key)
        roots = [np.arange(len(key)) for _ in limits]
        for at, d in _strips_at(a, b, limits):
            for e, limit in enumerate(limits):
                i, j = np.divmod(np.flatnonzero(d <= limit), d.shape[1])
                i = i + at
                i, j = (i[i < j], j[i < j]) if same else (i, j)
                x, y = a.label[i] >> e & 1 == 1, b.label[j] >> e & 1 == 1
                for outer, one, other in ((~x & y, a.key[i], b.key[j]), (x & ~y, b.key[j], a.key[i])):
                    yield np.full(int(outer.sum()), e, np.int32), one[outer], other[outer], np.zeros(int(outer.sum()), bool)
                root, p, q = roots[e], i[x & y], j[x & y] + shift
                while len(p):
                    p, q = root[p], root[q]
                    low, high = np.minimum(p, q), np.maximum(p, q)
                    low, high = low[low < high], high[low < high]
                    if not len(low):
                        break
                    np.minimum.at(root, high, low)
                    joined = np.unique(high)
                    yield np.full(len(joined), e, np.int32), key[joined], key[root[joined]], np.ones(len(joined), bool)
                    while (root[root] != root).any():
                        root[:] = root[root]
                    p, q = low, high

    return _cells(items, key, vector, blocks, fold, "e int, a long, b long, inner boolean", cores)


class _Best:
    """The least value of each of n items and the smallest key it is reached with."""

    def __init__(self, n: int):
        self.d, self.key = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)

    def add(self, i: np.ndarray, d: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((key, d, i))
        order = order[np.append(True, i[order][1:] != i[order][:-1])] if len(i) else order
        i, d, key = i[order], d[order], key[order]
        better = (d < self.d[i]) | ((d == self.d[i]) & (key < self.key[i]))
        self.d[i[better]], self.key[i[better]] = d[better], key[better]


def nearest_and_farthest(items: DataFrame, key: str, vector: str, metric: str = "l2", blocks: int | None = None) -> DataFrame:
    """(item, nearest, d_near, farthest, d_far), ties to the smaller key; an item alone has no row.

    What products give may differ in its last digits: those as good as the best are worked out bin by bin, so that
    equal vectors tie. A cell passes on two rows an item."""
    again = METRICS[metric] if metric in ("l2", "rbf") else None

    def fold(a: Side, b: Side, same: bool):
        best = [(sign, _Best(len(a.key)), _Best(len(b.key))) for sign in (1, -1)]
        for at, d in _strips(a, b, metric):
            mine = np.arange(len(d))
            for sign, ours, theirs in best:
                e = d if sign > 0 else -d
                if same:
                    e = e.copy() if sign > 0 else e
                    e[mine, at + mine] = np.inf

                def found(most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    i, j = np.divmod(np.flatnonzero(e <= most + (np.abs(most) * 1e-9 if again else 0)), e.shape[1])  # noqa: B023
                    return i, j, sign * again(b.x[j], a.x[at + i]) if again else e[i, j]  # noqa: B023

                i, j, x = found(e.min(axis=1, initial=np.inf)[:, None])
                if same:
                    i, j, x = (v[at + i != j] for v in (i, j, x))
                ours.add(at + i, x, b.key[j])
                if not same:
                    i, j, x = found(np.minimum(e.min(axis=0), theirs.d)[None])
                    theirs.add(j, x, a.key[at + i])
        for sign, ours, theirs in best:
            for side, x in ((a, ours),) if same else ((a, ours), (b, theirs)):
                real = np.isfinite(x.d)
                yield side.key[real], np.full(int(real.sum()), sign > 0), x.d[real], x.key[real]

    found = _cells(items, key, vector, blocks, fold, "item long, near boolean, d double, other long")
    least = lambda near: F.min(F.when(F.col("near") == near, F.struct("d", "other")))
    out = found.groupBy("item").agg(least(True).alias("n"), least(False).alias("f"))
    return out.select("item", F.col("n.other").alias("nearest"), F.col("n.d").alias("d_near"), F.col("f.other").alias("farthest"), (-F.col("f.d")).alias("d_far"))


def kth_neighbours(items: DataFrame, key: str, vector: str, k: int, metric: str = "l2", blocks: int | None = None) -> DataFrame:
    """(item, kth): distance of the k-th neighbour, the item itself the first. A cell passes on k - 1 distances an item."""
    most = k - 1

    def fold(a: Side, b: Side, same: bool):
        theirs = np.full((len(b.key), most), np.inf)  # the least so far, in order
        for at, d in _strips(a, b, metric):
            mine = np.arange(at, at + len(d))
            if same:
                d[mine - at, mine] = np.inf
            few = np.partition(d, most - 1, axis=1)[:, :most] if d.shape[1] > most else d
            real = np.isfinite(few)
            yield np.repeat(a.key[mine], real.sum(axis=1)), few[real]
            if not same and most:
                i, j = np.divmod(np.flatnonzero(d < theirs[:, -1]), d.shape[1]) if at else (None, None)
                if at:
                    cols = np.unique(j)
                    j, x = np.concatenate([j, np.repeat(cols, most)]), np.concatenate([d[i, j], theirs[cols].ravel()])
                    order = np.lexsort((x, j))
                    j, x = j[order], x[order]
                    rank = np.arange(len(j)) - np.searchsorted(j, j)
                    theirs[j[rank < most], rank[rank < most]] = x[rank < most]
                else:
                    n = min(most, len(d))
                    theirs[:, :n] = np.sort(np.partition(d.T, n - 1, axis=1)[:, :n], axis=1)
        real = np.isfinite(theirs)
        yield np.repeat(b.key, real.sum(axis=1)), theirs[real]

    near = _cells(items, key, vector, blocks, fold, "item long, d double")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("d"))
    return near.withColumn("rank", rank).filter(F.col("rank") == most).select("item", F.col("d").alias("kth"))


def label_sums(items: DataFrame, key: str, vector: str, label: str, metric: str | Callable = "l2", blocks: int | None = None, itself: bool = False) -> DataFrame:
    """(item, own, other, total, n): sum and number of each item's values with the items of every label; labels are numbers.
    With ``itself`` an item counts among those of its own. A cell holds and passes on a sum an item and label."""
    most = MOST if blocks else max(BLOCK, min(MOST, (1 << 22) // max(1, items.select(label).distinct().count())))

    def fold(a: Side, b: Side, same: bool):
        (names, begin), (others, start) = a.groups(), b.groups()
        size, count = np.diff(np.append(begin, len(a.key))), np.diff(np.append(start, len(b.key)))
        theirs = None if same else np.zeros((len(names), len(b.key)))

        def rows(side: Side, mine: np.ndarray, groups: np.ndarray, sums: np.ndarray, count: np.ndarray):
            n = np.broadcast_to(count, sums.shape) - (same & (not itself) & (groups[None] == side.label[mine][:, None]))
            i, g = np.nonzero(n > 0)
            return side.key[mine][i], side.label[mine][i].astype(np.int64), groups[g], sums[i, g], n[i, g].astype(np.int64)

        for at, d in _strips(a, b, metric):
            mine = np.arange(at, at + len(d))
            yield rows(a, mine, others, np.add.reduceat(d, start, axis=1), count)
            if not same:
                first, last = np.searchsorted(begin, [at, at + len(d) - 1], side="right") - 1
                theirs[first : last + 1] += np.add.reduceat(d, np.maximum(begin[first : last + 1] - at, 0), axis=0)
        if not same and len(a.key) and len(b.key):
            yield rows(b, np.arange(len(b.key)), names, theirs.T, size)

    return _cells(items, key, vector, blocks, fold, "item long, own long, other long, total double, n long", label, most)


def within_labels(items: DataFrame, key: str, vector: str, label: str, most: int = 8192) -> DataFrame:
    """(l, n, l2, l1): for each cell of items of one label the number of its pairs, the sum of their Euclidean distances and
    the greatest city-block distance. No pair leaves a cell; items without a label are left out."""

    def fold(a: Side, b: Side, same: bool):
        for (at, d), (_, e) in zip(_strips(a, b, "l2"), _strips(a, b, "l1"), strict=True):
            take = np.arange(at, at + len(d))[:, None] < np.arange(len(b.key)) if same else np.ones(d.shape, bool)
            if take.any():
                yield np.array([take.sum()]), np.array([d[take].sum()]), np.array([e[take].max()])

    kind = items.schema[label].dataType.simpleString()
    return _cells(items.filter(F.col(label).isNotNull()), key, vector, None, fold, f"l {kind}, n long, l2 double, l1 double", label, most, within=True)


def silhouette(items: DataFrame, key: str, vector: str, label: str, metric: str = "l2", blocks: int | None = None) -> DataFrame:
    """(item, label, s) of items with a label; alone in its group: 0. A cell passes on a sum and a number an item and label."""
    labelled = items.filter(F.col(label).isNotNull())
    names = labelled.select(F.col(label).alias("name")).distinct()
    names = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("number"))  # the groups, not the items
    numbered = labelled.join(names, F.col(label) == F.col("name")).select(F.col(key).alias("k"), F.col(vector).alias("v"), "number")
    sums = label_sums(numbered, "k", "v", "number", metric, blocks)
    mean = sums.groupBy("item", "own", "other").agg((F.sum("total") / F.sum("n")).alias("d"))
    inner = F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("inner")
    parts = mean.groupBy("item", "own").agg(inner, F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("next"))
    s = F.coalesce(F.try_divide(F.col("next") - F.col("inner"), F.greatest("inner", "next")), F.lit(0.0))
    s = F.when(F.col("inner").isNull() | F.col("next").isNull(), 0.0).otherwise(s)
    return parts.join(names, F.col("own") == F.col("number")).select("item", F.col("name").alias("label"), s.alias("s"))


def cluster_distances(items: DataFrame, key: str, vector: str, cluster: str, nearest: bool = True, blocks: int | None = None) -> DataFrame:
    """(a, b, d): greatest Euclidean distance of two clusters' items, clusters being whole numbers. With ``nearest`` a cluster
    has a row a cell with its nearest there, ties to the smaller, else all pairs have one, a < b.

    A pair of clusters is reckoned in one cell only, so both have the same distance to each other. No pair of items leaves a cell.
    """

    def fold(a: Side, b: Side, same: bool):
        (names, begin), (others, start) = a.groups(), b.groups()
        theirs, who = np.full(len(others), np.inf), np.zeros(len(others), np.int64)
        held = None
        for at, d in _strips(a, b, "l2"):
            first, last = np.searchsorted(begin, [at, at + len(d) - 1], side="right") - 1
            far = np.maximum.reduceat(d, start, axis=1) if len(start) < d.shape[1] else d
            cut = np.maximum(begin[first : last + 1] - at, 0)
            far = np.maximum.reduceat(far, cut, axis=0) if len(cut) < len(far) else far
            if held is not None:  # a cluster that began in the strip before
                far[0] = np.maximum(far[0], held)
            ends = last + 1 == len(begin) or begin[last + 1] == at + len(d)
            over = at + len(d) == len(a.key)
            held = None if ends or over else far[-1].copy()
            far = far if held is None else far[:-1]
            mine = np.arange(first, first + len(far))
            if not len(mine):
                continue
            if same:
                far = np.where(np.arange(len(others)) > mine[:, None], far, np.inf)
            if not nearest:
                i, j = np.nonzero(np.isfinite(far))
                x, y = names[mine[i]], others[j]
                yield np.minimum(x, y), np.maximum(x, y), far[i, j]
                continue
            j, i = far.argmin(axis=1), far.argmin(axis=0)
            d, e = far[np.arange(len(far)), j], far[i, np.arange(len(others))]
            real, better = np.isfinite(d), e < theirs
            theirs[better], who[better] = e[better], names[mine[i[better]]]
            yield names[mine[real]], others[j[real]], d[real]
        real = np.isfinite(theirs)
        yield others[real], who[real], theirs[real]

    return _cells(items, key, vector, blocks, fold, "a long, b long, d double", cluster, whole=True)


def kernel_kmeans(items: DataFrame, key: str, vector: str, label: str, metric: str | Callable = "rbf", rounds: int = 100, tolerance: float = 0.01, blocks: int | None = None) -> DataFrame:
    """(item, label) as ``cluster.kernel_kmeans`` gives them, from vectors and their first labels, for a kernel that is 1 for
    equal vectors. No pair is kept: a round's cells pass on a sum and a number an item and label."""
    names = items.filter(F.col(label).isNotNull()).select(F.col(label).alias("name")).distinct()
    names = materialize(names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("number")), tidy=False)  # the groups, not the items
    vectors = materialize(items.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).alias("name")).join(names, "name", "left").select("k", "v", F.coalesce("number", F.lit(-1)).alias("number")))
    now, before = vectors.select(F.col("k").alias("item"), "number"), None
    blocks = blocks or _blocks(vectors.count(), max(BLOCK, min(MOST, (1 << 22) // max(1, names.count()))))
    for _ in range(rounds):
        labelled = vectors.drop("number").join(now.select(F.col("item").alias("k"), "number"), "k")
        sums = label_sums(labelled, "k", "v", "number", metric, blocks, itself=True).filter("other >= 0")  # -1 is no group
        sums = materialize(sums.groupBy("item", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), tidy=False)
        within = sums.filter("own = other").groupBy("other").agg((F.sum("total") / F.sum("n")).alias("within"))
        d = sums.join(F.broadcast(within), "other").select("item", "other", (1 - 2 * F.col("total") / F.col("n") + F.col("within")).alias("d"))
        found = materialize(d.groupBy("item").agg(F.min_by("other", F.struct("d", "other")).cast("int").alias("number"), F.min("d").alias("d")))
        inertia = found.agg(F.sum("d")).first()[0]
        discard(sums)
        now = found
        if before is not None and abs(before - inertia) <= tolerance:
            break
        before = inertia
    return now.join(F.broadcast(names), "number").select("item", F.col("name").alias("label"))
