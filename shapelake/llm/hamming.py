"""Near neighbours among 64-bit fingerprints by pigeonhole blocks, as a graph with the right components.

Two fingerprints that differ in at most ``bits`` of 64 bits agree on at least ``blocks - bits`` of ``blocks`` blocks.
Each fingerprint is dealt out once for every choice of so many blocks, and meets those that agree on them. A bucket
gives a spanning forest of its links, not its pairs. A bucket over ``most`` rows is cut into chunks, and each pair of
chunks becomes a cell of its own, on any executor, so that no task holds more than two chunks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, runs, stars


def block_masks(bits: int, blocks: int) -> list[int]:
    """A signed 64-bit mask for each choice of ``blocks - bits`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    total = [sum(x) for x in itertools.combinations(part, blocks - bits)]
    return [x - (1 << 64) if x >> 63 else x for x in total]


def _wide(column: pa.ChunkedArray) -> np.ndarray:
    """A binary column of equal lengths as rows of uint64."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _hold(i: np.ndarray, j: np.ndarray, wide: np.ndarray | None, far: int) -> np.ndarray:
    """Which of the pairs (i, j) differ in at most ``far`` bits of ``wide``; all of them without it."""
    if wide is None:
        return np.ones(len(i), bool)
    parts = [np.bitwise_count(wide[i[a : a + 65536]] ^ wide[j[a : a + 65536]]).sum(axis=1, dtype=np.int32) <= far for a in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _links(fp: np.ndarray, starts: np.ndarray, bits: int, wide: np.ndarray | None = None, far: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(i, root): a star for each group of linked rows within each run of a block of runs."""
    n = len(fp)
    run = np.zeros(n, np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    size = np.diff(np.append(starts, n))
    left, right = [], []
    for r in np.flatnonzero(size > 128):  # a block at a time: a matrix of its own
        x = fp[starts[r] : starts[r] + size[r]]
        for a in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(x[a : a + 256, None] ^ x[None, :]) <= bits)
            up = i + a < j
            i, j = i[up] + a + starts[r], j[up] + starts[r]
            keep = _hold(i, j, wide, far)
            left.append(i[keep])
            right.append(j[keep])
        if sum(map(len, left)) > 1 << 21:
            root = stars(n, np.concatenate(left), np.concatenate(right))
            left, right = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]]
    at = np.flatnonzero((size <= 128)[run])
    for step in range(1, 128):
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        near = near[_hold(near, near + step, wide, far)]
        left.append(near)
        right.append(near + step)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = stars(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def hamming_edges(fps: DataFrame, bits: int = 4, blocks: int = 6, most: int = 2048, wide: str | None = None, far: int = 0) -> DataFrame:
    """(a, b) bigint: links between the values of the bigint column ``fp`` that differ in at most ``bits`` bits.

    The links have the connected components of all such pairs, but not every pair. ``fp`` must be distinct and not
    null; an empty table gives none. ``wide`` names a column of longer fingerprints, binary and all of one length: rows then
    link only if these differ in at most ``far`` bits too, ``fp`` may repeat, and the links' ends are the distinct bigint
    column ``node``.
    """
    masks = block_masks(bits, blocks)
    signs = np.array(masks, np.int64)
    end, more = ("node", ["node", wide]) if wide else ("fp", [])
    kind = "a long, b long, t int, chunk long" + (f", node long, {wide} binary" if wide else "")

    def linked(table, starts):
        fp, ends = (table.column(c).to_numpy() for c in ("fp", end))
        i, root = _links(fp.view(np.uint64), starts, bits, _wide(table.column(wide)) if wide else None, far)
        return pa.array(ends[root]), pa.array(ends[i])

    def meet(batches):
        def keyed():
            for batch in batches:
                t, fp = batch.column("t").to_numpy(), batch.column("fp").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(fp & signs[t]), batch.column("fp"), *(batch.column(c) for c in more)], ["t", "key", "fp", *more])

        for table, starts, at in runs(keyed(), ["t", "key"], most):
            n = table.num_rows
            if at is None:
                a, b = linked(table, starts)
                out = [a, b, pa.array(np.full(len(a), -1, np.int32)), pa.array(np.zeros(len(a), np.int64)), *(pa.nulls(len(a), table.schema.field(c).type) for c in more)]
            else:
                chunk = pa.array((np.arange(at, at + n) // most).astype(np.int64))
                out = [*(table.column(c).combine_chunks() for c in ("fp", "key", "t")), chunk, *(table.column(c).combine_chunks() for c in more)]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "t", "chunk", *more])

    def cells(batches):
        for table, starts, _ in runs(batches, ["t", "key", "lo", "hi"], 4 * most):
            yield pa.RecordBatch.from_arrays(list(linked(table, starts)), ["a", "b"])

    key = F.col("fp").bitwiseAND(F.element_at(F.array([F.lit(m).cast("long") for m in masks]), F.col("t") + 1))
    dealt = fps.select(F.explode(F.lit(list(range(len(masks)))).cast("array<int>")).alias("t"), "fp", *more)
    met = materialize(map_arrow(dealt.repartition("t", key).sortWithinPartitions("t", key), meet, kind))
    edges = met.filter("t < 0").select("a", "b")
    heavy = met.filter("t >= 0").select("t", F.col("b").alias("key"), F.col("a").alias("fp"), "chunk", *more)
    if heavy.isEmpty():
        return edges
    sizes = heavy.groupBy("t", "key").agg(F.max("chunk").alias("last"))
    cell = heavy.join(sizes, ["t", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    cell = cell.select("t", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "fp", *more)
    cell = cell.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")
    return edges.union(map_arrow(cell, cells, "a long, b long"))
