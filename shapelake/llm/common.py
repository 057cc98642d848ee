"""Shared pieces: files in the cluster's shared folder, words, graph components."""

from __future__ import annotations

import itertools
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import connected_components, stars
from ..storage import discard, materialize, scratch_dir

__all__ = ["binary_values", "connected_components", "discard", "free_name", "map_arrow", "materialize", "pieces", "runs", "scratch_dir", "ship", "stars"]

#: The word separators of every operator here: the ASCII blanks, which are what bytes.split() splits on.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once, which need not share the driver's PYTHONPATH."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, step, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(step, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes for df not to have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def binary_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding; null gives b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch whose values in ``column`` hold about ``most`` bytes, one row at least."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def runs(batches, keys: list[str], most: int):
    """Cut batches sorted by ``keys`` into blocks of whole runs of equal keys.

    Yields ``(table, starts, at)``: with ``at`` None, whole runs that begin at ``starts``, none over ``most`` rows;
    else the rows from ``at`` on of one longer run. Holds one batch and at most ``most`` rows besides.
    """
    rest, long_key, passed = None, None, 0
    for batch in itertools.chain(batches, [None]):
        t = rest
        if batch is not None:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if t is None or not t.num_rows:
            continue
        k = np.stack([t.column(x).to_numpy() for x in keys])
        edge = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [t.num_rows]])
        if passed and (k[:, 0] == long_key).all():
            yield t.slice(0, ends[0]), None, passed
            passed += int(ends[0])
            starts, ends = starts[1:], ends[1:]
            if not len(starts):
                rest = None
                continue
        passed, rest = 0, None
        if batch is not None:  # the last run may go on
            tail, starts, ends = t.slice(starts[-1]), starts[:-1], ends[:-1]
            if tail.num_rows > most:
                yield tail, None, 0
                long_key, passed = k[:, -1], tail.num_rows
            else:
                rest = tail
        long = np.flatnonzero(ends - starts > most)
        for r in long:
            yield t.slice(starts[r], ends[r] - starts[r]), None, 0
        for group in np.split(np.arange(len(starts)), long):
            group = group[ends[group] - starts[group] <= most] if len(group) else group
            if len(group):
                yield t.slice(starts[group[0]], ends[group[-1]] - starts[group[0]]), starts[group] - starts[group[0]], None
