"""Token ids as Parquet list columns, written for selective reads.

A file holds the columns doc_id, n_tokens, shard, at and tokens (array<int>): rows ascend by doc_id within and across
shards; ids are dictionary-encoded (the vocabulary fits a dictionary page), the other integers delta-encoded (format
version 2). Small row groups and pages with column and offset indexes let a reader of a few documents, or of the
metadata columns, skip the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import join_counted
from .common import binary_values, map_arrow, materialize, pieces
from .tokens import END, text_ids, word_ids

SCHEMA = "doc_id long, n_tokens long, shard int, at long, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END, row_group: int = 32 << 20, page: int = 256 << 10) -> None:
    """Encode whole texts and write them in ascending id order; null text counts as empty, null ids come first.

    Repeated rows are written again; no rows give no tokens; a text may be of any length, as a row group holds one row
    at least. Ids are cast to bigint: one that is no number raises. The texts, not the token ids, are range-partitioned:
    they are the smaller.
    """

    def encode(batches):
        words, shard, total = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = text_ids(binary_values(part.column("text")), words, end)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                offsets = pa.array(np.append([0], ends).astype(np.int32))
                tokens = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(np.full(len(n), shard, np.int32)), pa.array(total + ends - n), tokens], ["doc_id", "n_tokens", "shard", "at", "tokens"])
                total += int(ends[-1])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id")
    options = {"compression": "zstd", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "shard", "at")}, "parquet.writer.version": "v2", "parquet.page.row.count.limit": 20_000}
    map_arrow(ordered, encode, SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with ``start``: the ids of all documents before. Only columns that are used are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))  # one row a shard
    return join_counted(rows, materialize(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "tokens")


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of each document's ids as little-endian unsigned 32-bit."""

    def digest(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            ends = tokens.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
