"""Concatenate and cut: all documents' ids end to end, cut into windows of a fixed number of tokens.

Pass one encodes each document where it is read and writes it with its offset within its chunk, a stretch of rows
that one task reads in order. The chunks' token totals, one row a chunk, give each chunk's global offset by a prefix
sum. Pass two reads the ids back, adds the offsets and cuts. Ids are never shuffled; only a sequence that two chunks
share is put together from boundary records.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_counted
from .common import binary_values, map_arrow, materialize, pieces
from .tokens import END, text_ids, word_ids

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, end: int) -> DataFrame:
    """(chunk, first, at, doc_id, ids): a chunk is a read split, or what is left of a task once a split comes back; ``at`` counts its ids before the document; ``first`` orders chunks."""

    def encode(batches):
        words, task, chunk, total, before = word_ids(vocabulary), TaskContext.get().partitionId(), -1, 0, (None, None)
        seen, dealt = set(), False  # dealt: a split's rows came back, so the rows were sorted or shuffled since they were read
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = text_ids(binary_values(part.column("text")), words, end)
                splits = list(zip(part.column("file").to_pylist(), part.column("block").to_pylist(), strict=True))
                chunks, at, firsts = [], [], []
                for split, row, x in zip(splits, part.column("row").to_pylist(), ids, strict=True):
                    if split != before:
                        dealt = dealt or split in seen
                        seen.add(split)
                    if chunk < 0 or split != before and not dealt:
                        chunk, total, first = chunk + 1, 0, row or 0
                    before = split
                    chunks.append(task << 32 | chunk)
                    firsts.append(first)
                    at.append(total)
                    total += len(x) // 4
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), part.column("file"), pa.array(firsts, pa.int64()), pa.array(at, pa.int64()), part.column("id"), pa.array(ids, pa.binary())], ["chunk", "file", "first", "at", "doc_id", "ids"])

    place = {"file": "file_path", "block": "file_block_start", "row": "row_index"}
    where = [(F.col(f"_metadata.{v}") if "_metadata" in _hidden(docs) else F.lit(None)).cast("string" if k == "file" else "long").alias(k) for k, v in place.items()]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *where)
    return map_arrow(source, encode, "chunk long, file string, first long, at long, doc_id long, ids binary")


def _hidden(docs: DataFrame) -> set[str]:
    """'_metadata' if the rows come straight from Parquet files, whose order is then kept."""
    try:
        docs.select("_metadata.row_index")
        return {"_metadata"} - set(docs.columns)
    except Exception as e:  # the analyzer's answer is the only public way to tell
        if type(e).__name__ != "AnalysisException":
            raise
        return set()


def pack_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    Columns: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, boundary
    (its sequence takes in rows of another chunk), and ids (little-endian unsigned 32-bit) if ``with_ids``. Every id
    lies in one piece and every sequence but the last is full, so padding is under ``size`` tokens in all; the last is
    padded to the next power of two. Rows read straight from Parquet keep the order of their files and rows; no order is promised of others. Ids are cast to bigint. Texts are taken whole,
    however long. A null
    text counts as empty: one end id. Repeated rows are packed again; a null id stays null; no rows give no pieces.
    """
    encoded = materialize(_encoded(docs, id_col, text_col, vocabulary, end))
    totals = encoded.groupBy("chunk").agg(F.min("file").alias("file"), F.min("first").alias("first"), F.max(F.col("at") + F.octet_length("ids") / 4).cast("long").alias("total"))
    order = Window.orderBy("file", "first", "chunk")  # one row a chunk: the number of read splits, not of documents
    bases = totals.select("chunk", "total", (F.sum("total").over(order) - F.col("total")).alias("base"))

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "ids"):
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary", "ids")}
                col = [part.column(k).to_pylist() for k in ("doc_id", "base", "at", "total", "ids")]
                for doc, base, at, total, ids in zip(*col, strict=True):
                    n, done = len(ids) // 4, 0
                    while done < n:
                        seq, offset = divmod(base + at + done, size)
                        take = min(n - done, size - offset)
                        x = ids[4 * done : 4 * (done + take)]
                        edge = seq * size < base or (seq + 1) * size > base + total
                        for k, v in zip(out, (doc, done, take, zlib.crc32(x), n, seq, offset, edge, x if with_ids else None), strict=True):
                            out[k].append(v)
                        done += take
                kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    cuts = map_arrow(join_counted(encoded, materialize(bases), "chunk").select("doc_id", "base", "at", "total", "ids"), cut, PIECE)
    return cuts if with_ids else cuts.drop("ids")


def packed_sequences(pieces_with_ids: DataFrame, size: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array<bigint>): the sequences, from ``pack_pieces(with_ids=True)``.

    A sequence has at most ``size`` ids, so a group is bounded; a short last one is padded to the next power of two.
    """

    def join(batches):
        for batch in batches:
            ids = []
            for x in batch.column("parts").to_pylist():
                x = np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int64)
                width = size if len(x) == size else 1 << max(0, len(x) - 1).bit_length()
                ids.append(np.append(x, np.full(min(size, width) - len(x), pad, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    parts = pieces_with_ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return map_arrow(parts, join, "sequence_id long, ids array<long>")
