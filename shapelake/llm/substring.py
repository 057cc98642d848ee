"""Repeated passages: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

Each window's anchor, the least hash of the short word sequences in it, depends on its words alone, so equal windows have
equal anchors. Neighbouring windows mostly share theirs: they form a run, about one for twenty windows. Three steps, none
of which loses a repeat:

1. Anchors are counted. Windows whose anchor is in one document only occur once.
2. Whole runs are counted by the Rabin-Karp hash of their words. All windows of a run that a document with a smaller id
   has too are repeated. That settles copies and the inside of shared passages.
3. What is left, the first holders of each different run of an anchor, is dealt out window by window. A window's first
   document is among them, as it is the first holder of some run. A window's key is a 96-bit Rabin-Karp hash (64 bits
   and 32 bits with another base).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import join_skewed
from .common import binary_values, discard, map_arrow, materialize, pieces

#: Odd multipliers: they have an inverse modulo 2^64, so that prefix sums give every window's hash.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum of x[start + j] * base^-j modulo 2^64 over the span, for every span [start, end)."""
    power = np.full(len(x), pow(base, -1, 1 << 64), np.uint64)
    power[:1] = 1
    scale = np.full(len(x), base, np.uint64)
    scale[:1] = 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.multiply.accumulate(power), dtype=np.uint64)])
        return (total[ends] - total[starts]) * np.multiply.accumulate(scale)[starts]


def window_hashes(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of the ``width`` words from every place on."""
    starts = np.arange(len(x) - width + 1)
    return span_hashes(x, starts, starts + width, base)


def window_anchors(x: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For every window of ``width`` words, the least mixed hash of the ``gram``-word sequences in it."""
    g = window_hashes(x, gram, BASES[0])
    with np.errstate(over="ignore"):
        g ^= g >> np.uint64(32)
        g *= np.uint64(BASES[1])
        g ^= g >> np.uint64(29)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        g = np.minimum(g[:-reach], g[reach:])
        reach *= 2
    return np.minimum(g[: len(g) - (span - reach)], g[span - reach :]) if span > reach else g


def window_runs(x: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the words, first window, number of windows) of the runs of windows with equal anchors."""
    a = window_anchors(x, width, gram)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    n = np.diff(np.append(starts, len(a)))
    return a[starts], span_hashes(x, starts, starts + n + (width - 1), BASES[0]), starts, n


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """(id, mark, at, n): n windows from ``at`` on whose words also start in a document with a smaller id.

    ``mark`` is a hash of the text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def runs(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows, count = [], []
                for text in binary_values(part.column("text")):
                    words = text.split()
                    if len(words) >= width:
                        rows.append(window_runs(word_hashes(words), width, gram))
                    count.append(len(rows[-1][0]) if len(words) >= width else 0)
                if rows:
                    ids, marks = (pa.array(np.repeat(part.column(k).to_numpy(), count)) for k in ("id", "mark"))
                    anchor, h, at, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([ids, marks, pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "mark", "anchor", "h", "at", "n"])

    def windows(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                rows = []
                for text, wanted in zip(binary_values(part.column("text")), part.column("wanted"), strict=True):
                    x = word_hashes(text.split())
                    first, n = (wanted.values.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
                    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    rows.append((at, span_hashes(x, at, at + width, BASES[0]), span_hashes(x, at, at + width, BASES[1]) >> np.uint64(32)))
                count = [len(r[0]) for r in rows]
                ids, marks = (np.repeat(part.column(k).to_numpy(), count) for k in ("id", "mark"))
                at, h, h2 = (np.concatenate([r[i] for r in rows]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32))], ["id", "mark", "at", "h", "h2"])

    found = materialize(map_arrow(source, runs, "id long, mark long, anchor long, h long, at int, n int"))
    often = materialize(found.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("rows")).filter("a < b").select("anchor", "rows"))
    shared = materialize(join_skewed(found, often, ["anchor"]))
    discard(found)
    holders = materialize(shared.groupBy("anchor", "h", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    differ = holders.groupBy("anchor").agg((F.min("first") < F.max("first")).alias("differ"))
    known = materialize(holders.join(differ, "anchor"))
    judged = materialize(join_skewed(shared, known, ["anchor", "h", "n"]).filter("id > first or differ").select("id", "mark", "at", "n", (F.col("id") > F.col("first")).alias("settled")))
    discard(shared)
    discard(holders)
    wanted = judged.filter("not settled").groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("wanted"))  # of one text
    dealt = materialize(map_arrow(source.join(wanted, ["id", "mark"]), windows, "id long, mark long, at int, h long, h2 int"))
    first = materialize(dealt.groupBy("h", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows")).filter("first < last").select("h", "h2", "first", "rows"))
    single = materialize(join_skewed(dealt, first, ["h", "h2"]).filter("id > first").select("id", "mark", "at", F.lit(1).alias("n")))
    discard(dealt)
    return judged.filter("settled").drop("settled").unionByName(single)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 8) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text, spans (removed [start, end) word intervals, maximal).

    A word (between ASCII blanks, unchanged) goes if a window of ``width`` words that covers it also starts in a document
    with a smaller id, judged on the input. A null text has no words. Rows with a null id lose nothing and aren't
    earlier than any. Rows that share an id don't repeat each other. Repeated rows stay repeated; no rows give none.
    """
    cut = repeated_windows(docs, id_col, text_col, width, gram)
    cuts = cut.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("at", "n")).alias("at"))  # of one text
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    joined = source.join(cuts, (F.col("id").cast("long") == F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select("id", "text", "at")

    def remove(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_text", "spans")}
                for text, at in zip(binary_values(part.column("text")), part.column("at"), strict=True):
                    words, spans = text.split(), []
                    kept = words
                    if at.is_valid:
                        step = np.zeros(len(words) + 1, np.int64)
                        starts, n = (at.values.field(k).to_numpy() for k in ("at", "n"))
                        np.add.at(step, starts, 1)
                        np.add.at(step, starts + n + (width - 1), -1)
                        gone = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
                        turn = np.flatnonzero(np.diff(gone)).tolist()
                        spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                        kept, last = [], 0
                        for s in spans:
                            kept += words[last : s["start"]]
                            last = s["end"]
                        kept += words[last:]
                    for k, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode(), spans), strict=True):
                        out[k].append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([part.column("id")] + [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], ["id", *out])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(joined, remove, f"id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)
