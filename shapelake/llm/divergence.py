"""Source divergence audit: how far the terms of each source lie from those of its language and of its other sources.

Terms are counted by length-bucketed packing. A slice of whole texts is ordered by language and source; its terms of up
to 8 bytes are one uint64 word each, those of up to 16 bytes two, which a radix sort brings together and whose runs are
counted; longer terms go to buckets of the widths 32, 64, ... and are sorted there by bytes. Spark adds up the slices'
runs, map-side first, so that neither a common term nor a large source is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_counted
from .common import map_arrow, materialize, pieces, ship
from .terms import LETTERS, SHORT, Terms, radix_order

#: Parts in a billion: the unit of a share.
UNIT = 1_000_000_000


def _runs(order: np.ndarray, columns: list[np.ndarray], group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a run's first term, terms, rows) of the runs of equal columns and group in ``order``, in which terms
    that are equal lie in the order of their rows, and rows in the order of their groups."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in (*columns, group):
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    r = row[order]
    first = np.flatnonzero(new)
    new[1:] |= r[1:] != r[:-1]
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(new.astype(np.int64), first) if len(first) else first


def counted(terms: Terms, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a term of each different (group, term), its occurrences there, rows with it); ``group`` is by row, ascending."""
    found = []
    of = group[terms.row]
    for least, most in ((1, 8), (9, SHORT)):
        which = np.flatnonzero((terms.length >= least) & (terms.length <= most))
        words = [terms.word(which)] + ([terms.word(which, 8)] if most > 8 else [])
        first, n, rows = _runs(radix_order(words), words, of[which], terms.row[which])
        found.append((which[first], n, rows))
    width = SHORT
    while width < len(terms.data) and (terms.length > width).any():
        least, width = width, 2 * width
        bucket = np.flatnonzero((terms.length > least) & (terms.length <= width))
        if len(bucket):
            cells = np.lib.stride_tricks.sliding_window_view(terms.data, width)[terms.start[bucket]]
            cells[np.arange(width) >= terms.length[bucket][:, None]] = 0
            text = cells.view(f"S{width}").ravel()
            first, n, rows = _runs(np.argsort(text, kind="stable"), [text], of[bucket], terms.row[bucket])
            found.append((bucket[first], n, rows))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _count_batches(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            names = [piece.column(c).dictionary_encode() for c in ("lang", "source")]
            lang, source = (c.indices.to_numpy() for c in names)
            group = lang.astype(np.int64) * len(names[1].dictionary) + source
            order = np.argsort(group, kind="stable")
            terms = Terms(piece.column("text").take(pa.array(order)), LETTERS)
            which, n, rows = counted(terms, group[order])
            row = order[terms.row[which]]
            head = [d.dictionary.take(pa.array(c[row])) for d, c in zip(names, (lang, source), strict=True)]
            yield pa.RecordBatch.from_arrays([*head, terms.strings(which), pa.array(n), pa.array(rows)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and rows that hold it. Nulls count as ''.

    Each row is a document of its own, repeated or not. A slice holds about 8 MB of texts, one text at least.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    runs = map_arrow(rows, _count_batches, "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, term, n, n_lang, first): terms in at least ``least`` documents of their language, with their
    occurrences in the source and the language; ``first`` marks one row of each (lang, term)."""
    of = Window.partitionBy("lang", "term")
    more = {"in_docs": F.sum("docs").over(of), "n_lang": F.sum("n").over(of), "first": F.row_number().over(of.orderBy("source")) == 1}
    return counts.withColumns(more).filter(F.col("in_docs") >= least).select("lang", "source", "term", "n", "n_lang", "first")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), in decimals, as the product may pass 64 bits."""
    return (F.expr(f"(cast({UNIT} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))") + 1).cast("long")


def _pair_sums(cell: pa.Table) -> pa.Table:
    """Sums over a cell's terms of floor((p - q)^2 / q) for each two sources of a language; rows without term give
    the shares of terms that a source doesn't have."""
    idx, p = cell.column("idx").to_numpy(), cell.column("p").to_numpy()
    code = cell.column("term").combine_chunks().dictionary_encode().indices
    base = code.is_null().to_numpy(zero_copy_only=False)
    n = int(base.sum())
    none = np.zeros(n, np.int64)
    none[idx[base]] = p[base]
    code, idx, p = code.filter(pa.array(~base)).to_numpy(), idx[~base], p[~base]
    order = np.argsort(code, kind="stable")
    code, idx, p = code[order], idx[order], p[order]
    sums = np.zeros((n, n), np.int64)
    terms, step = (int(code[-1]) + 1 if len(code) else 0), max(1, (1 << 20) // max(1, n))
    for a in range(0, terms, step):
        b = min(a + step, terms)
        lo, hi = np.searchsorted(code, [a, b])
        at = np.repeat(none[:, None], b - a, axis=1)
        at[idx[lo:hi], code[lo:hi] - a] = p[lo:hi]
        for i in range(n):
            gap = at[i] - at
            sums[i] += (gap * gap // at).sum(axis=1)
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table({"lang": pa.array([cell.column("lang")[0].as_py()] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": sums[i, j]})


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200, cell: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source apart within its language.

    A term counts if ``least`` documents of its language hold it. p of a term in a source, and q in the language or in
    another source, are shares in billionths with one added to each count, and f = floor((p - q)^2 / q). Part ``pair``
    has a row for each other source of the language, valued by the sum of f over all terms; part ``term`` the ``top``
    terms that the source has more of than its language, by f. Equal values rank by item in the order of UTF-8 bytes.

    Nulls in any of the three columns count as '', so an empty text's group is there, without terms; a group alone in
    its language has no pairs; no rows give no rows. Each row is a document, repeated or not. Other columns aren't read.

    The sums over pairs are taken in cells of about ``cell`` rows of (source, term), each some of a language's terms
    against all its sources; a cell's matrix is cut into parts of 2^20 numbers. Groups' names, totals and numbers are
    broadcast if there are at most 2^20.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = materialize(kept_terms(term_counts(docs, text, lang, source), least))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    of = Window.partitionBy("lang")
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("total").over(of), F.lit(0)).alias("total_lang"), F.coalesce(F.sum("terms").over(of), F.lit(0)).alias("terms"), (F.coalesce(F.sum("rows").over(of), F.lit(0)) / cell + 1).cast("int").alias("cells"), (F.row_number().over(of.orderBy("source")) - 1).cast("int").alias("idx"))
    groups = materialize(groups)
    met = join_counted(kept, groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    own = met.withColumn("q", share("n_lang", "total_lang", "terms")).filter(F.col("p") > F.col("q"))
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    dealt = met.select("lang", F.pmod(F.xxhash64("term"), "cells").cast("int").alias("cell"), "term", "idx", "p")
    empty = F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(1))
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(None).cast("string").alias("term"), "idx", empty.alias("p"))
    sums = dealt.unionByName(marks).groupBy("lang", "cell").applyInArrow(_pair_sums, "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda at, to: groups.select("lang", F.col("idx").alias(at), F.col("source").alias(to))
    pairs = join_counted(join_counted(sums, name("i", "source"), ["lang", "i"]), name("j", "item"), ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(own)
