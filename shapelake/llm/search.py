"""Ranked lexical search: every document scored for every item of a query table, the best kept, exactly.

Hybrid of term- and document-at-a-time evaluation. The items' terms that few documents hold have short lists: these are
added up term by term into accumulators (item, document, sum so far). The accumulators then stand as one list with known
bounds beside the long lists, and both are walked document by document, in blocks: a block's documents are looked
up in a long list only while the bounds of what is left could still lift them to the item's least best score.

Spark tokenizes the documents once into a table of the query terms' occurrences, counts what the weights need, and gives
its partitions to tasks; each keeps ``top`` documents an item, and a window keeps the best of those. A first pass over
the accumulators alone gives every task a score that the item's best are known to reach.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pieces
from .terms import ALPHANUMERIC, Terms, Vocabulary, radix_order

#: Documents a block, and (item, document) sums made at a time.
BLOCK, MOST = 8192, 1 << 21


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _occurrences(vocabulary):
    """Batches of (id, text) -> (id, n, terms, tfs): a text's number of terms, and which of the vocabulary's it has how often."""

    def step(batches):
        known = vocabulary.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                terms, rows = Terms(piece.column("text"), ALPHANUMERIC), piece.num_rows
                n = np.bincount(terms.row, minlength=rows)
                number = known.numbers(terms)
                hit = number >= 0
                key, tf = np.unique((terms.row[hit] << 32) | number[hit], return_counts=True)
                sizes = np.bincount(key >> 32, minlength=rows)
                out = [piece.column("id"), pa.array(n, pa.int64()), _lists(key & 0xFFFFFFFF, sizes, pa.int32()), _lists(tf, sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return step


class Queries:
    """The items' terms as numbers: entries sorted by item, each with a term, a weight (times its repeats in the item),
    and whether its list is short: an item's shortest lists are, as long as they hold ``share`` documents together."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray, items: int, terms: int, share: int):
        order = np.lexsort((df, item))
        self.item, self.term, self.weight = item[order], term[order], weight[order]
        self.items, self.terms = items, terms
        self.at = np.searchsorted(self.item, np.arange(items + 1))
        total = np.concatenate([[0], np.cumsum(df[order])])
        self.short = total[1:] - total[self.at[self.item]] <= share


class Block:
    """Up to BLOCK documents as lists by term, each in the order of the documents, with the worth of every occurrence."""

    def __init__(self, batch: pa.RecordBatch, terms: int):
        self.id, self.documents = batch.column("id"), batch.num_rows
        lists, tfs = batch.column("terms"), batch.column("tfs")
        ends = lists.offsets.to_numpy()
        doc = np.repeat(np.arange(self.documents), np.diff(ends))
        term, tf = lists.values.to_numpy()[ends[0] : ends[-1]], tfs.values.to_numpy()[ends[0] : ends[-1]]
        worth = (1_000_000_000 * tf) // (1000 * tf + 12 * batch.column("m").to_numpy()[doc])
        order = radix_order([term.astype(np.uint64)])
        self.doc, self.worth = doc[order], worth[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        self.size = np.diff(self.at)
        self.best = np.zeros(terms, np.int64)
        some = self.size > 0
        if some.any():
            self.best[some] = np.maximum.reduceat(self.worth, self.at[:-1][some])

    def accumulated(self, q: Queries):
        """(items from, up to, item, doc, sum) of the short lists, sorted by item and document, some items at a time."""
        entry = np.flatnonzero(q.short)
        held = np.bincount(q.item[entry], self.size[q.term[entry]], q.items).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(held)])
        a = 0
        while a < q.items:
            b = max(a + 1, int(np.searchsorted(total, total[a] + MOST, side="right")) - 1)
            e = entry[np.searchsorted(q.item[entry], a) : np.searchsorted(q.item[entry], b)]
            size = self.size[q.term[e]]
            place = np.arange(size.sum()) + np.repeat(self.at[q.term[e]] - np.cumsum(size) + size, size)
            key = np.repeat(q.item[e], size) * BLOCK + self.doc[place]
            order = radix_order([key.astype(np.uint64)])
            key, score = key[order], (np.repeat(q.weight[e], size) * self.worth[place])[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            yield a, b, key[first] // BLOCK, key[first] % BLOCK, np.add.reduceat(score, first) if len(first) else score
            a = b

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.at[term] : self.at[term + 1]], self.worth[self.at[term] : self.at[term + 1]]


class Best:
    """The ``top`` best (score, document) of each item, ties to the smaller id, and the least score that still counts."""

    def __init__(self, items: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()
        self.score, self.id = ([np.zeros(0, np.int64)] * items for _ in range(2))

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[item], score]), np.concatenate([self.id[item], ids])
        keep = np.lexsort((ids, -score))[: self.top]
        self.score[item], self.id[item] = score[keep], ids[keep]
        if len(keep) == self.top:
            self.least[item] = max(self.least[item], score[keep[-1]])

    def rows(self, batch: int = 1 << 16):
        sizes = np.array([len(x) for x in self.score])
        items = np.repeat(np.arange(len(sizes)), sizes)
        score, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.score, self.id))
        for a in range(0, len(items), batch):
            s = slice(a, a + batch)
            yield pa.RecordBatch.from_arrays([pa.array(items[s], pa.int32()), pa.array(ids[s]), pa.array(score[s])], ["item", "id", "score"])


#: Stands for a null id, which comes after all others.
_LAST = np.iinfo(np.int64).max


def search_block(block: Block, ids: np.ndarray, q: Queries, best: Best) -> None:
    """Add a block's documents that may be among an item's best."""
    bound = np.where(q.short, 0, q.weight * block.best[q.term])  # what a long list can add
    reach = np.bincount(q.item, bound, q.items).astype(np.int64)  # sums below 2^53
    for a, b, item, doc, score in block.accumulated(q):
        hopeful = score + reach[item] >= best.least[item]
        item, doc, score = item[hopeful], doc[hopeful], score[hopeful]
        ends = np.searchsorted(item, np.arange(a, b + 1))
        for i in np.flatnonzero((np.diff(ends) > 0) | ((reach[a:b] >= best.least[a:b]) & (reach[a:b] > 0))):
            s = slice(ends[i], ends[i + 1])
            _search_item(block, ids, q, best, a + i, doc[s], score[s], bound)


def _search_item(block, ids, q, best, i, doc, score, bound) -> None:
    entries = np.arange(q.at[i], q.at[i + 1])
    entries = entries[bound[entries] > 0]
    entries = entries[np.argsort(bound[entries], kind="stable")]
    left = np.concatenate([[0], np.cumsum(bound[entries])])  # what the first k lists can add together
    least = max(best.least[i], 1)
    must = int(np.searchsorted(left, least)) - 1  # a document in none of the lists from here on can't be among the best
    if must < len(entries):
        seen = np.zeros(block.documents, bool)
        seen[doc] = True
        for e in entries[must:]:
            seen[block.list_of(q.term[e])[0]] = True
        every = np.flatnonzero(seen)
        sums = np.zeros(len(every), np.int64)
        sums[np.searchsorted(every, doc)] = score
        doc, score = every, sums
    for k in range(len(entries) - 1, -1, -1):
        hopeful = score + left[k + 1] >= least
        doc, score = doc[hopeful], score[hopeful]
        if not len(doc):
            return
        there, worth = block.list_of(q.term[entries[k]])
        at = np.minimum(np.searchsorted(there, doc), len(there) - 1)
        score = score + np.where(there[at] == doc, q.weight[entries[k]] * worth[at], 0)
    hit = score >= least
    if hit.any():
        best.add(i, score[hit], ids[doc[hit]])


def _blocks(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            yield batch.slice(a, BLOCK)


def _first_pass(shared, top: int):
    """The best sums of short lists alone."""

    def step(batches):
        q = shared.value
        best = Best(q.items, top, np.ones(q.items, np.int64))
        for rows in _blocks(batches):
            block = Block(rows, q.terms)
            for a, b, item, doc, score in block.accumulated(q):
                hit = score >= best.least[item]
                item, doc, score = item[hit], doc[hit], score[hit]
                ends = np.searchsorted(item, np.arange(a, b + 1))
                for i in np.flatnonzero(np.diff(ends)):
                    best.add(a + i, score[ends[i] : ends[i + 1]], doc[ends[i] : ends[i + 1]])
        yield from best.rows()

    return step


def _second_pass(shared, least, top: int):
    def step(batches):
        q = shared.value
        best = Best(q.items, top, least.value)
        for rows in _blocks(batches):
            block = Block(rows, q.terms)
            ids = block.id.fill_null(_LAST).to_numpy()
            search_block(block, ids, q, best)
        yield from best.rows()

    return step


_FOUND = "item int, id long, score long"


def _search(docs: DataFrame, entries: list, top: int, share: float) -> DataFrame:
    """(item: place in the sorted items of entries, id, score, rank) for entries (item, term, repeats) of a part of the items."""
    context = docs.sparkSession.sparkContext
    words = sorted({bytes(e["term"]) for e in entries})
    number, names = {w: i for i, w in enumerate(words)}, {}
    for e in entries:
        names.setdefault(e["item"], len(names))
    table = materialize(map_arrow(docs, _occurrences(context.broadcast(Vocabulary(words))), "id long, n long, terms array<int>, tfs array<long>"))
    documents, total = table.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary's size
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    item, term, repeats = (np.array(x, np.int64) for x in zip(*((names[e["item"]], number[bytes(e["term"])], e["repeats"]) for e in entries), strict=True))
    q = Queries(item, term, weight[term] * repeats, df[term], len(names), len(words), int(share * df.sum()) // len(names))
    shared = context.broadcast(q)
    m = F.expr(f"75 + (cast(25 as decimal(2, 0)) * cast(n as decimal(18, 0)) * cast({documents} as decimal(18, 0))) div cast({max(total or 0, 1)} as decimal(20, 0))").cast("long")
    table = table.select("id", "terms", "tfs", m.alias("m"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    first = map_arrow(table, _first_pass(shared, top), _FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    least = np.ones(len(names), np.int64)
    for r in first.filter(F.col("rank") == top).collect():  # a row an item at most
        least[r["item"]] = max(1, r["score"])
    found = map_arrow(table, _second_pass(shared, context.broadcast(least), top), _FOUND)
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    name = list(names)
    named = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(name)], f"item int, name {_kind(name)}")
    return best.join(F.broadcast(named), "item").select("name", "rank", F.when(F.col("id") != _LAST, F.col("id")).alias("id"), "score")


def _kind(names: list) -> str:
    return "string" if any(isinstance(x, str) for x in names) else "long"


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", share: float = 0.25, most: int = 1 << 20) -> DataFrame:
    """(item, rank, key, score): each item's ``top`` documents of highest score above 0, ties to the smaller key.

    Every row of docs is a document, repeated or not; keys are cast to bigint, null keys come last among equals. A null or
    empty text has no terms, is no document to the counts and is never found. Rows of items with the same id, null too,
    are one item; an item without terms, or none that a document has, gives no rows, and so do empty tables. Other
    columns of either table aren't read. Texts count whole, in slices of about 8 MB, one text at least.

    An item's lists are short as long as together they hold ``share`` of the documents' occurrences of query terms over
    the number of items, so that all accumulators hold no more than that share of the occurrences; it changes
    the work, not the result. The items' terms are collected and broadcast, ``most`` (item, term) at a time: with more of
    them, the items are dealt by hash to parts, for each of which the documents are read again.
    """
    kind = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.coalesce(F.col(query).cast("string"), F.lit("")).alias("text"), F.lit(0).alias("at"))
    asked = asked.withColumn("item", F.col("item").cast("string" if kind == "string" else "long"))
    asked = materialize(map_arrow(asked, _item_terms, f"item {'string' if kind == 'string' else 'long'}, term binary, repeats long").groupBy("item", "term").agg(F.sum("repeats").alias("repeats")))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    parts = max(1, -(-asked.count() // most))
    out = None
    for part in range(parts):
        entries = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "term").collect()
        if entries:
            found = _search(rows, entries, top, share)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "name long, rank int, id long, score long")
    return out.select(F.col("name").cast(kind).alias(item), "rank", F.col("id").alias(key), "score")


def _item_terms(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            terms = Terms(piece.column("text"), ALPHANUMERIC)
            one = [(r, terms.bytes_of(i)) for i, r in enumerate(terms.row)]
            yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array([r for r, _ in one], pa.int64())), pa.array([w for _, w in one], pa.binary()), pa.array([1] * len(one), pa.int64())], ["item", "term", "repeats"])
