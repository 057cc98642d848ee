"""Fuzzy line dedup: a prefix filter that misses no alike pair, word edit similarity, one occurrence per group.

Lines are dealt by hash, never by text. Equal normalised lines meet as one row. Lines within k edits of each other, of
which the longer has n words, share n - k words, so in any one order of all words the first k + 1 words of each have
one in common. Each distinct line is dealt out by these words, rarest first. Lines that meet and that neither their
lengths nor their words' parities (``may_be_alike``) tell apart are loosely linked; only lines of such groups have
their text fetched, and within a loose group the lines that are alike by edit distance are joined. Lines already joined
need no further comparison, so a large group of copies costs about one comparison a line. Loose groups and buckets over
``most`` lines are cut into chunks, and each pair of chunks is a cell of its own.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_sort
from .common import binary_values, connected_components, discard, map_arrow, materialize, pieces, runs, stars
from .hashed import folded_words, mixed, powers, text_bytes
from .substring import BASES


def normalised(line: bytes) -> list[bytes]:
    """Words of a line with A-Z lower-cased."""
    return line.lower().split()


def edit_similarity(a: list, b: list, least: float) -> float:
    """1 - word edit distance / longer length; 0 as soon as the lengths rule ``least`` out. Bit-parallel by columns."""
    if len(a) > len(b):
        a, b = b, a
    longer = len(b)
    if not longer:
        return 1.0
    if len(a) < least * longer:
        return 0.0
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < len(a) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a:
        return 1 - len(b) / longer
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for w in b:
        match = where.get(w, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        plus, minus = ((down << 1) | (full & ~(diagonal | up))) & full, up & diagonal
    return 1 - distance / longer


def alike(x: np.ndarray, begin: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, most: int = 1 << 20) -> np.ndarray:
    """Whether ``edit_similarity`` of rows i and j is ``similarity`` or more, for many pairs at once: row r is n[r] words (their
    hashes) from x[begin[r]] on. Most alike pairs differ by changed words and one gap: if the fewest edits of that kind are few
    enough, so are the fewest of all. The others are compared one by one."""
    a, b = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    out = n[a] >= similarity * n[b]
    pairs = np.flatnonzero(out & (n[a] > 0))
    ends = np.cumsum(n[a[pairs]])
    at = 0
    while at < len(pairs):  # about ``most`` words at a time
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        some = pairs[at:stop]
        at = stop
        short, longer = n[a[some]], n[b[some]]
        first = np.cumsum(short) - short
        place = np.arange(int(short.sum())) - np.repeat(first, short)
        own, other = x[np.repeat(begin[a[some]], short) + place], np.repeat(begin[b[some]], short) + place
        right = own != x[other + np.repeat(longer - short, short)]
        after = np.cumsum((own != x[other]).astype(np.int64) - right)  # edits more, if the gap comes after a word than before all
        before = np.where(first > 0, after[first - 1], 0)
        fewest = longer - short + np.add.reduceat(right.astype(np.int64), first) + np.minimum(np.minimum.reduceat(after, first) - before, 0)
        for p in np.flatnonzero(1 - fewest / longer < similarity).tolist():
            u, v = begin[a[some[p]]], begin[b[some[p]]]
            out[some[p]] = edit_similarity(x[u : u + short[p]].tolist(), x[v : v + longer[p]].tolist(), similarity) >= similarity
    return out


#: Up to so many words a line has 64, 128, 256, ... parities; longer lines have twice the last.
PARITIES = (32, 80, 180, 400)


def edits(n, similarity: float):
    """Most word edits between alike lines of which the longer has n words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def numbered(x: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each word and how many of its like come before it in its line, for words sorted by line and x: a line's
    repeats are different then, and an edit takes one away or adds one or both."""
    at = np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (line[1:] != line[:-1])
    with np.errstate(over="ignore"):
        return mixed(x * np.uint64(BASES[0]) + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * np.uint64(BASES[1]))


def parities(x: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit parts, number of parts of each line): for each line of n words, which begin at ``starts``, the parities of
    its words, as ``numbered`` tells them apart, by their hashes' last bits; an edit changes two at most."""
    level = np.searchsorted(PARITIES, n)
    size = 1 << level
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        count = n[at]
        begin = np.cumsum(count) - count
        y = x[np.repeat(starts[at] - begin, count) + np.arange(int(count.sum()))]
        bit = np.uint64(1) << (y & np.uint64(63))
        part = (y >> np.uint64(6)) & np.uint64((1 << k) - 1)
        for c in range(1 << k):
            out[ends[at] - size[at] + c] = np.bitwise_xor.reduceat(np.where(part == np.uint64(c), bit, np.uint64(0)) if k else bit, begin)
    return out, size


def may_be_alike(n: np.ndarray, bits: np.ndarray, begin: np.ndarray, similarity: float):
    """A test of rows i against rows j: False only where lengths or parities rule out that the lines are alike.

    ``bits`` holds the parities of all rows, those of a row from ``begin`` on.
    """
    level, most = np.searchsorted(PARITIES, n), edits(n, similarity)
    folded: list[np.ndarray] = []
    for k in range(int(level.max(initial=0)), -1, -1):
        own = np.zeros((len(n), 1 << k), np.uint64)
        at = np.flatnonzero(level == k)
        own[at] = bits[begin[at][:, None] + np.arange(1 << k)]
        folded.insert(0, own if not folded else own ^ folded[0][:, : 1 << k] ^ folded[0][:, 1 << k :])

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        allowed = 2 * np.maximum(most[i], most[j])
        ok = (np.bitwise_count(folded[0][:, 0][i] ^ folded[0][:, 0][j]) <= allowed) & (2 * np.abs(n[i] - n[j]) <= allowed)
        if len(folded) > 1:
            lower = np.minimum(level[i], level[j])
            for k in range(1, len(folded)):
                at = np.flatnonzero(ok & (lower >= k))
                if len(at):
                    ok[at] = np.bitwise_count(folded[k][i[at]] ^ folded[k][j[at]]).sum(axis=1, dtype=np.int32) <= allowed[at]
        return ok

    return test


#: Words are counted in slots by the upper bits of their hashes; a task hands on its counts so many slots a row.
SLOTS, SPAN = 1 << 20, 1 << 12


def common_words(docs: DataFrame, text_col: str, most: int = 1 << 16) -> np.ndarray:
    """The slots with the most words of all texts, rarest first. They only set an order: no word is left out."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = folded_words(*text_bytes(part.column("text")))[0]
                total += np.bincount((x >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        spans = total.reshape(-1, SPAN)
        at = np.flatnonzero(spans.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([spans[i].tobytes() for i in at], pa.binary())], ["span", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("span").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(counts, np.int64)
        for i, n in total.items():
            at = np.flatnonzero(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(i * SPAN + at), pa.array(n[at])], ["slot", "n"])

    spans = map_arrow(docs.select(F.col(text_col).alias("text")), count, "span long, counts binary")
    rows = map_arrow(spans.repartition("span"), add, "slot long, n long").orderBy(F.desc("n"), "slot").limit(most).collect()
    return np.array([r["slot"] for r in reversed(rows)], np.int64)


def word_order(common: np.ndarray):
    """A function of word hashes: 44 bits by which words are ordered, those of other slots first, then the common by rank."""
    rank = np.zeros(SLOTS, np.uint64)
    rank[common] = np.arange(1, len(common) + 1, dtype=np.uint64) << np.uint64(27)
    return lambda x: x >> np.uint64(37) | rank[(x >> np.uint64(44)).astype(np.int64)]


#: Keys are dealt out in so many passes, so that only a share of the rows is on disk at once; each has a field of its own.
PASSES = 2
KEYS = [f"_{turn}" for turn in range(PASSES)]


def line_signatures(x: np.ndarray, line: np.ndarray, n: np.ndarray, order, similarity: float):
    """(h, h2, keys, parities) of lines as Arrow arrays: two hashes of the words' sequence, and, for the prefix filter,
    the first words in the order of all words. ``x`` (hashes) and ``line`` go by word, ``n`` by line."""
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        place = np.arange(len(x)) - starts[line]
        h, h2 = (mixed(np.add.reduceat(y * powers(base, int(n.max()))[place], starts)) for y, base in zip((x, mixed(x)), BASES, strict=True))
        sorted_ = np.sort(line.astype(np.uint64) << np.uint64(44) | order(x))
        first = place <= edits(n, similarity)[line]
        first[1:] &= sorted_[1:] != sorted_[:-1]
        keys = ((sorted_[first] << np.uint64(20)) * np.uint64(BASES[0]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    of, parts = line[first], []
    for turn in range(PASSES):
        mine = keys % PASSES == turn
        ends = np.concatenate([[0], np.cumsum(np.bincount(of[mine], minlength=len(n)))])
        parts.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[mine])))
    bits, size = parities(numbered(sorted_ & np.uint64((1 << 44) - 1), line), starts, n)
    at = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
    bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(bits)])
    return pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.StructArray.from_arrays(parts, KEYS), bits


def copies_of_firsts(ids: pa.Array, marks: np.ndarray, line: np.ndarray, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For the first row by (id, line, mark) of those with equal hashes their number, 0 for the others. Ids of types whose order
    might not be Spark's make each row a first of its own."""
    if not (pa.types.is_integer(ids.type) or pa.types.is_string(ids.type)):
        return np.ones(len(h), np.int64)
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((marks, line, rank, h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    at = np.flatnonzero(new)
    out = np.zeros(len(h), np.int64)
    out[order[at]] = np.diff(np.append(at, len(h)))
    return out


def line_table(docs: DataFrame, min_words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, mark, line, h, h2, copies, n, keys, bits): two hashes, the number of words, the first words in the order of all words
    and the parities of each line of ``min_words`` words or more. Of alike lines by both hashes that a task reads together, the
    first has ``copies``, their number, and the others 0 and no n, keys and bits."""

    def lines(batches):
        order = word_order(common)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                data, ends = text_bytes(part.column("text"))
                x, begin = folded_words(data, ends)
                feeds = np.flatnonzero(data == 10)
                texts = np.searchsorted(ends, feeds, side="right") - 1
                row = np.sort(np.concatenate([np.arange(len(part)), texts]))  # of each line
                at = np.arange(len(row)) - np.searchsorted(row, row)
                line = np.searchsorted(feeds, begin) + np.searchsorted(ends, begin, side="right") - 1
                n = np.bincount(line, minlength=len(row))
                long = np.flatnonzero(n >= min_words)
                for a in range(0, len(long), 1 << 18):  # what fits the sort key's upper bits
                    some = long[a : a + (1 << 18)]
                    new = np.full(len(row), -1)
                    new[some] = np.arange(len(some))
                    mine = new[line]
                    h, h2, keys, bits = line_signatures(x[mine >= 0], mine[mine >= 0], n[some], order, similarity)
                    where = pa.array(row[some])
                    ids, marks = part.column("id").take(where), part.column("mark").take(where)
                    copies = copies_of_firsts(ids, marks.to_numpy(), at[some], h.to_numpy(), h2.to_numpy())
                    held = pa.array(np.arange(len(some)), mask=copies == 0)
                    columns = [ids, marks, pa.array(at[some].astype(np.int32)), h, h2, pa.array(copies), pa.array(n[some].astype(np.int32)).take(held), keys.take(held), bits.take(held)]
                    for b in range(0, len(some), 8192):
                        yield pa.RecordBatch.from_arrays([c.slice(b, 8192) for c in columns], ["id", "mark", "line", "h", "h2", "copies", "n", "keys", "bits"])

    keys_type = f"struct<{','.join(f'{k}:array<int>' for k in KEYS)}>"
    return map_arrow(docs, lines, f"id {docs.schema['id'].dataType.simpleString()}, mark long, line int, h long, h2 long, copies long, n int, keys {keys_type}, bits binary")


def lowest(root: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in components of two or more, and for each the row of its component with the least h."""
    moved = np.flatnonzero(root != np.arange(len(root)))
    rows = np.union1d(moved, root[moved])
    rows = rows[np.lexsort((h[rows], root[rows]))]
    new = np.flatnonzero(np.diff(root[rows], prepend=-1))
    return rows, np.repeat(rows[new], np.diff(np.append(new, len(rows))))


def components_of_stars(edges: DataFrame) -> DataFrame:
    """``connected_components`` of edges (a, b) that are mostly stars around their smallest node: a star that shares no node
    with another edge is a component as it is, only the others go through the rounds."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
    mixed_ = materialize(ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up = 1 and down > 0").select("node"))
    touched = now.join(by_sort(mixed_), F.col("u") == F.col("node"), "left_semi").select("v").union(mixed_).distinct()
    touched = materialize(touched)
    settled = now.join(by_sort(touched.withColumnRenamed("v", "node")), F.col("v") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("v").alias("root"))
    if touched.isEmpty():
        return settled
    rest = now.join(by_sort(touched.withColumnRenamed("v", "node")), F.col("v") == F.col("node"), "left_semi")
    return settled.union(connected_components(rest, "u", "v"))


def loose_edges(distinct: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b): links between the hashes of lines that share a key and may be alike, by their components, not every pair."""

    def stars_of(table, starts, chunk=None):
        """Links of the rows of each run, which are sorted by n, as stars."""
        if chunk is None:  # most rows meet nobody
            size = np.diff(np.append(starts, table.num_rows))
            table = table.filter(pa.array(np.repeat(size > 1, size)))
            size = size[size > 1]
            starts = np.cumsum(size) - size
        n, h = table.column("n").to_numpy().astype(np.int64), table.column("h").to_numpy()
        bits = pa.concat_arrays(table.column("bits").chunks) if table.num_rows else pa.array([], pa.binary())
        begin = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits)] // 8 if len(bits) else np.zeros(0, np.int32)
        test = may_be_alike(n, np.frombuffer(bits.buffers()[2], np.uint64) if len(bits) else np.zeros(0, np.uint64), begin, similarity)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
        longest = np.floor(n / similarity + 1e-6).astype(np.int64)
        stop = np.searchsorted(run << 32 | n, run << 32 | longest, side="right")  # lines up to there may be alike by length
        ahead = np.maximum(stop - np.arange(len(n)) - 1, 0)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if chunk is not None:
            whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
        ends = np.cumsum(ahead)
        a = 0
        while a < len(n):  # about a million pairs at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), side="right")))
            i = np.repeat(np.arange(a, b), ahead[a:b])
            j = np.arange(len(i)) + np.repeat(np.arange(a, b) + 1 - (ends[a:b] - ahead[a:b] - (ends[a - 1] if a else 0)), ahead[a:b])
            if chunk is not None:  # pairs within a chunk belong to the chunk's own cell
                ok = (chunk[i] != chunk[j]) | whole[i]
                i, j = i[ok], j[ok]
            ok = test(i, j)
            left.append(i[ok])
            right.append(j[ok])
            if sum(map(len, left)) > 1 << 21:
                root = stars(len(n), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(len(n)))
                left, right = [moved], [root[moved]]
            a = b
        rows, low = lowest(stars(len(n), np.concatenate(left), np.concatenate(right)), h)
        a, b = h[rows], h[low]
        return pa.array(a[a != b]), pa.array(b[a != b])

    columns = ["key", "n", "bits"]

    def meet(batches):
        def keyed():
            for batch in batches:
                place = batch.column("place").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array((place >> 32).astype(np.int32)), pa.array((place & 0x7FFFFFFF).astype(np.int32)), batch.column("h"), batch.column("bits")], ["key", "n", "h", "bits"])

        for table, starts, at in runs(keyed(), ["key"], most):
            if at is None:
                a, b = stars_of(table, starts)
                yield pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(a), table.schema.field(c).type) for c in columns), pa.nulls(len(a), pa.int64())], ["a", "b", *columns, "chunk"])
            else:
                m = table.num_rows
                yield pa.RecordBatch.from_arrays([table.column("h").combine_chunks(), pa.nulls(m, pa.int64()), *(table.column(c).combine_chunks() for c in columns), pa.array(np.arange(at, at + m) // most)], ["a", "b", *columns, "chunk"])

    def cells(batches):
        for table, starts, _ in runs(batches, ["key", "lo", "hi"], 4 * most):
            yield pa.RecordBatch.from_arrays(list(stars_of(table, starts, table.column("chunk").to_numpy())), ["a", "b"])

    kind = "a long, b long, key int, n int, bits binary, chunk long"
    found = []
    for field in KEYS:
        dealt = distinct.select(F.explode(f"keys.{field}").alias("key"), "h", "n", "bits")
        dealt = dealt.select(F.shiftleft(F.col("key").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("place"), "h", "bits")  # sorted as one number
        found.append(materialize(map_arrow(dealt.repartition(F.shiftright("place", 32)).sortWithinPartitions("place"), meet, kind)))
    met = functools.reduce(DataFrame.union, found)
    edges = met.filter("b is not null").select("a", "b")
    heavy = met.filter("b is null").select("key", F.col("a").alias("h"), "n", "bits", "chunk")
    if heavy.isEmpty():
        return edges
    sizes = heavy.groupBy("key").agg(F.max("chunk").alias("last"))
    cell = heavy.join(sizes, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    cell = cell.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "h", "n", "bits")
    return edges.union(map_arrow(cell.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n"), cells, "a long, b long"))


#: A set of marks is at most so many rows of 64 bits.
MARKS = 1 << 20


def of_texts(docs: DataFrame, id_col: str, mark_col: str, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined, "inner" or "left", with the other columns of ``found``, which has a row a text: __id, __hash.

    Only rows whose mark may be in ``found`` are shuffled. Those are told by bits, of which MARKS rows at most are broadcast
    whatever the number of texts; where two marks share a bit, a row is shuffled for nothing.
    """
    word = lambda mark: F.shiftrightunsigned(mark, 6).bitwiseAND(F.lit(MARKS - 1))
    bits = found.groupBy(word("__hash").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__hash & 63 as int)))").alias("__bits"))
    told = docs.join(F.broadcast(bits), word(mark_col) == F.col("__word"), "left")
    may = F.expr(f"coalesce(shiftrightunsigned(__bits, cast(`{mark_col}` & 63 as int)) & 1, 0) = 1")
    more = [c for c in found.columns if c not in ("__id", "__hash")]
    joined = told.filter(may).join(by_sort(found), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(mark_col) == F.col("__hash")), how).select(*docs.columns, *more)
    if how == "inner":
        return joined
    return joined.union(told.filter(~may).select(*docs.columns, *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more)))


def line_links(docs: DataFrame, firsts: DataFrame, loose: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, a2, b, b2): links between alike lines by both hashes. ``firsts``: h, h2, id, mark, line; ``loose``: node, root.

    Where b2 is null, a's whole component was in one cell, and b is its root.
    """
    columns = ("line", "g", "h", "h2", "chunks", "chunk")
    grouped = firsts.join(loose, F.col("h") == F.col("node"), "left").select(F.coalesce("root", "h").alias("g"), "h", "h2", "id", "mark", "line")
    sizes = grouped.groupBy("g").count().filter("count > 1")
    cells = grouped.join(sizes, "g").withColumn("chunks", F.ceil(F.col("count") / most)).withColumn("chunk", F.pmod("h", "chunks"))
    per_text = materialize(cells.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__hash")).agg(F.collect_list(F.struct(*columns)).alias("wanted")))  # of one text

    def fetch(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                out: dict[str, list] = {k: [] for k in (*columns[1:], "words")}
                for text, wanted in zip(binary_values(part.column("text")), part.column("wanted").to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    for w in wanted:
                        for k in columns[1:]:
                            out[k].append(w[k])
                        out["words"].append(b" ".join(normalised(lines[w["line"]])))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "words" else pa.int64()) for k, v in out.items()], list(out))

    def link(batches):
        for table, starts, _ in runs(batches, ["g", "lo", "hi"], 4 * most):
            chunk, chunks, h, h2 = (table.column(c).to_numpy() for c in ("chunk", "chunks", "h", "h2"))
            whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            data, ends = text_bytes(table.column("words").combine_chunks())
            x, at = folded_words(data, ends)
            line = np.searchsorted(ends, at, side="right") - 1
            n = np.bincount(line, minlength=table.num_rows)
            begin = np.cumsum(n) - n
            sorted_ = np.sort(line.astype(np.uint64) << np.uint64(44) | x >> np.uint64(20)) & np.uint64((1 << 44) - 1)
            bits, size = parities(numbered(sorted_, line), begin, n)
            test = may_be_alike(n, bits, np.cumsum(size) - size, similarity)
            root, left, right = np.arange(len(n)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            count = np.diff(np.append(starts, len(n)))
            run = np.repeat(np.arange(len(starts)), count)
            at = np.flatnonzero((count <= 64)[run])  # groups by the thousand: the same step of all of them at once
            for step in range(1, 64):
                at = at[at + step < len(n)]
                at = at[run[at] == run[at + step]]
                if not len(at):
                    break
                i = at[root[at] != root[at + step]]
                i = i[whole[i] | (chunk[i] != chunk[i + step])]
                i = i[test(i, i + step)]
                i = i[alike(x, begin, n, i, i + step, similarity)]
                root = stars(len(n), root[i], root[i + step])[root]
                left.append(i)
                right.append(i + step)
            for r in np.flatnonzero(count > 64).tolist():
                first, own = int(starts[r]), np.arange(count[r])
                for i in range(len(own)):  # a line against those that are not yet in its group
                    other = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
                    if not whole[first]:  # pairs within a chunk belong to the chunk's own cell
                        other = other[chunk[first + other] != chunk[first + i]]
                    other = other[test(np.full(len(other), first + i), first + other)]
                    other, most_ = other[np.argsort(own[other], kind="stable")], 1
                    while len(other):  # one of each group first, then two, four
                        now = np.arange(len(other)) - np.searchsorted(own[other], own[other]) < most_
                        found = other[now][alike(x, begin, n, np.full(now.sum(), first + i), first + other[now], similarity)]
                        left.append(np.full(len(found), first + i))
                        right.append(first + found)
                        joined = np.isin(own, own[found])
                        other = other[~now & ~joined[other]]
                        own[joined] = own[i]
                        most_ *= 2
            root = stars(len(n), np.concatenate(left), np.concatenate(right))
            rows, low = lowest(root, h)
            alone = chunks[rows] == 1  # no other cell has pairs of the group: its components are known
            out = alone | (rows != low)
            rows, low, alone = rows[out], low[out], alone[out]
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(h2[rows]), pa.array(h[low]), pa.array(h2[low], mask=alone)], ["a", "a2", "b", "b2"])

    kind = "g long, h long, h2 long, chunks long, chunk long, words binary"
    texts = map_arrow(of_texts(docs, "id", "mark", per_text, "inner").select("text", "wanted"), fetch, kind)
    texts = texts.dropDuplicates(["h", "h2"])  # rows that share id and text
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("g", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "chunks", "h", "h2", "words")
    return map_arrow(dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi"), link, "a long, a2 long, b long, b2 long")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = 5, similarity: float = 0.8, most: int = 1024, cell: int = 256) -> DataFrame:
    """(__id, __hash, gone): the numbers of the lines to go of each text, by id and hash of the text, that has any."""
    some = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).filter("text is not null")
    full = materialize(line_table(some, min_words, similarity, common_words(docs, text_col)))
    place = F.struct("id", "line", "mark")
    firsts = full.filter("copies > 0").repartition("h")  # most lines have no copy: none are sought before the shuffle
    distinct = firsts.groupBy("h", "h2").agg(F.min(place).alias("first"), F.sum("copies").alias("all"), *(F.first(c).alias(c) for c in ("n", "keys", "bits")))
    distinct = materialize(distinct.select("h", "h2", "first.id", "first.mark", "first.line", F.col("all").alias("copies"), "n", "keys", "bits"))
    lines = materialize(full.select("id", "mark", "line", "h", "h2"))
    discard(full)
    loose = components_of_stars(loose_edges(distinct, similarity, most))
    firsts = materialize(distinct.drop("n", "keys", "bits"))
    discard(distinct)
    links = materialize(line_links(some, firsts, loose, similarity, cell))
    tight = links.filter("b2 is null").select(F.col("a").alias("h"), F.col("a2").alias("h2"), F.col("b").alias("root"))
    rest = links.filter("b2 is not null")
    if not rest.isEmpty():
        ends = rest.select(F.col("a").alias("h"), F.col("a2").alias("h2")).union(rest.select("b", "b2")).distinct()
        tight = tight.union(ends.join(components_of_stars(rest), F.col("h") == F.col("node"), "left").select("h", "h2", F.coalesce("root", "h").alias("root")))
    linked = materialize(firsts.join(tight, ["h", "h2"], "left").filter("root is not null or copies > 1"))
    keep = linked.filter("root is not null").groupBy("root").agg(F.min(place).alias("keep"))
    often = linked.join(keep, "root", "left").select("h", "h2", F.coalesce("keep", place).alias("keep"))
    gone = lines.join(often, ["h", "h2"]).filter(~place.eqNullSafe(F.col("keep")))
    return materialize(gone.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__hash")).agg(F.collect_set("line").alias("gone")))  # of one text


def lines_left(text_col: str, gone: str = "gone"):
    """The text without the lines whose numbers are in ``gone``."""
    left = F.concat_ws("\n", F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i)))
    return F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, mark (hash of the text as read), n_lines, n_removed, text (without the lines removed).

    Lines (split at newlines) of ``min_words`` words (5) or more are alike if the word edit similarity of
    their normalised forms is ``similarity`` (above 0; 0.8) or more; of each group that likeness connects, the occurrence
    with the smallest (id, line number) stays. Shorter lines stay. A null text stays null with no lines.
    Null ids come first in that order. Rows that share id and text are one document, each returned with the same
    result. No rows give none. A text that loses all its lines becomes empty.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    joined = of_texts(source, "id", "mark", repeated_lines(docs, id_col, text_col, **how), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return joined.select(F.col("id").alias(id_col), "mark", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), lines_left("text").alias("text"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its text column as ``dedup_lines`` leaves it, all columns. The text is joined once, by id and hash."""
    gone = repeated_lines(docs, id_col, text_col, **how).withColumnRenamed("gone", "__gone")
    joined = of_texts(docs.withColumn("__mark", F.xxhash64(text_col)), id_col, "__mark", gone, "left")
    return joined.select(*(lines_left(text_col, "__gone").alias(c) if c == text_col else F.col(c) for c in docs.columns))
