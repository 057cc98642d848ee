"""Search, sharding and the divergence audit against brute force: nulls, ties, repeated rows, long texts, clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapelake.llm import catalog, divergence, search, sharding, terms
from shapelake.llm.common import scratch_dir
from tests.oracle import compare

KIND = "doc_id long, text string, lang string, source string, item string, term string, n string, shard string, md5 string"
FOLD = {c: c + 32 for c in range(65, 91)}


def found(text, kind):
    return [x.translate(FOLD) for x in re.findall(kind, text or "")]


WORDS, LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def texts():
    rnd = random.Random(8)
    pool = ["the", "Of", "naïve", "ÀÉ", "x", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "日本語", "日本語日本語日本語", "z" * 40, "Z" * 33, "12", "a1b2", "don't"]
    pool += ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 20))) for _ in range(150)]
    out = [None, "", " \n\t,.;", "one", "THE the The", "the" * 3000, "0 1 2", "\x00null\x00bytes"]
    for _ in range(160):
        n = rnd.choice([1, 5, 30, 200])
        out.append(rnd.choice([" ", ", ", "\n"]).join(rnd.choice(pool[: rnd.choice([8, 40, 166])]) for _ in range(n)))
    return out + out[20:24] * 4


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i % 41 == 7 else i % 150, t, ("x", "y", None, "one")[i % 4 if i % 50 else 3], ("s", "t", "", "u", None)[i % 5], *["clash"] * 5) for i, t in enumerate(texts())]
    rows += rows[30:33] + [(None, None, None, None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


def test_terms_and_radix_order():
    column = pa.array(texts())
    for kind, pattern in ((terms.ALPHANUMERIC, WORDS), (terms.LETTERS, LETTERS)):
        t = terms.Terms(column, kind)
        want = [(i, w) for i, x in enumerate(texts()) for w in found(x, pattern)]
        assert list(zip(t.row.tolist(), t.strings(np.arange(len(t.start))).to_pylist(), strict=True)) == want
        known = [w.encode() for w in sorted({w for _, w in want})[::2]]
        number = {w: i for i, w in enumerate(known)}
        assert terms.Vocabulary(known).numbers(t).tolist() == [number.get(w.encode(), -1) for _, w in want]
    empty = terms.Terms(pa.array([None, ""], pa.string()), terms.LETTERS)
    assert not len(empty.start) and not len(terms.Vocabulary([b"a"]).numbers(empty))
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 64, 500, np.uint64) >> np.uint64(s) for s in (3, 62))
    assert terms.radix_order([a, b]).tolist() == np.lexsort((a, b)).tolist()
    with pytest.raises(ValueError):
        terms.Vocabulary([b"a", b"a"])


def best_by_hand(rows, items, top):
    n = [len(found(r["text"], WORDS)) for r in rows]
    count, total = sum(x > 0 for x in n), sum(n)
    tfs = [Counter(found(r["text"], WORDS)) for r in rows]
    df = Counter(w for tf in tfs for w in tf)
    out = {}
    for item, query in items.items():
        scores = []
        for r, tf, k in zip(rows, tfs, n, strict=True):
            m = 75 + (25 * k * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in query if w in tf)
            if s > 0:
                scores.append((-s, r["doc_id"] is None, r["doc_id"] or 0))
        out[item] = [(i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("share", [0.0, 0.25, 1e9])
@pytest.mark.parametrize("most", [1 << 20, 40])
def test_search(spark, docs, share, most):
    """All lists long, some short, all short; all items at once and dealt to parts."""
    rnd = random.Random(2)
    asked = [(i, " ".join(rnd.choice(x).split()[:30])) for i, x in enumerate([[t for t in texts() if t and len(t) > 50]] * 12)]
    asked += [(20, None), (21, ""), (22, "nowhere"), (23, "the THE the x"), (23, "abcdefghijklmnopq"), (None, "日本語 " + "z" * 40)]
    items = spark.createDataFrame([(i, q, "clash", 1.0) for i, q in asked], "item_id int, text string, doc_id string, rank double")
    words = defaultdict(list)
    for i, q in asked:
        words[i] += found(q, WORDS)
    want = best_by_hand(docs.collect(), words, 5)
    got = defaultdict(list)
    for r in search.search(docs, items, 5, share=share, most=most).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(x, key=lambda r: r[0]) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert len(want[20]) == len(want[22]) == 0 and len(want[None]) == 5


def test_search_over_several_blocks(spark, docs, monkeypatch):
    """Blocks smaller than a batch: the least score that counts rises from block to block."""
    q = spark.createDataFrame([(1, "the naïve x abcdefgh"), (2, "one 日本語 12 of")], "item_id long, text string")
    rows = docs.repartition(1)
    whole = sorted(map(tuple, search.search(rows, q).collect()))
    column = [r["text"] for r in docs.collect()]
    vocabulary = sorted({w.encode() for x in q.collect() for w in found(x["text"], WORDS)})

    class Held:
        value = terms.Vocabulary(vocabulary)

    batch = pa.RecordBatch.from_pydict({"id": pa.array([r["doc_id"] for r in docs.collect()], pa.int64()), "text": pa.array(column)})
    table = pa.Table.from_batches(search._occurrences(Held)([batch]))
    n = table.column("n").to_numpy()
    table = table.append_column("m", pa.array(75 + 25 * n * len(n) // n.sum())).combine_chunks()
    df = np.bincount(table.column("terms").combine_chunks().flatten().to_numpy(), minlength=len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * len(n) + 2) / (2 * d + 1))) for d in df])
    entries = [(i, vocabulary.index(w.encode())) for i, x in enumerate(q.collect()) for w in found(x["text"], WORDS)]
    item, term = map(np.array, zip(*entries, strict=True))
    for share in (0, 40, 10**9):
        asked = search.Queries(item, term, weight[term], df[term], 2, len(vocabulary), share)
        best = search.Best(2, 20, np.ones(2, np.int64))
        for a in range(0, table.num_rows, 7):
            block = search.Block(table.slice(a, 7).combine_chunks().to_batches()[0], len(vocabulary))
            search.search_block(block, block.id.fill_null(search._LAST).to_numpy(), asked, best)
        got = [(i + 1, k + 1, None if d == search._LAST else int(d), int(s)) for i in (0, 1) for k, (s, d) in enumerate(zip(best.score[i], best.id[i], strict=True))]
        assert sorted(got, key=str) == sorted(whole, key=str)


def test_search_of_empty_tables(spark, docs):
    q = spark.createDataFrame([("a", "the")], "item_id string, text string")
    assert search.search(docs.limit(0), q).count() == 0 and search.search(docs, q.limit(0)).count() == 0
    assert search.search(docs.filter("text is null"), q).count() == 0
    assert {r["item_id"] for r in search.search(docs, q, 3).collect()} == {"a"}


def chosen(key, weights):
    def score(s):
        u = int(md5(f"{key}|{s // 4}".encode()).hexdigest()[8 * (s % 4) :][:8], 16)
        return -math.log((u + 0.5) / 2**32) / weights[s]

    return min((s for s in range(len(weights)) if weights[s]), key=lambda s: (score(s), s))


@pytest.mark.parametrize("most", [65_536, 2])
def test_sharding(spark, docs, most):
    weights, new = [1.0, 2.0, 0.0, 0.5, 1.0, 3.0], 1.5
    got = sharding.assign_shards(docs, weights, new, parts=4, most=most).collect()
    want = Counter()
    for r in docs.collect():
        text, key = (r["text"] or "").encode(), "" if r["doc_id"] is None else r["doc_id"]
        want[r["doc_id"], len(text) + 16, zlib.crc32(text), chosen(key, weights), chosen(key, [*weights, new])] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], len(weights))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and 2 not in slots
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.assign_shards(docs, bad)


def test_shards_hold_their_weights_and_move_little(spark):
    rows, weights = spark.range(40_000).withColumnRenamed("id", "doc_id"), [1.0, 2.0, 3.0, 4.0]
    n = sharding.with_shards(rows, "doc_id", weights, "shard", "grown", 2.0).groupBy("shard", "grown").count().toPandas()
    share = n.groupby("shard")["count"].sum() / 40_000
    assert np.allclose(share, np.array(weights) / 10, atol=0.01)
    moved = n[n["shard"] != n["grown"]]
    assert set(moved["grown"]) == {4} and moved["count"].sum() / 40_000 == pytest.approx(2 / 12, abs=0.01)


def test_written_shards(spark, docs):
    path = scratch_dir(spark)
    column = sharding.write_shards(docs, path, [1.0, 1.0, 1.0], tasks=2)
    assert column == "_shard"
    back = spark.read.parquet(path)
    assert Counter(map(str, back.drop(column).select(*docs.columns).collect())) == Counter(map(str, docs.collect()))
    assert all(r[column] == chosen("" if r["doc_id"] is None else r["doc_id"], [1.0] * 3) for r in back.collect())
    assert "PartitionFilters: [isnotnull(_shard" in back.filter(f"{column} = 1")._jdf.queryExecution().executedPlan().toString()


def audit_by_hand(rows, least, top):
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, t = r["lang"] or "", r["source"] or "", found(r["text"], LETTERS)
        groups[lang, source].update(t)
        held[lang].update(set(t))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for w, n in held[lang].items() if n >= least]
        of = {s: {w: groups[g, s][w] for w in kept} for g, s in groups if g == lang}
        whole = {w: sum(c[w] for c in of.values()) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            pair = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in of if t != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if of[s][w] and p[s][w] > q[w]]
            for part, x, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(sorted(x, key=lambda y: (-y[1], y[0].encode()))[:most])]
    return out


@pytest.mark.parametrize("cell", [200_000, 15])
def test_divergence(spark, docs, cell):
    got = divergence.divergence_audit(docs, top=10, cell=cell).collect()
    assert sorted(map(tuple, got)) == sorted(audit_by_hand(docs.collect(), 3, 10))
    assert {r["part"] for r in got} == {"pair", "term"}
    assert divergence.divergence_audit(docs.limit(0)).count() == 0
    assert divergence.divergence_audit(docs.filter("text is null")).filter("value <> 0").count() == 0


def test_long_texts_have_slices_of_their_own(spark):
    """Texts over 8 MB: one of many terms, one a single term of a million characters, among short ones."""
    long, one = "the cat sat on a mat " * 450_000, "y" * 1_000_000
    rows = [(i, t, "x", s) for i, (t, s) in enumerate([("the cat", "a"), (long, "b"), (one, "a"), (one, "b"), (one + " the", "b"), ("mat the", "a")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence_audit(docs).collect())) == sorted(audit_by_hand(docs.collect(), 3, 200))
    items = {1: ["cat", one], 2: ["mat"]}
    got = search.search(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, y in best_by_hand(docs.collect(), items, 20).items() for x in y)
    assert sharding.assign_shards(docs).agg(F.max("size")).first()[0] == len(long) + 16


@pytest.mark.parametrize("name", ["op11_search", "op12_sharding", "op13_divergence"])
def test_query_matches_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], "/root/testdata/sf0.001") == ""
