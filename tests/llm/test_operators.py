"""Brute force, exact round trips and held-out accuracy on small tables with nulls, empty texts, ties and clashing names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shapelake.llm import catalog, embeddings, hamming, language, lines, mixing, packing, quality, simhash, substring, token_files, urls
from shapelake.llm.common import runs, scratch_dir, stars
from tests.oracle import compare

KIND = "doc_id long, text string, lang string, source string, n_chars long, at string, id string"


def passages():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(70), prose(200)
    out = [None, "", " \n\t", "one", "Two words", base, base, base + " tail", base.upper(), prose(9000), shared + " " + prose(60), prose(60) + "\n" + shared, prose(30) + " " + shared + " " + shared]
    out += ["\n".join(prose(12) for _ in range(5)) + "\n" + line for line in (prose(20),) * 3 + ("Café, costs $5 <|endoftext|> don't",)]
    return out + [prose(rnd.randint(1, 300)) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xy"[i % 2] if i % 5 else None, "s" if i % 3 else None, 0, "clash", "clash") for i, t in enumerate(passages())]
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids(text):
    return np.array(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_packing(spark, docs):
    pieces = packing.pack_pieces(docs, with_ids=True).collect()
    want = {i: ids(t) for i, t in enumerate(passages())}
    assert {d: sum(p["length"] for p in pieces if p["doc_id"] == d) for d in want} == {d: len(x) for d, x in want.items()}
    for p in pieces:
        x = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert bytes(p["ids"]) == x.tobytes() and zlib.crc32(x.tobytes()) == p["ids_crc32"]
    last = max(p["sequence_id"] for p in pieces)
    full = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == full[p["sequence_id"]]
        full[p["sequence_id"]] += p["length"]
    assert all(full[s] == 2048 for s in range(last))
    assert packing.pack_pieces(docs.limit(0)).count() == 0


def test_token_files(spark, docs):
    path = scratch_dir(spark)
    token_files.write_token_files(docs, path)
    start = 0
    for r in sorted(token_files.token_digests(token_files.read_token_files(spark, path)).collect()):
        x = ids(passages()[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_token_files_are_read_in_part(spark):
    """Encodings, row groups and indexes of the files; few documents, or metadata alone, read few bytes."""
    import pyarrow.parquet as pq

    rnd = random.Random(3)
    rows = [(i, " ".join(str(rnd.getrandbits(20)) for _ in range(60))) for i in range(3000)]
    path = scratch_dir(spark)
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, row_group=256 << 10, page=16 << 10)
    files = [f for f in spark.read.parquet(path).inputFiles()]
    groups = hit = 0
    for f in files:
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            column = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            tokens = next(c for k, c in column.items() if k.startswith("tokens"))
            assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index and tokens.has_column_index
            assert all("DELTA_BINARY_PACKED" in column[c].encodings for c in ("doc_id", "n_tokens", "shard", "at"))
            groups += 1
            hit += column["doc_id"].statistics.min <= 1234 <= column["doc_id"].statistics.max
    assert hit == 1 and groups > 2
    one = token_files.read_token_files(spark, path).filter("doc_id = 1234").collect()
    assert [r["n_tokens"] for r in one] == [len(ids(rows[1234][1]))] and one[0]["tokens"] == ids(rows[1234][1]).tolist()
    plan = token_files.read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    empty = scratch_dir(spark)
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert token_files.token_digests(token_files.read_token_files(spark, empty)).count() == 0


def test_packing_of_filtered_rows_opens_one_chunk_a_split(spark):
    path = scratch_dir(spark)
    spark.range(4000).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path).filter("doc_id % 2 = 0")
    assert packing._encoded(docs, "doc_id", "text", None, 1).select("chunk").distinct().count() <= 2
    assert packing.pack_pieces(docs).agg(F.sum("length")).first()[0] == sum(len(ids(f"word {i}")) for i in range(0, 4000, 2))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    found, fp = table(simhash.simhash_near_duplicates(docs)), [fingerprint(t) for t in passages()]
    near = np.array([[(a ^ b).bit_count() <= 4 for b in fp] for a in fp])
    root = stars(len(fp), *np.nonzero(near))
    assert all((r["fingerprint"], r["component_id"]) == (f"{fp[i]:016x}", root[i]) for i, r in found.items()) and len(found) == len(fp)
    kept = simhash.keep_one_per_group(docs, width=4, bits=4, blocks=6)
    assert kept.count() == len(set(root.tolist())) and kept.columns == docs.columns
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0
    assert simhash.simhash_near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b = passages()[9][:2000], passages()[10][:2000]
    rows = [(1, a), (2, a), (2, b), (None, a), (None, b + " end"), (3, b)]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (2, b)]


def test_recall_of_near_copies_by_similarity():
    """Of pairs of 300-word texts whose five-word shingles have a Jaccard similarity of 0.95 and 0.9, at 6 bits."""
    rnd = random.Random(1)
    found = {0.95: 0, 0.9: 0}
    for least, edits in ((0.95, 1), (0.9, 3)):
        for _ in range(100):
            w = [str(rnd.getrandbits(30)) for _ in range(300)]
            v = list(w)
            for p in range(edits):
                v[20 + 90 * p] = "other"
            s, t = ({tuple(x[i : i + 5]) for i in range(296)} for x in (w, v))
            assert len(s & t) / len(s | t) >= least
            x, y = (simhash.shingle_fingerprint(" ".join(z).encode(), 5, 42) & (1 << 64) - 1 for z in (w, v))
            found[least] += (x ^ y).bit_count() <= 6
    assert found[0.95] >= 80 and found[0.9] >= 35


def altered(words, edits, rnd):
    out = list(words)
    for p in rnd.sample(range(len(out)), edits):
        out[p] = "other" + str(rnd.getrandbits(30))
    return out


def similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("length", "least"), [(60, 0.9), (300, 0.85), (3000, 0.8)])
def test_recall_of_alike_texts_by_similarity(length, least):
    """Both tests of a pair, with new words put in: of pairs at a similarity of 0.8 or more most are found, below 0.65 none."""
    rnd = random.Random(length)
    high, low = [], []
    while len(high) < 100 or len(low) < 100:
        w = [f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(length)]
        v = altered(w, rnd.choice([length // 60, length // 45, length // 12]), rnd)
        s = similarity(w, v)
        (p, x), (q, y) = (simhash.text_fingerprints(" ".join(t).encode(), 5, 42) for t in (w, v))
        far = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
        found = ((p ^ q) & (1 << 64) - 1).bit_count() <= 6 and far <= 165
        if s >= 0.8:
            high.append(found)
        elif s < 0.65:
            low.append(found)
    assert sum(high) >= least * len(high) and not any(low)


def test_wide_fingerprint_counts_bits():
    for n in (1, 2, 7, 600, 5000):  # past a byte's ones and past a part
        h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        bits = np.zeros(1024, int)
        for x in h.tolist():
            for k in range(16):
                z = (x + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                bits[64 * k : 64 * k + 64] += np.unpackbits(np.frombuffer((z ^ z >> 31).to_bytes(8, "little"), np.uint8))
        assert simhash.wide_fingerprint(h) == np.packbits(2 * bits + np.arange(1024) % 2 > n).tobytes()
    assert simhash.wide_fingerprint(np.zeros(0, np.uint64)) == bytes(128)


def test_one_of_alike_texts_stays(spark):
    """Near copies, copies, repeated rows, shared and null ids, texts without words, a clashing column."""
    rnd = random.Random(5)
    base = [[f"w{rnd.getrandbits(12)}" for _ in range(200)] for _ in range(4)]
    near = [" ".join(altered(base[0], 2, rnd)) for _ in range(40)]
    a, b, c, d = (" ".join(x) for x in base)
    rows = [(10 + i, t) for i, t in enumerate(near)] + [(5, a), (5, a), (60, a.upper()), (61, b), (61, c), (None, c + " end"), (None, d), (70, None), (71, ""), (72, " "), (80, "one two"), (81, "two one"), (82, "One  two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __id string").repartition(5)
    kept = simhash.keep_one_of_alike(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (5, a), (61, b), (61, c), (None, d), (70, None), (80, "one two"), (81, "two one")], key=str)
    assert simhash.keep_one_of_alike(df.limit(0)).count() == 0


def test_wide_links_of_hot_buckets(spark):
    """A bucket in chunks gives the components of all pairs that pass both tests; equal short fingerprints occur."""
    rnd = random.Random(9)
    wide = [rnd.getrandbits(1024) for _ in range(3)]
    rows = [(i, 12345 ^ sum(1 << rnd.randrange(60) for _ in range(i % 3)), wide[i % 3] ^ sum(1 << k for k in rnd.sample(range(1024), 60 + 40 * (i % 2)))) for i in range(300)]
    df = spark.createDataFrame([(i, f, w.to_bytes(128)) for i, f, w in rows], "node long, fp long, wide binary")
    want = stars(300, *np.nonzero([[(f ^ g).bit_count() <= 4 and (w ^ x).bit_count() <= 165 for _, g, x in rows] for _, f, w in rows]))
    for most in (16, 2048):
        edges = hamming.hamming_edges(df, 4, most=most, wide="wide", far=165).collect()
        assert (stars(300, np.array([e["a"] for e in edges]), np.array([e["b"] for e in edges])) == want).all()


def test_hot_buckets_give_the_same_components(spark):
    rnd = random.Random(3)
    fps = list({rnd.getrandbits(63) if i % 3 else 12345 ^ sum(1 << rnd.randrange(60) for _ in range(3)) for i in range(400)})
    edges = hamming.hamming_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, most=16).collect()
    at = {x: i for i, x in enumerate(fps)}
    ours = stars(len(fps), np.array([at[e["a"]] for e in edges], int), np.array([at[e["b"]] for e in edges], int))
    x = np.array(fps, np.uint64)
    assert (ours == stars(len(fps), *np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))).all()


def test_runs_keep_every_row():
    import pyarrow as pa

    keys = [k for k, n in enumerate([3, 1, 40, 2, 2, 25, 1]) for _ in range(n)]
    got = []
    for size in (1, 4, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size])], ["k"]) for a in range(0, len(keys), size)]
        out = [(t.column("k").to_pylist(), at) for t, _, at in runs(iter(batches), ["k"], 10)]
        got.append(Counter(k for t, _ in out for k in t))
        assert {t[0] for t, at in out if at is not None} == {2, 5}
    assert all(g == Counter(keys) for g in got)


def test_vectors(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(60, 16)).astype(np.float32)
    x = [*base, *(base[0] + rnd.normal(size=(40, 16)).astype(np.float32) * 0.05), *([base[1]] * 12), np.zeros(16, np.float32)]
    rows = [(i, [float(e) for e in v], 0) for i, v in enumerate(x)] + [(200, None, 0), (201, [1.0, None] * 8, 0), (202, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for most in (8, 1024):
        found = {r["vec_id"]: r for r in embeddings.embedding_near_duplicates(df, most=most).collect()}
        u = np.array(x[:-1], float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        assert sum(found[i]["n_links"] for i in range(len(u))) >= 0.9 * near.sum()
        assert all(found[i]["n_links"] <= near[i].sum() for i in range(len(u)))
        assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (112, 200, 201, 202))
    assert embeddings.embedding_near_duplicates(df.limit(0)).count() == 0


def test_block_schemes_find_links_at_the_threshold():
    """Every scheme, on codes of random 64-d pairs whose cosine is 0.95 to 0.96."""
    rnd = np.random.default_rng(2)
    u, v = rnd.normal(size=(2, 20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = rnd.uniform(0.95, 0.96, size=(len(u), 1))
    v = c * u + np.sqrt(1 - c * c) * v
    mean, axes = embeddings.learn_rotation(u[:10_000], 64)
    unlike = embeddings.codes(u, mean, axes) ^ embeddings.codes(v, mean, axes)
    for blocks, agree in ((6, 1), (8, 2)):
        met = np.any([unlike & m == 0 for m in np.array(hamming.block_masks(blocks - agree, blocks), np.int64)], axis=0)
        assert met.mean() >= 0.9


@pytest.mark.parametrize("dims", [2, 16, 64])
def test_planted_vectors(spark, dims):
    """Pairs planted at 0.955 or more among random vectors: blocks find nine in ten, the exact way all; short vectors' buckets are small too."""
    rnd = np.random.default_rng(dims)
    u = rnd.normal(size=(400, dims))
    v = rnd.normal(size=u.shape)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = rnd.uniform(0.955, 1, size=(len(u), 1))
    x = np.concatenate([u, c * u + np.sqrt(1 - c * c) * v])
    x = np.concatenate([x, x[:20] * 3])  # exact directions again
    rows = [(i, e.tolist(), i) for i, e in enumerate(x)] + [(None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long").withColumn("x", F.lit(1))
    y = np.concatenate([x, x[:1]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = y @ y.T >= 0.95
    np.fill_diagonal(want, False)
    want = want.sum(axis=1)
    for how in ({}, {"blocks": 8, "agree": 2}, {"exact": True, "most": 100}):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_near_duplicates(df, **how).collect()}
        links = np.array([got[i if i < len(x) else None] for i in range(len(y))])
        assert (links <= want).all() and links.sum() >= (1 if "exact" in how else 0.9) * want.sum()
    mean, axes = embeddings.learn_rotation(y[:-1], 64)
    assert axes.shape == (dims, 64)
    if dims == 16:
        big = rnd.normal(size=(20_000, 16))
        big /= np.linalg.norm(big, axis=1, keepdims=True)
        code = embeddings.codes(big, *embeddings.learn_rotation(big[:10_000], 64))
        for m in np.array(hamming.block_masks(5, 6), np.int64):
            assert np.unique(code & m, return_counts=True)[1].max() < 2_000


def test_packing_after_a_sort(spark):
    """Rows of two files that a sort has interleaved make a few chunks, and each id still lies in one piece."""
    path = scratch_dir(spark)
    for k in range(2):
        spark.range(k, 4000, 2).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text")).coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    assert packing._encoded(docs.orderBy("doc_id"), "doc_id", "text", None, 1).select("chunk").distinct().count() <= 24
    for d in (docs, docs.orderBy("doc_id")):
        out = packing.pack_pieces(d).toPandas()
        assert len(out[out["start"] == 0]) == 4000 and (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()
        spans = out.sort_values(["sequence_id", "offset"])
        at = spans["sequence_id"] * 2048 + spans["offset"]
        assert (at.to_numpy()[1:] == (at + spans["length"]).to_numpy()[:-1]).all() and at.min() == 0


def word_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def lines_gone(texts):
    """Brute force, without the operator's own functions: for each (id, text) the numbers of the lines to go, and links."""
    at = {}
    for i, t in texts:
        for j, line in enumerate((t or "").split("\n")):
            w = tuple(x.decode() for x in line.encode().lower().split())
            if len(w) >= 5:
                at.setdefault(w, []).append((i is not None, i or 0, j))
    keys = list(at)
    pair = [(a, b) for a in range(len(keys)) for b in range(a) if abs(len(keys[a]) - len(keys[b])) <= 0.2 * max(len(keys[a]), len(keys[b])) and 5 * word_distance(keys[a], keys[b]) <= max(len(keys[a]), len(keys[b]))]
    root = stars(len(keys), np.array([p[0] for p in pair], int), np.array([p[1] for p in pair], int))
    gone = {}
    for r in set(root.tolist()):
        places = sorted(p for k in np.flatnonzero(root == r) for p in at[keys[k]])
        for there, i, j in places:
            if (there, i, j) != places[0]:
                gone.setdefault(i if there else None, set()).add(j)
    return gone, len(pair)


def check_lines(spark, texts, **how):
    gone, links = lines_gone(texts)
    found = lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), **how).collect()
    assert len(found) == len(texts)
    by_id = dict(texts)
    for r in found:
        t = by_id[r["doc_id"]]
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(r["doc_id"], ()))
        assert r["text"] == want and r["n_removed"] == len(gone.get(r["doc_id"], ()))
    return links


def test_lines(spark, docs):
    assert check_lines(spark, [(i, t) for i, t in enumerate(passages()) if len(t or "") < 20_000]) == 1
    found = table(lines.dedup_lines(docs))  # with other columns of clashing names, and a line of 9,000 words
    assert len(found) == len(passages()) and found[10]["n_lines"] == 1 and found[0]["text"] is None
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert lines.without_repeated_lines(docs).columns == docs.columns


def test_lines_by_edit_similarity_alone(spark):
    """Every pair at edit similarity 0.8 or more is found, in chunked buckets and cells too, and none below it."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for n in [*range(5, 40), 79, 81, 120, 181, 420] * 2:
        base = [rnd.choice(vocabulary) for _ in range(n)]
        for k in (0, 1, n // 5, n // 5, n // 5 + 1):
            w = list(base)
            for p in rnd.sample(range(n), k):
                w[p] = rnd.choice(vocabulary)
            if k and rnd.random() < 0.5:
                del w[rnd.randrange(len(w))]
            rows.append(" ".join(w))
    rows += [" ".join(["same"] * 9 + [rnd.choice("abc")]) for _ in range(3)] + ["12 34 56 78 90", "99 11 45 20 33"]
    phrase = "one two three four five six seven eight"
    rows += [" ".join([phrase] * k) for k in (8, 9, 10, 12)] + [" ".join([phrase.replace("four", "4")] * 9)]
    for most, cell in ((16, 8), (1024, 128)):
        assert check_lines(spark, list(enumerate(rows)), most=most, cell=cell) > 150


def test_lines_of_texts_without_id_and_of_repeated_rows(spark):
    line = "a line of some ten words that is seen twice"
    check_lines(spark, [(None, line), (1, line.replace("seen", "read")), (2, line)])
    df = spark.createDataFrame([(1, line)] * 20_000 + [(2, line.replace("seen", "read"))], "doc_id long, text string")
    found = lines.dedup_lines(df).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(1, 0, 20_000), (2, 1, 1)]


def test_lines_of_a_very_long_text(spark):
    """One text of over 8 MB, more than a slice: its repeats go, the rest stays."""
    rnd = random.Random(6)
    own = [" ".join(str(rnd.getrandbits(40)) for _ in range(8)) for _ in range(90_000)]
    df = spark.createDataFrame([(1, "\n".join([*own, *own[:7]])), (2, own[5] + "\nshort")], "doc_id long, text string")
    found = table(lines.dedup_lines(df))
    assert found[1]["text"] == "\n".join(own) and found[1]["n_removed"] == 7 and found[2]["text"] == "short"


def test_edit_similarity():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randint(0, 3) for _ in range(rnd.randint(1, 9) * rnd.choice((1, 1, 20)))] for _ in range(2))
        assert lines.edit_similarity(a, b, 0.0) == pytest.approx(1 - word_distance(a, b) / max(len(a), len(b)))


@pytest.mark.parametrize("shares", [[7, 1, 30, 13, 1], [1, 10**9], [1, 1, 1], [5] * 40 + [2] * 300])
def test_schedule_deviates_less_than_a_block(shares):
    """Until a source runs out, and every block has one position; a source of weight 1e-9 costs no more than another."""
    total, blocks = sum(shares), [60 + i for i in range(len(shares))]
    at, numbers = mixing.schedule(shares, blocks)
    assert Counter(zip(at, numbers, strict=True)) == Counter((i, j) for i, n in enumerate(blocks) for j in range(n))
    done = [0] * len(shares)
    for t, (i, j) in enumerate(zip(at, numbers, strict=True)):
        assert j == done[i]
        done[i] += 1
        assert all(abs(done[k] * total - (t + 1) * v) < total for k, v in enumerate(shares))
        if done[i] == blocks[i]:
            break
    assert mixing.schedule([], []) == ([], [])


def test_mix_with_a_tiny_weight_and_clashing_columns(spark):
    rows = [(i, "x" * 63, "hot", i) for i in range(50)] + [(100, None, "rare", 7), (101, "y", None, 8), (None, "z", "rare", 9), (3, "x" * 63, "hot", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_position long").withColumn("mixed_id", F.lit(1)).withColumn("__position", F.lit(2)).withColumn("__id", F.lit(3))
    out = mixing.mix_sources(df, weights={"hot": 1.0, "rare": 1e-9}, block=64, parts=4)
    assert out.count() == len(rows) and out.filter("source is null").count() == 1
    got = mixing.mixed_order(df, weights={"hot": 1.0, "rare": 1e-9}, block=64, parts=4)
    assert got.columns == df.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, df.collect()))
    assert mixing.mixed_order(df.limit(0)).count() == 0
    few = mixing.mix_sources(df, block=1, parts=4, most=8).agg(F.max("position")).first()[0]
    assert few < 8 + 3


def test_many_small_sources_leave_the_hot_one_its_weight(spark):
    """One source of a third of the weight and 600 that share the rest: less than 1.1 blocks off the real target."""
    rows = [(i, "x" * 63, "hot") for i in range(400)] + [(1000 + 2 * i + k, "x" * 63, f"s{i}") for i in range(600) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"hot": 1 / 3} | {f"s{i}": 2 / 1800 for i in range(600)}
    out = mixing.mix_sources(df, weights=weights, block=64, parts=4).select("source", "position").collect()
    order = [r["source"] for r in sorted(out, key=lambda r: r["position"])]
    seen = Counter()
    for t, name in enumerate(order[:900]):
        seen[name] += 1
        assert abs(seen["hot"] - (t + 1) / 3) < 1.1


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs, block=64, parts=4).collect()
    assert len(out) == len(passages())
    assert len({r["position"] for r in out}) == len({(r["source"], r["block"]) for r in out})
    assert mixing.mixed_order(docs).columns == docs.columns and mixing.mixed_order(docs).count() == len(passages())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, weights={"s": 3.0}).count() == len(passages())


def test_quality(spark, docs):
    found = table(quality.quality_verdicts(docs))
    for i, t in enumerate(passages()):
        w = [x.decode() for x in (t or "").encode().split()]
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        ls = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover))
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.keep_good(docs).count() == sum(r["kept"] for r in found.values())
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_repeated_passages(spark, docs):
    found, first = table(substring.remove_repeated_passages(docs)), {}
    for i, t in enumerate(passages()):
        w = (t or "").encode().split()
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    for i, t in enumerate(passages()):
        w = (t or "").encode().split()
        gone = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_text"]) == (len(w), len(gone), kept)
        assert sum(s["end"] - s["start"] for s in found[i]["spans"]) == len(gone)
    assert substring.remove_repeated_passages(docs.limit(0)).count() == 0


def test_overlapping_passages(spark):
    """Short windows over few words: runs that start and end anywhere, loops, ids shared by different texts."""
    rnd = random.Random(8)
    stock = [[rnd.choice("abcde") for _ in range(rnd.randint(3, 30))] for _ in range(12)]
    texts = [[w for _ in range(rnd.randint(0, 5)) for s in [rnd.choice(stock)] for w in s[rnd.randint(0, 3) : rnd.randint(4, 30)]] for _ in range(80)] + [list("ab") * 40, list("ab") * 31, list("a") * 50]
    rows = [(i // 2 if i < 20 else i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 5):
            first.setdefault(tuple(w[a : a + 6]), i)
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {p for a in range(len(w) - 5) if first[tuple(w[a : a + 6])] < i for p in range(a, a + 6)}
        want[(i, len(w), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    found = substring.remove_repeated_passages(df, width=6, gram=3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["kept_text"]) for r in found) == want


def test_quality_follows_the_group(spark):
    """A document's verdict changes when only the other rows of its group do."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    text = lambda symbols: " ".join([word() for _ in range(60)] + ["#" * symbols])

    def verdict(mine, others):
        rows = [(0, text(mine), "x", "a")] + [(i + 1, text(k), "x", "a") for i, k in enumerate(others)] + [(1000 + i, text(0), "x", "b") for i in range(120)]
        out = table(quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
        return out[0]["kept"]

    assert not verdict(9, [2] * 199)
    assert verdict(9, [rnd.randint(5, 60) for _ in range(199)])


def test_language(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = catalog.op9_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    model = language.fit_languages(docs)
    found = table(language.identify_languages(docs, model))
    assert all(found[i]["lang_pred"] == "und" for i in (0, 1, 2)) and all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in language.identify_languages(docs, language.fit_languages(docs.limit(0))).collect()} == {"und"}


def test_mixture_is_the_plain_em(spark):
    """EM and the penalised choice of a set of languages, of any size, against a word-by-word EM in plain Python."""
    rnd = np.random.default_rng(3)
    n, k = [1, 4, 30, 200], 7
    like = rnd.normal(-12, 2, size=(sum(n), k)).astype(np.float32)
    like[5:35, :5] += 4
    ends = np.cumsum(n)
    got = language.mixture(like.copy(), np.repeat(np.arange(4), n), ends - n, 8, 0.5)
    for d, (a, b) in enumerate(zip(ends - n, ends, strict=True)):
        p = np.exp(like[a:b].astype(float) - like[a:b].max(axis=1, keepdims=True))

        def em(share, p=p):
            for _ in range(8):
                part = [[x * s for x, s in zip(row, share, strict=True)] for row in p.tolist()]
                share = [sum(row[j] / sum(row) for row in part) / len(part) for j in range(k)]
            return share, sum(np.log(sum(x * s for x, s in zip(row, share, strict=True))) for row in p.tolist())

        full, fit = em([1 / k] * k)
        best, gain = full, fit - 0.5 * k * np.log(len(p) + 1)
        order = sorted(range(k), key=lambda j: -full[j])
        for size in range(1, k):
            some = [full[j] + 1e-3 if j in order[:size] else 0.0 for j in range(k)]
            share, fit = em([x / sum(some) for x in some])
            if fit - 0.5 * size * np.log(len(p) + 1) > gain:
                best, gain = share, fit - 0.5 * size * np.log(len(p) + 1)
        assert np.allclose(got[d], best, atol=2e-3)


def test_trigrams_have_exact_counts(spark, docs):
    labels, keys, table_, unknown = language.fit_languages(docs)
    want = Counter()
    for i, t in enumerate(passages()):
        if i % 5:
            for w in (t or "").lower().split():
                w = f" {w} "
                want.update(("xy"[i % 2], w[j : j + 3]) for j in range(len(w) - 2))
    number = lambda w: ord(w[0]) << 42 | ord(w[1]) << 21 | ord(w[2])
    distinct = {w for _, w in want}
    assert labels == ["x", "y"] and keys.tolist() == sorted(map(number, distinct))
    for j, label in enumerate(labels):
        total = sum(n for (x, _), n in want.items() if x == label) + 0.5 * (len(distinct) + 1)
        for w in distinct:
            assert table_[np.searchsorted(keys, number(w)), j] == pytest.approx(np.log((want[label, w] + 0.5) / total), abs=1e-4)
        assert unknown[j] == pytest.approx(np.log(0.5 / total), abs=1e-4)


def test_url_verdicts_by_a_plain_model(spark):
    """Scores, threshold and verdicts of URLs without a rule against a Markov model counted in plain Python."""
    rnd = random.Random(12)
    rows = [f"https://{rnd.choice(['good', 'fine', 'nice'])}{rnd.randint(0, 99)}.org/{rnd.choice(['read', 'text'])}" for _ in range(80)]
    rows += [f"https://{rnd.choice(['casino', 'spam', 'win'])}{rnd.randint(0, 99)}.com/de/{rnd.choice(['buy', 'now'])}" for _ in range(80)]
    rows += ["https://good7.net/read", "https://casino7.net/de/buy"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    label = [i < 80 for i in range(160)]
    held = [zlib.crc32(u.encode()) % 4 == 0 for u in rows]
    n = [Counter(), Counter()]
    for u, good, out in zip(rows, label, held, strict=False):
        if not out:
            x = [-1] * 6 + list(u.encode()) + [-2]
            n[good].update((kind, o, tuple(x[t - o : t + kind])) for t in range(6, len(x)) for o in range(6) for kind in (0, 1))

    def score(u):
        x = [-1] * 6 + list(u.encode()) + [-2]
        mean = []
        for c in n:
            logs = []
            for t in range(6, len(x)):
                p = 1 / 256
                for o in range(6):
                    p = (c[1, o, tuple(x[t - o : t + 1])] + p) / (c[0, o, tuple(x[t - o : t])] + 1)
                logs.append(np.log(p))
            mean.append(np.mean(logs))
        return mean[1] - mean[0]

    want = [score(u) for u in rows]
    assert all(found[i]["score"] == pytest.approx(want[i], abs=1e-4) for i in range(len(rows)))
    assert found[160]["rule"] is None and (found[160]["verdict"], found[161]["verdict"]) == ("allow", "block")
    bins = [(min(399, max(0, int(np.floor((s + 4) * 50)))), good) for s, good, out in zip(want, label, held, strict=False) if out]
    good = [np.mean([b >= t for b, g in bins if g]) + np.mean([b < t for b, g in bins if not g]) for t in range(401)]
    best = np.mean(np.flatnonzero(np.array(good) == max(good))) * 8 / 400 - 4
    assert all((found[i]["verdict"] == "allow") == (want[i] >= best) for i in (160, 161))


def test_url_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, "s", "h"), (1, "http://a.org/", "s", "h"), (1, "http://a.org/", "s", "h"), (2, "http://b.net/" + "x" * 200_000, "s", "h")], "page_id long, url string, score string, host string")
    out = urls.filter_urls(df).collect()
    assert len(out) == 4 and all(r["verdict"] == "allow" for r in out)  # labels of one kind only: a threshold below every score


def test_urls(spark):
    rows = ["http://A.Example.org/es/1", "https://example.org/en/17", "x://y.org/q?z", "http://b.com/de/1#t", "http://b.com/fr/", "http://b.org", None, "no scheme", "", "http://c.net/zz"] * 4
    df = spark.createDataFrame([(i, u, "html") for i, u in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    want = [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("y.org", "/q", "org/", "allow"), ("b.com", "/de/1", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("b.org", "", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("c.net", "/zz", None, None)]
    for i, r in out.items():
        host, path, rule, verdict = want[i % 10]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_models_too_large_to_broadcast_give_the_same_rows(spark, docs):
    rnd = random.Random(9)
    rows = [f"https://{rnd.choice(['good', 'casino'])}{rnd.randint(0, 99)}.{rnd.choice(['org', 'com', 'net'])}/{rnd.choice(['read', 'de/buy'])}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*rows, None, "", rows[0]])), "page_id long, url string")
    want = {tuple(r) for r in urls.filter_urls(df).collect()}
    assert len(want) == 203 and {tuple(r) for r in urls.filter_urls(df, most=0).collect()} == want
    known = df.select("url", (F.col("page_id") < 100).alias("label"))
    counts, model = urls.url_counts(known, "url", "label"), urls.fit_url_models(known, "url", "label")
    for part in (1, 500, 1 << 20):
        assert sorted(map(str, urls.url_scores_in_parts(df, "url", counts, part=part).collect())) == sorted(map(str, urls.url_scores(df, "url", model).collect()))
    assert urls.filter_urls(df.limit(0), most=0).count() == 0
    want = sorted(map(str, language.identify_languages(docs, language.fit_languages(docs)).select("doc_id", "lang_pred", F.round("score", 4)).collect()))
    for part in (3000, 4 << 20):
        found = language.identify_in_parts(docs, language.trigram_counts(docs, "text", "lang"), part=part)
        assert sorted(map(str, found.select("doc_id", "lang_pred", F.round("score", 4)).collect())) == want
    assert {r["lang_pred"] for r in language.learn_and_identify(docs, docs.limit(0), most=-1).collect()} == {"und"}


def test_url_models_count_every_ngram_exactly(spark):
    """More distinct n-grams than any fixed table of 131,072 buckets keeps apart."""
    rnd = random.Random(4)
    rows = [("".join(chr(rnd.randint(33, 126)) for _ in range(40)) + "é", i % 2 == 0) for i in range(2500)]
    key, counts = urls.fit_url_models(spark.createDataFrame(rows, "url string, label boolean"), "url", "label")
    want = Counter()
    for url, label in rows:
        x = [-1] * 6 + list(url.encode()) + [-2]
        for t in range(6, len(x)):
            for order in range(6):
                want[(label, 0, tuple(x[t - order : t]))] += 1
                want[(label, 1, order, tuple(x[t - order : t + 1]))] += 1
    assert len(key) == len({k[1:] for k in want}) > 1 << 17 and (np.diff(key) > 0).all()
    for label in (0, 1):
        assert Counter(counts[label][counts[label] > 0].tolist()) == Counter(n for k, n in want.items() if k[0] == label)


def test_quality_of_two_groups(spark):
    """The same document is kept in one group and rejected in another; both fences are above zero. Null ids and clashing names pass."""
    rnd = random.Random(10)
    text = lambda k: " ".join(["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)] + ["#" * k])
    same = text(9)
    rows = [(1, same, "x", "a"), (2, same, "x", "b"), (None, None, "x", "a"), (None, text(0), None, None)]
    rows += [(10 + i, text(2), "x", "a") for i in range(150)] + [(500 + i, text(12), "x", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.quality_verdicts(df).filter("doc_id in (1, 2)").collect()}
    assert not out[1]["kept"] and out[2]["kept"] and 0 < out[1]["symbol_ratio_fence"] < out[2]["symbol_ratio_fence"]
    wide = df.withColumns({"__id": F.lit(1), "__mark": F.lit(2), "bad_id": F.lit(3), "Bad_Mark": F.lit(4)})
    kept = quality.keep_good(wide)
    assert kept.columns == wide.columns and kept.count() == quality.quality_verdicts(df).filter("kept").count()
    assert quality.keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], "/root/testdata/sf0.001") == ""


def by_similarity(d, kept):
    """Holds the documents kept against the Jaccard similarity of all pairs, five words a shingle."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), x or "").encode().split() for x in d["text"]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    ids, n = d["doc_id"].tolist(), len(sets)
    alike = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    root = stars(n, *np.nonzero(alike >= 0.85))
    for r in set(root.tolist()):  # at most one of what is surely alike stays
        assert sum(ids[i] in kept for i in np.flatnonzero(root == r)) <= 1
    np.fill_diagonal(alike, 0)
    assert all(ids[i] in kept or alike[i].max() >= 0.7 for i in range(n))
    loose = stars(n, *np.nonzero(alike >= 0.7))
    for r in set(loose.tolist()):  # and one of what may be alike
        assert any(ids[i] in kept for i in np.flatnonzero(loose == r))


def test_pipeline(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_dir(spark)
        after = stage(spark, d, "")
        assert after.columns == d.columns, name
        after.write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "quality":
            want = quality.quality_verdicts(d).filter("kept").count()
        elif name == "near_dedup":
            want = kept.count()
            by_similarity(d.toPandas(), set(kept.toPandas()["doc_id"]))
        else:
            want = d.count()
        assert kept.count() == want, name
        d = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, "").toPandas()
    place = mixing.mix_sources(d).toPandas().set_index("doc_id")["position"]
    order = pieces[pieces["start"] == 0].sort_values(["sequence_id", "offset"])["doc_id"].map(place)
    assert order.is_monotonic_increasing and len(order) == d.count()


def test_common_words_are_counted_in_all_texts(spark):
    """Of 40,000 texts no half is left out: every word that two of them share is known."""
    import numpy as np
    import pyarrow as pa

    from shapelake.llm import lines
    from shapelake.llm.hashed import folded_words, text_bytes

    texts = [f"Pair{i // 2} all" for i in range(40_000)]
    docs = spark.createDataFrame(enumerate([*texts, None]), "doc_id long, text string").repartition(3)
    slots = folded_words(*text_bytes(pa.array(texts)))[0] >> np.uint64(44)
    which, n = np.unique(slots, return_counts=True)
    found = lines.common_words(docs, "text")
    assert set(found.tolist()) == set(which[n > 1].tolist()) and found[-1] == which[n.argmax()]
    order = lines.word_order(found)(folded_words(*text_bytes(pa.array(["pair7 all"])))[0])
    assert order[0] < order[1]


def test_large_tables_of_lines_are_deleted_and_texts_joined_once(spark, tmp_path, monkeypatch):
    """What is on disk at once: no table of keys is kept, and a whole row is shuffled at most once."""
    import uuid

    import pyarrow.parquet as pq

    from shapelake import storage

    monkeypatch.setattr(storage, "scratch_dir", lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}")
    line = "a line of some ten words that is seen {} twice"
    docs = spark.createDataFrame([(i if i else None, (line.format("quite") if i in (0, 7) else f"{i} " * 6) + "\nend", i) for i in range(30)] + [(50, None, 50)], "doc_id long, text string, other int")
    out = lines.without_repeated_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = {r["other"]: r["text"] for r in out.collect()}
    again = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    assert rows[0] == line.format("quite") + "\nend" and rows[7] == "end" and rows[50] is None and again == {d: int(d == 7) for d in [None, *range(1, 30), 50]}
    kept = [pq.read_schema(f).names for f in tmp_path.rglob("*.parquet")]
    assert kept and not [names for names in kept if "keys" in names]
    assert plan.count("hashpartitioning(coalesce(doc_id") == 1


def test_texts_are_found_whatever_bits_their_marks_share(spark, monkeypatch):
    """Few bits, many marks: the filter before the join leaves out nothing that the join would find."""
    rnd = random.Random(4)
    docs = [(rnd.choice([None, *range(40)]), rnd.choice([-1, 1]) * rnd.getrandbits(62), i) for i in range(400)]
    found = [(*d[:2], d[2]) for d in rnd.sample(docs, 150)] + [(7, 5, -1)]
    left, right = spark.createDataFrame(docs, "id long, m long, i long"), spark.createDataFrame(found, "__id long, __hash long, j long")
    for most in (1 << 20, 2):
        monkeypatch.setattr(lines, "MARKS", most)
        have = {x[2]: x[2] for x in found if x[2] >= 0}
        assert sorted(map(tuple, lines.of_texts(left, "id", "m", right, "inner").select("i", "j").collect())) == sorted(have.items())
        got = lines.of_texts(left, "id", "m", right, "left").select("i", "j").collect()
        assert len(got) == 400 and {r["i"]: r["j"] for r in got} == {x[2]: have.get(x[2]) for x in docs}


def test_lines_alike_by_changed_words_or_one_gap_are_not_compared_word_by_word(monkeypatch):
    rnd = random.Random(8)
    rows = []
    for _ in range(200):
        own = [rnd.randint(0, 9) for _ in range(rnd.randint(1, 30) * rnd.choice((1, 1, 8)))]
        other = list(own)
        for _ in range(rnd.randint(0, len(own) // 3 + 1)):
            other[rnd.randrange(len(other))] = 11
        gap = rnd.randint(0, len(own) // 5)
        at = rnd.randint(0, len(own) - gap)
        rows += [own, other, own[:at] + own[at + gap :]]
    n = np.array([len(r) for r in rows])
    begin, x = np.cumsum(n) - n, np.array([w for r in rows for w in r], np.uint64)
    i, j = np.repeat(np.arange(0, 600, 3), 5), np.concatenate([[k + 1, k + 2, rnd.randrange(600), rnd.randrange(600), k] for k in range(0, 600, 3)])
    for least in (0.0, 0.5, 0.8, 1.0):
        want = [lines.edit_similarity(rows[a], rows[b], least) >= least for a, b in zip(i, j, strict=True)]
        assert all(lines.alike(x, begin, n, i, j, least, most).tolist() == want for most in (1 << 20, 50))
    assert not len(lines.alike(x, begin, n, i[:0], j[:0], 0.8))
    monkeypatch.setattr(lines, "edit_similarity", None)
    gaps = np.arange(0, 600, 3)
    assert lines.alike(x, begin, n, gaps, gaps + 2, 0.8).all()


def test_groups_of_lines_in_one_cell_need_no_rounds(spark, monkeypatch):
    """Pairs of alike lines, and copies: components are known from the cell, and stars that touch no other are left as they are."""
    rounds = []
    monkeypatch.setattr(lines, "connected_components", lambda *a: rounds.append(a))
    line = "{0} a{0} b{0} c{0} d{0} e{0} f{0} g{0} h{0}"
    texts = [(k, f"{line.format(k % 20)} {'x' if k < 20 else 'y'}\n{line.format(99)} z") for k in range(40)]
    found = table(lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)))
    assert not rounds and {k: r["n_removed"] for k, r in found.items()} == {k: (k >= 20) + (k > 0) for k in range(40)}


def test_components_of_stars(spark):
    rnd = random.Random(5)
    edges = [(k, k + r) for k in range(0, 400, 10) for r in range(1, 4)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)] + [(7, 7), (13, 11), (5, 3), (5, 0), (-2, 390), (-2, -1)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, lines.connected_components(df).collect()))
    assert sorted(map(tuple, lines.components_of_stars(df).collect())) == want and len(want) > 150
    assert lines.components_of_stars(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[3, None, 1, 3, 2, None], ["b", None, "a", "b", "ab", None], [3.5, None, 1.0, 3.5, 2.0, None]])
def test_first_of_copies_read_together(ids):
    import pyarrow as pa

    h, h2 = np.array([5, 5, 5, 5, 6, 6]), np.array([1, 1, 1, 2, 1, 1])
    got = lines.copies_of_firsts(pa.array(ids), np.zeros(6, np.int64), np.array([0, 4, 0, 1, 2, 3]), h, h2).tolist()
    assert got == ([1] * 6 if ids[0] == 3.5 else [0, 3, 0, 1, 0, 2])
