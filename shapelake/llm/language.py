"""Language identification as mixture inference: each document's language proportions by expectation-maximisation.

A character trigram model per language gives each word a likelihood in each language; a document is a mixture of
languages over its words. For each size of language set the proportions are fitted by EM, and the set with the best
penalised likelihood wins; its largest share is the prediction. Every trigram has its own exact counts, so the model grows with
the distinct trigrams of the labelled texts: 8 bytes each, and 4 for each label. Up to a stated size it is broadcast; beyond
it each part of the documents is joined with the counts of its own trigrams.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pieces
from .parts import scored_in_parts

UNKNOWN = "und"


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each trigram of ' word ', where each word's begin): a word of n characters has n of them.

    The number is the three code points side by side, 21 bits each.
    """
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
    key = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    size = np.array([len(w) for w in words])
    inside = np.ones(len(key), bool)
    inside[(np.cumsum(size + 1) - 1)[:-1]] = False  # last character, blank, first character of the next word
    return key[inside], np.concatenate([[0], np.cumsum(size)[:-1]])


def trigram_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, key, n): counts over all rows, added up within each task first."""

    def count(batches):
        seen: dict[str, Counter] = {}

        def flush():
            for label, words in seen.items():
                key, starts = trigrams(list(words))
                times = np.repeat(np.fromiter(words.values(), np.int64), np.diff(np.append(starts, len(key))))
                key, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(key), pa.string()), pa.array(key), pa.array(n)], ["label", "key", "n"])
            seen.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                for label, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if words := text.lower().split():
                        seen.setdefault(label, Counter()).update(words)
                if sum(map(len, seen.values())) > 400_000:
                    yield from flush()
        yield from flush()

    source = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).filter("label is not null and text is not null")
    return map_arrow(source, count, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))


Model = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]


def fit_languages(docs: DataFrame, text_col: str = "text", label_col: str = "lang", smoothing: float = 0.5) -> Model:
    """(labels, trigrams in order, log-probabilities by trigram and label, and those of an unknown trigram).

    Learned from every labelled row. The distinct trigrams' counts come to the driver, one row a trigram and label.
    """
    return languages_of(trigram_counts(docs, text_col, label_col), smoothing)


def languages_of(counted: DataFrame, smoothing: float = 0.5) -> Model:
    """The model of ``trigram_counts``, on the driver."""
    counts = counted.toPandas()
    labels = sorted(counts["label"].unique())
    keys, at = np.unique(counts["key"].to_numpy(np.int64), return_inverse=True)
    n = np.full((len(keys), len(labels)), smoothing)
    np.add.at(n, (at, np.searchsorted(labels, counts["label"].to_numpy(str))), counts["n"].to_numpy(float))
    total = n.sum(axis=0) + smoothing  # an unknown trigram counts as one more
    return list(labels), keys, np.log(n / total).astype(np.float32), np.log(smoothing / total).astype(np.float32)


def trigram_likelihoods(model: Model, key: np.ndarray) -> np.ndarray:
    """Log-probability of each trigram under each label."""
    _, keys, table, unknown = model
    if not len(keys):
        return np.tile(unknown, (len(key), 1))
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where((keys[at] == key)[:, None], table[at], unknown)


def mixture(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Shares (documents x labels): EM over words for the nested sets of 1, 2, ... all labels; best penalised set."""
    n, k = np.diff(np.append(starts, len(doc))).astype(np.float32), like.shape[1]
    top = like.max(axis=1, keepdims=True)
    like = np.exp(like - top)

    def em(share):
        for _ in range(rounds):
            part = like * share[doc]
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, starts) / n[:, None]
        return share, np.add.reduceat(np.log((like * share[doc]).sum(axis=1)), starts)

    full, fit = em(np.full((len(starts), k), 1 / k, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    best, gain = full, fit - penalty * k * np.log(n + 1)
    for size in range(1, k):
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :size], 1, axis=1)
        if size == 1:
            share, fit = allowed, np.add.reduceat(np.log((like * allowed[doc]).sum(axis=1) + 1e-30), starts)
        else:
            share, fit = em((full + 1e-3) * allowed / ((full + 1e-3) * allowed).sum(axis=1, keepdims=True))
        better = fit - penalty * size * np.log(n + 1) > gain
        gain = np.where(better, fit - penalty * size * np.log(n + 1), gain)
        best = np.where(better[:, None], share, best)
    return best


def identify_batch(part: pa.RecordBatch, model: Model, rounds: int, penalty: float) -> pa.RecordBatch:
    """(id, lang_pred, score, shares) of a batch with id and text."""
    labels = model[0]
    texts = [(x or "").lower() for x in part.column("text").to_pylist()]
    letters = [any(map(str.isalpha, x)) for x in texts]
    known = [i for i, x in enumerate(letters) if x and labels]
    pred, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if known:
        words = [texts[i].split() for i in known]
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) for x in words for w in x])
        key, begins = trigrams(list(number))
        like = np.add.reduceat(trigram_likelihoods(model, key), begins)[at]
        n = np.array([len(x) for x in words])
        share = mixture(like, np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)[:-1]]), rounds, penalty)
        for i, row in zip(known, share, strict=True):
            j = int(row.argmax())
            pred[i], score[i] = labels[j], min(1.0, float(row[j]))
            shares[i] = [(labels[k], float(row[k])) for k in np.flatnonzero(row > 1e-3)]
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "shares"])


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, penalty: float = 0.5) -> DataFrame:
    """One row per input row: id, lang_pred, score (the label's share, 0 to 1), shares (map of the chosen set).

    ``und`` with score 0 if the text is null or has no letter, or if the model has no labels. Only the text is used.
    Whole texts, whatever their length. Repeated rows stay repeated; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                yield identify_batch(part, shared.value, rounds, penalty)

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, identify, f"id {kind}, lang_pred string, score double, shares map<string,double>").withColumnRenamed("id", id_col)


def identify_in_parts(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, penalty: float = 0.5, smoothing: float = 0.5, part: int = 4 << 20) -> DataFrame:
    """The rows of ``identify_languages`` for ``trigram_counts`` of any size; a part of the texts has about ``part`` characters."""
    sums = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()  # one row a label
    labels = [r["label"] for r in sums]
    entries = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("at"))
    entries = materialize(entries.select("key", F.array(*(F.coalesce(F.try_element_at("at", F.lit(x)), F.lit(0)).cast("double") for x in labels)).alias("n")))
    total = np.array([float(r["n"]) for r in sums]) + smoothing * entries.count() + smoothing
    unknown = np.log(smoothing / total).astype(np.float32)

    def keys_of(rows: pa.Table) -> np.ndarray:
        words = {w for x in rows.column("text").to_pylist() for w in (x or "").lower().split()}
        return np.unique(trigrams(list(words))[0]) if words else np.zeros(0, np.int64)

    def score(rows: pa.Table, table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().astype(np.int64)
        way = np.argsort(key)
        n = np.array(table.column("n").to_pylist(), float).reshape(len(key), len(labels))[way]
        model = labels, key[way], np.log((n + smoothing) / total).astype(np.float32), unknown
        return pa.Table.from_batches([identify_batch(p, model, rounds, penalty) for b in rows.combine_chunks().to_batches() for p in pieces(b, "text", 2 << 20)])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scored_in_parts(source, F.coalesce(F.length("text"), F.lit(0)) + 1, part, keys_of, entries, score, f"id {kind}, lang_pred string, score double, shares map<string,double>")
    return found.withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = 1 << 24) -> DataFrame:
    """``identify_languages`` of ``docs`` as learned from ``labelled``: the model is broadcast if its trigrams times its
    labels are ``most`` at most, else joined in parts; the rows are the same either way. Docs and texts of any number and length."""
    counts = materialize(trigram_counts(labelled, text_col, label_col))
    size = counts.agg(F.count_distinct("key"), F.count_distinct("label")).first()
    if size[0] * (2 + size[1]) <= most:
        return identify_languages(docs, languages_of(counts), id_col, text_col)
    return identify_in_parts(docs, counts, id_col, text_col)
