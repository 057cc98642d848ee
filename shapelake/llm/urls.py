"""URL filters: rules by host and path, and a character language-model ratio for what no rule fits.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each URL a log-likelihood
difference per character. The rules' own verdicts are the training labels. The threshold is calibrated on URLs kept
out of training. Every n-gram has its exact count, so the models grow with the distinct n-grams of the labelled URLs: up
to a stated number they are broadcast, beyond it each part of the URLs is joined with the counts of its own n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_arrow, materialize
from .parts import scored_in_parts

#: (verdict, host and path): a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a parameter of at most some hundreds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngram_keys(url: bytes, orders: int) -> np.ndarray:
    """(context or with next x orders x characters) numbers of the contexts of 0, 1, ... bytes before each byte, and of
    those with the byte. Different n-grams have different numbers: nine bits a symbol, and the order and kind on top."""
    code = np.concatenate([np.ones(orders, np.int64), np.frombuffer(url, np.uint8).astype(np.int64) + 3, [2]])
    n = len(url) + 1
    out = np.zeros((2, orders, n), np.int64)
    h = np.zeros(n, np.int64)
    for order in range(orders):
        if order:
            h = h | code[orders - order : orders - order + n] << 9 * (order - 1)
        out[0, order] = h | order << 56
        out[1, order] = h << 9 | code[orders:] | order << 56 | 1 << 60
    return out


def url_counts(labelled: DataFrame, url_col: str, label_col: str, orders: int = 6) -> DataFrame:
    """(key, n0, n1): how often each n-gram is in rejected and in accepted URLs, over all rows whose label isn't null.

    Every n-gram has its own exact count. At most 6 orders.
    """

    def count(batches):
        for batch in batches:
            for label in (False, True):
                urls = [u for u, x in zip(batch.column("url").to_pylist(), batch.column("label").to_pylist(), strict=True) if x == label]
                for a in range(0, len(urls), 4096):
                    key, n = np.unique(np.concatenate([ngram_keys(u.encode(), orders).ravel() for u in urls[a : a + 4096]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), label)), pa.array(key), pa.array(n.astype(np.int64))], ["label", "key", "n"])

    source = labelled.select(F.col(url_col).alias("url"), F.col(label_col).alias("label")).filter("url is not null and label is not null")
    both = (F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).cast("float") for x in (False, True))
    return map_arrow(source, count, "label boolean, key long, n long").groupBy("key").agg(*(n.alias(f"n{i}") for i, n in enumerate(both)))


def in_order(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the n-grams in order, counts (rejected or accepted, n-gram))."""
    key = counts.column("key").to_numpy().astype(np.int64)
    way = np.argsort(key)
    return key[way], np.stack([counts.column(c).to_numpy().astype(np.float32)[way] for c in ("n0", "n1")])


def fit_url_models(labelled: DataFrame, url_col: str, label_col: str, orders: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """``url_counts`` on the driver, ``in_order``: 16 bytes for each distinct n-gram. For labelled tables of known size."""
    return in_order(url_counts(labelled, url_col, label_col, orders).toArrow())


def score_urls(urls: list, known: np.ndarray, counts: np.ndarray, orders: int, strength: float) -> np.ndarray:
    """Log-likelihood per character as accepted less that as rejected; 0 for a null URL."""
    out = np.zeros(len(urls))
    for i, url in enumerate(urls):
        if url is None:
            continue
        key = ngram_keys(url.encode(), orders)
        n = np.zeros((2, *key.shape), np.float32)
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            n = np.where(known[at] == key, counts[:, at], np.float32(0))
        chance = np.full((2, key.shape[2]), 1 / 256)
        for order in range(orders):  # each order falls back on the one below
            chance = (n[:, 1, order] + strength * chance) / (n[:, 0, order] + strength)
        mean = np.log(chance).mean(axis=1)
        out[i] = mean[1] - mean[0]
    return out


def url_scores(pages: DataFrame, url_col: str, model: tuple[np.ndarray, np.ndarray], orders: int = 6, strength: float = 1.0) -> DataFrame:
    """``pages`` with ``score`` (``score_urls``) by a model on the driver, which is broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(urls):
        return pd.Series(score_urls(urls.tolist(), *shared.value, orders, strength))

    return pages.withColumn("score", score(F.col(url_col)))


def url_scores_in_parts(pages: DataFrame, url_col: str, counts: DataFrame, orders: int = 6, strength: float = 1.0, part: int = 1 << 17) -> DataFrame:
    """The rows of ``url_scores`` for counts of any size; a part of the URLs has about ``part`` characters."""

    def keys_of(rows: pa.Table) -> np.ndarray:
        keys = [ngram_keys(u.encode(), orders).ravel() for u in rows.column(url_col).to_pylist() if u is not None]
        return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)

    def score(rows: pa.Table, table: pa.Table) -> pa.Table:
        return rows.append_column("score", pa.array(score_urls(rows.column(url_col).to_pylist(), *in_order(table), orders, strength)))

    schema = StructType([*pages.schema.fields, StructField("score", DoubleType())])
    return scored_in_parts(pages, F.length(url_col) + 1, part, keys_of, counts, score, schema)


def calibrate(scored: DataFrame, label_col: str, bins: int = 400, reach: float = 4.0) -> float:
    """The score that parts accepted from rejected best (mean of both classes' hits); -inf without one of the classes."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("score") + reach) * (bins / (2 * reach))))).cast("int")
    rows = scored.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("int").alias("label"), place.alias("bin")).count().collect()  # 2 x bins
    n = np.zeros((2, bins + 1))
    for r in rows:
        n[r["label"], r["bin"]] += r["count"]
    if not n.sum(axis=1).all():
        return -np.inf
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1)[:, : bins + 1] / n.sum(axis=1, keepdims=True)
    good = below[0] - below[1]
    best = np.flatnonzero(good == good.max())
    return float(best.mean()) * 2 * reach / bins - reach


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most: int = 1 << 22) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict ('allow' or 'block'), score.

    A rule's verdict stands; else the models decide. A quarter of the rule-labelled URLs, by a checksum of the URL, is
    kept from training to set the threshold. A null URL has score 0. Without labels of both kinds all is allowed.
    Repeated rows stay repeated; no rows give none. Models of up to ``most`` n-grams are broadcast; the rows are the
    same either way.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    base = base.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("hit").isNotNull(), F.col("hit.verdict") == "allow")
    held = F.crc32(F.col("url").cast("binary")) % 4 == 0
    known = base.select("url", label.alias("label"), held.alias("held")).filter("label is not null and url is not null")
    counts = materialize(url_counts(known.filter(~F.col("held")), "url", "label"))
    few = counts.count() <= most
    scores, model = (url_scores, in_order(counts.toArrow())) if few else (url_scores_in_parts, counts)
    threshold = calibrate(scores(known.filter("held"), "url", model), "label")
    judged = scores(base, "url", model)
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= float(threshold), "allow").otherwise("block"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
