"""Quality rules with thresholds that follow the data: DataFrame functions only.

Each document gets counts of its whole text. A quantile sketch of each ratio per language and source, over the documents
in which the ratio isn't zero, gives the group's fence: the value that ``LEVELS`` of them don't exceed, drawn toward the
language's fence by a weight of ``prior`` documents, and that toward the fence of all. Sketches merge map-side, so a hot
source costs one row a task. Documents beyond a fence of their group are rejected by a join with the fences. There is no
fixed cutoff: what is beyond depends on the other documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, free_name, materialize

#: The share of a group's documents with a ratio above zero that lie within its fence.
LEVELS = {"symbol_ratio": 0.9, "dup_line_ratio": 0.99, "repeat_ratio": 0.99}
RATIOS = tuple(LEVELS)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column) -> Column:
    """Positions covered by 3-word windows whose hash is in ``windows`` twice or more: sort, mark equals, add up reach."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s):
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + 3).alias("end")))["n"]

    return _let(tagged, covered)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (bigint); null text: none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select("*", text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("__lines"))
    n = F.size("__words")
    word = lambda i: F.get(F.col("__words"), i)
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = split.select("*", three.alias("__three"))
    symbols = F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))
    counts = {"n_words": n, "word_chars": F.length(F.regexp_replace("__text", f"[{BLANKS}]+", "")), "n_symbols": symbols, "n_lines": F.size("__lines"), "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines"))}
    repeats = F.when(F.size(F.array_distinct("__three")) < F.size("__three"), _repeat_words(F.col("__three"))).otherwise(0)
    return out.select(*docs.columns, *(c.cast("long").alias(k) for k, c in counts.items()), repeats.cast("long").alias("n_repeat_words"))


def group_fences(features: DataFrame, levels: dict[str, float], prior: float, k: int) -> DataFrame:
    """(lang, source, <ratio>_fence): each ratio's quantile among the group's documents in which it isn't zero.

    With n such documents and quantile q, the fence is (n q + prior * wider) / (n + prior): small groups lean on their
    language's fence, which leans on that of all documents in the same way. Null if the ratio is zero in all documents.
    """
    some = lambda r: F.when(F.col(r) > 0, F.col(r))
    sketch = [x for r in RATIOS for x in (F.count(some(r)).alias(f"{r}_n"), F.kll_sketch_agg_double(some(r), F.lit(k)).alias(r))]
    merge = [x for r in RATIOS for x in (F.sum(f"{r}_n").alias(f"{r}_n"), F.kll_merge_agg_double(r, F.lit(k)).alias(r))]
    groups = materialize(features.groupBy("lang", "source").agg(*sketch))
    langs, every = groups.groupBy("lang").agg(*merge), groups.agg(*merge)  # sketches have a bounded size
    joined = groups.alias("g").join(langs.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).join(F.broadcast(every.alias("e")), F.lit(True))

    def fence(r):
        n = lambda t: F.col(f"{t}.{r}_n")
        limit = lambda t: F.when(n(t) > 0, F.kll_sketch_get_quantile_double(F.col(f"{t}.{r}"), F.lit(levels[r])))
        lean = lambda t, wider: F.when(n(t) > 0, (n(t) * limit(t) + F.lit(float(prior)) * wider) / (n(t) + F.lit(float(prior)))).otherwise(wider)
        return lean("g", lean("l", limit("e"))).alias(f"{r}_fence")

    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *map(fence, RATIOS))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, levels: dict[str, float] = LEVELS, prior: float = 20, k: int = 1024) -> DataFrame:
    """One row per input row: id, mark (hash of the text), the counts, base_failed, kept, and the fences applied.

    base_failed: under ``min_words`` words, or over half the words in repeated 3-word windows. Else a document is kept
    unless one of its ratios is above its group's fence. Null languages and sources are groups of their own; a null
    text fails; ties with a fence are kept. Repeated rows stay repeated, null ids null; no rows give none. Texts are taken whole, however
    long. Base failures don't count towards the fences; a group that has none but those has null fences. As fences are
    quantiles, some documents of a group that has nothing bad in it are beyond them too: about a hundredth of those
    that repeat a word or line, a tenth of those with a symbol.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    counts = text_counts(source, "text").drop("text")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    features = materialize(counts.withColumns({"symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "base_failed": base}))
    fences = group_fences(features.filter(~F.col("base_failed")), levels, prior, k).alias("t")
    f = features.alias("f")
    joined = f.join(fences, F.col("f.lang").eqNullSafe(F.col("t.lang")) & F.col("f.source").eqNullSafe(F.col("t.source")), "left")
    beyond = F.greatest(*(F.coalesce(F.col(r) > F.col(f"{r}_fence"), F.lit(False)) for r in RATIOS))
    return joined.select(F.col("id").alias(id_col), "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"), *(f"{r}_fence" for r in RATIOS))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns, whatever their names.

    Rows with the same id and text go or stay together, a null id being a value like others; a null text goes; no rows give none.
    """
    name, mark = free_name(docs, "bad_id"), free_name(docs, "bad_mark")
    bad = quality_verdicts(docs, id_col, text_col, **how).filter(~F.col("kept")).select(F.col(id_col).alias(name), F.col("mark").alias(mark)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(mark)), "left_anti")
