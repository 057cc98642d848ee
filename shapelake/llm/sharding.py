"""Sharding by weighted rendezvous hashing: each record goes to the shard whose score for its key is best.

A shard's score for a key is -ln(u) / weight with u from a hash of key and shard alone, the least being best. Another
shard leaves all other scores as they are, so it takes records, about its share of the weights, and moves no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_counted
from .common import free_name, materialize

#: 32-bit numbers in an md5.
_FOUR = 4


def _number(md5: Column, k: int) -> Column:
    return F.conv(F.substring(md5, 8 * k + 1, 8), 16, 10).cast("long")


def with_shards(rows: DataFrame, key: str, weights: Sequence[float], shard: str, grown: str | None = None, new: float = 1.0) -> DataFrame:
    """rows with ``shard``, from 0, by the key's text and the shards' weights; with ``grown``, also the shard that the key
    has once there is one more, of weight ``new``.

    A null key counts as ''. Shards of weight 0 take nothing; of equal scores the smaller shard's is taken. md5 gives four
    shards' numbers at a time.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0 or new <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    all_ = [*weights, new] if grown else list(weights)
    text, md5, best = F.coalesce(F.col(key).cast("string"), F.lit("")), free_name(rows, "md5"), free_name(rows, "best")
    hashes = [F.md5(F.concat(text, F.lit(f"|{i}")).cast("binary")).alias(f"m{i}") for i in range(-(-len(all_) // _FOUR))]
    score = lambda s: -F.log((_number(F.col(f"{md5}.m{s // _FOUR}"), s % _FOUR) + 0.5) / float(1 << 32)) / float(all_[s])
    bids = [F.struct(score(s).alias("score"), F.lit(s).alias("shard")) for s in range(len(all_)) if all_[s] > 0]
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    out = rows.withColumn(md5, F.struct(*hashes)).withColumn(best, least(bids[:-1] if grown else bids))
    if grown:
        out = out.withColumn(grown, F.least(best, bids[-1])["shard"])
    return out.withColumn(shard, F.col(f"{best}.shard")).drop(best, md5)


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, new: float = 1.0, key: str = "doc_id", text: str = "text", parts: int = 1024, most: int = 65_536) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): each row's shard, and its place there, gapless from 0.

    ``size`` is the text's UTF-8 bytes and 16; ``grown_shard`` is where the row goes once there is a shard more, of weight
    ``new``. Slots follow a hash of the row in ``parts`` parts a shard, then key, size and checksum, so that they are the
    same in every run. A null text has no bytes and the checksum 0; rows with a null key are kept and share a shard, as
    rows with equal keys do; equal rows have different slots; no rows give none. Other columns aren't read.

    Rows with the same key, size and checksum are one row with a number until their slots are known, those with more than
    ``most`` are laid out by many tasks, and rows of one key lie in all parts of its shard, so no key holds up a task.
    """
    rows = docs.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"))
    rows = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    own = F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "crc").cast("binary"))
    rows = materialize(with_shards(rows, "key", weights, "shard", "grown", new).withColumn("part", _number(own, 0) % parts))
    starts = rows.groupBy("shard", "part").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(starts.select("shard", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start")))
    inner = Window.partitionBy("shard", "part").orderBy("key", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_counted(rows.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))), starts, ["shard", "part"])
    placed = placed.select("key", "size", "crc", "shard", "grown", (F.col("start") + F.col("before")).alias("first"), "n")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    out = [F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", slot, F.col("grown").alias("grown_shard")]
    many = placed.filter(F.col("n") > most).withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {most}L)")))
    many = many.repartition("key", "size", "crc", "at").withColumns({"first": F.col("first") + F.col("at"), "n": F.least(F.lit(most), F.col("n") - F.col("at"))})
    return placed.filter(F.col("n") <= most).select(*out).unionByName(many.select(*out))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 40, key: str = "doc_id", column: str = "shard", tasks: int = 8, rows_per_file: int = 1_000_000) -> str:
    """Write all columns as Parquet, a folder ``column``=N for each shard, and return the column's name.

    The name gets underscores before it while docs has it. ``tasks`` write each shard, so it has as many files or more.
    """
    while column.lower() in {c.lower() for c in docs.columns}:
        column = f"_{column}"
    placed = with_shards(docs, key, weights, column)
    deal = F.pmod(F.xxhash64(*(c for c, t in docs.dtypes if "map" not in t)), F.lit(tasks))
    placed.repartition(len(weights) * tasks, column, deal).sortWithinPartitions(column).write.partitionBy(column).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return column
