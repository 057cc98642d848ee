"""Mixing sources to target weights by Pfair scheduling: DataFrame functions, and the blocks' order laid out on the driver.

A source's documents, in a fixed pseudo-random order, are cut into blocks of equal length. Its weight w is a share of
the slots; its j-th block is released at floor(j / w) and due at ceil((j + 1) / w), and each slot goes to the released
block with the earliest deadline. As the weights add up to one, every deadline is met: at any slot each source has had
its share to within less than one block, until a source runs out. Its slots then stay empty, the others keep their
proportions, and a block's position is its rank by slot. Only blocks that exist are laid out, whatever the weights,
and there are at most ``most`` of them and one a source. Prefix sums within a source run over hashed parts of it, so a
hot source is spread over ``parts`` groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize


def source_blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, parts: int, most: int) -> DataFrame:
    """(id, name, size, block): the block in which each document begins within its source. Blocks are ``block``
    characters long, or a ``most``-th of all if that is more."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("long").alias("size"), (place % parts).alias("part"))
    rows = rows.select("id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "size", "part")  # '' for null
    totals = materialize(rows.groupBy("name", "part").agg(F.sum("size").alias("total")))
    length = totals.agg(F.greatest(F.lit(block), F.ceil(F.sum("total") / most)).cast("long").alias("length"))  # one row
    before = F.sum("total").over(Window.partitionBy("name").orderBy("part")) - F.col("total")  # at most ``parts`` rows a source
    bases = totals.select("name", "part", before.alias("base"))
    within = F.sum("size").over(Window.partitionBy("name", "part").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", within).join(bases, ["name", "part"]).join(F.broadcast(length), F.lit(True))
    return placed.select("id", "name", "size", F.expr("(base + within) div length").alias("block"))


def schedule(shares: list[int], blocks: list[int]) -> tuple[list[int], list[int]]:
    """(source, block) by position: earliest deadline first over ``blocks[i]`` blocks of each source i.

    Source i has the weight shares[i] / sum(shares). Ties go to the source that comes first; where no block is released,
    time goes on to the next release. Takes time and memory in proportion to the number of blocks.
    """
    period, t = sum(shares), 0
    waiting, released = [(0, i, 0) for i, n in enumerate(blocks) if n], []
    names, numbers = [], []
    while waiting or released:
        if not released:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * period // shares[i]), i, j))
        _, i, j = heapq.heappop(released)
        names.append(i)
        numbers.append(j)
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, ((j + 1) * period // shares[i], i, j + 1))
        t += 1
    return names, numbers


def block_positions(sources: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """(name, share, block, position) of every block. ``sources``: name, share (at least 1), blocks; one row a source."""
    known = sorted(tuple(r) for r in sources.select("name", "share", "blocks").collect())
    at, numbers = schedule([r[1] for r in known], [r[2] for r in known])
    spark = sources.sparkSession
    spans = [(a, at[a : a + rows], numbers[a : a + rows]) for a in range(0, len(at), rows)]
    slots = spark.createDataFrame(spans, "first long, at array<int>, numbers array<long>")
    names = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(known)], "i int, name string, share long")
    slots = slots.select("first", F.posexplode(F.arrays_zip("at", "numbers")).alias("k", "slot"))
    slots = slots.select(F.col("slot.at").alias("i"), F.col("slot.numbers").alias("block"), (F.col("first") + F.col("k")).alias("position"))
    return slots.join(names, "i").select("name", "share", "block", "position")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", power: float = 0.7, slots: int = 1000, least: int = 10, block: int = 1 << 16, parts: int = 1024, most: int = 1 << 22) -> DataFrame:
    """One row per input row: id, source, size (characters and one), block (in its source), share (of the source, in slots
    of a round), position (of the block in the mix, 0, 1, ...; a long document takes up several blocks).

    ``weights`` are target weights by source; a source not among them gets 1. Without weights they are the sources'
    total sizes to the power ``power``. A source gets round(slots * weight / sum) slots a round; there are
    ``slots``, or more where the smallest weight would else get fewer than ``least``, so that shares are within
    1 / (2 * least) of the target weights. A weight of 0 gets one slot. No row is left out or repeated. Null is a source
    of its own, and a null text has size 1; texts count whole. Equal ids are ordered by size, repeated rows each have
    their place. No rows give none. A block has ``block`` characters, or a ``most``-th of all if that is more, so the
    driver lays out ``most`` blocks and one a source at most, however small a weight is.
    """
    blocks = materialize(source_blocks(docs, id_col, text_col, source_col, block, parts, most))
    each = blocks.groupBy("name").agg((F.max("block") + 1).alias("blocks"), F.sum("size").cast("double").alias("total"))
    weight = F.pow("total", F.lit(power))
    if weights is not None:
        weight = F.coalesce(F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit("=" + k), F.lit(float(v))))), F.col("name")), F.lit(1.0)) if weights else F.lit(1.0)
    each = each.withColumn("weight", weight)
    total = each.agg(F.sum("weight").alias("all"), F.min(F.when(F.col("weight") > 0, F.col("weight"))).alias("lowest"))
    sources = each.join(F.broadcast(total), F.lit(True)).select("name", "blocks", F.greatest(F.lit(1), F.round(F.greatest(F.lit(slots), F.ceil(least * F.col("all") / F.col("lowest"))) * F.col("weight") / F.col("all"))).cast("long").alias("share"))
    out = blocks.join(materialize(block_positions(sources)), ["name", "block"])
    return out.select(F.col("id").alias(id_col), F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias("source"), "size", "block", "share", "position")


def mixed_order(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, all columns, whatever their names: sorted by position, then id.

    Repeated ids, null ones too, stand together at the first of their places. No rows give none.
    """
    name, position = free_name(docs, "mixed_id"), free_name(docs, "mix_position")
    place = mix_sources(docs, id_col=id_col, **how).groupBy(F.col(id_col).alias(name)).agg(F.min("position").alias(position))
    joined = docs.join(place, F.col(id_col).eqNullSafe(F.col(name)), "left")
    return joined.orderBy(position, id_col).select(*docs.columns)
