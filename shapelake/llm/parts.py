"""Scoring rows with a table too large to broadcast: rows are dealt to parts, and each part meets the entries it needs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import join_skewed
from .common import materialize, ship


def scored_in_parts(rows: DataFrame, size: Column, most: int, keys_of: Callable, entries: DataFrame, score: Callable, schema) -> DataFrame:
    """``score(rows of a part, entries of its keys)`` for parts of ``rows`` with about ``most`` of ``size`` each.

    ``keys_of`` gives the 64-bit keys of a part's rows as an array without repeats; ``entries`` is unique by its bigint
    column ``key``. The parts are written once, so that a lost executor doesn't deal them anew. A key that many parts
    need is joined by broadcast. A part holds one row at least, whatever its size; no rows give none.
    """
    ship(rows.sparkSession)
    parts = max(1, -(-int(rows.agg(F.sum(size)).first()[0] or 0) // most))
    dealt = materialize(rows.withColumn("__part", F.floor(F.rand(0) * parts)))

    def wanted(part: pa.Table) -> pa.Table:
        key = keys_of(part)
        return pa.table({"__part": pa.array([part.column("__part")[0].as_py()] * len(key), pa.int64()), "key": pa.array(key, pa.int64())})

    keys = materialize(dealt.groupBy("__part").applyInArrow(wanted, "__part long, key long"))
    known = materialize(entries.join(keys.groupBy("key").agg(F.count("*").alias("rows")), "key"))
    own = join_skewed(keys, known, ["key"])
    return dealt.groupBy("__part").cogroup(own.groupBy("__part")).applyInArrow(lambda part, table: score(part.drop_columns("__part"), table), schema)
