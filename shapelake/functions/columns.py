"""Columns that are worked out once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, as one generated row for each of its rows.

    Filters move down through a projection and take a copy of its expressions with them, one for each mention; they don't
    move through a generator. For long expressions that several filters use.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by ``keys`` to as many tasks as a shuffle has partitions, before work that a few bytes a row say little of:
    partitions that an adaptive plan would merge for their size stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_sort(df: DataFrame) -> DataFrame:
    """df, for a join of two large tables: they are shuffled and sorted, neither is broadcast.

    Spark takes rows made by a generator, and those of well compressed files, for a small part of what they are, and
    would send whole tables of vertices or faces through the driver.
    """
    return df.hint("merge")
