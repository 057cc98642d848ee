"""A corpus through five of the operators, each stage written as Parquet and read again by the next.

Quality rules, fuzzy line dedup, SimHash near-dedup, mixing of sources to target weights, packing. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapelake.llm.common import materialize
from shapelake.llm.lines import without_repeated_lines
from shapelake.llm.mixing import mixed_order
from shapelake.llm.packing import pack_pieces
from shapelake.llm.quality import keep_good
from shapelake.llm.simhash import keep_one_of_alike


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or are beyond their group's fences, go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; of alike lines the first occurrence stays."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    return keep_one_of_alike(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the rows follow the mix's order, within and across files."""
    return mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, in the order of the rows read."""
    return pack_pieces(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: The stages use a tokenizer file and 64-bit text hashes, which DuckDB lacks; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
