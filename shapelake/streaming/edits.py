"""Label edits: the latest label of each (annotator, item), in a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_labels(edits: DataFrame) -> DataFrame:
    """(annotator, item, label, ts): order-free, so late edits with an older ts lose; state is one row a key."""
    return edits.groupBy("annotator", "item").agg(F.max_by("label", F.struct("ts", "label")).alias("label"), F.max("ts").alias("ts"))


def start_latest_labels(edits: DataFrame, name: str, checkpoint: str):
    """The same over a streaming DataFrame, in update mode, to a memory table."""
    return latest_labels(edits).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
