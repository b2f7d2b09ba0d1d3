"""Chunks of units with read-only context before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunk(units: DataFrame, size: int = 20, before: int = 10, after: int = 6, text: str = "ja", key: str = "file_id", order: str = "idx") -> DataFrame:
    """(key, chunk, first_unit, before, target, after); the context crosses chunk borders and is cut at the file's ends."""
    w = W.partitionBy(key).orderBy(order)
    rows = units.withColumn("_pos", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("_pos") / size).cast("int"))
    rows = rows.withColumn("_before", F.collect_list(text).over(w.rowsBetween(-before, -1))).withColumn("_after", F.collect_list(text).over(w.rowsBetween(1, after)))
    out = rows.groupBy(key, "chunk").agg(
        F.min("_pos").alias("first_unit"),
        F.min_by("_before", "_pos").alias("before"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", text))), lambda x: x[text]).alias("target"),
        F.max_by("_after", "_pos").alias("after"),
    )
    return out
