"""Gaps and islands: groups that depend on neighbouring rows only, as pure windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def islands(df: DataFrame, keys: list[str], order: list[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the groups of a key; ``starts`` is true where a row does not go on with the one before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")


def gap_groups(df: DataFrame, keys: list[str], start: str, end: str, gap, order: list[str] | None = None) -> DataFrame:
    """A row opens a group when it starts more than ``gap`` after the end of the row before."""
    order = order or [start]
    w = W.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, F.col(start) - F.lag(end).over(w) > gap)


def stitch(df: DataFrame, keys: list[str], start: str = "a", end: str = "b", under: float = 0.05) -> DataFrame:
    """Join stretches that are less than ``under`` apart."""
    w = W.partitionBy(*keys).orderBy(start)
    grouped = islands(df, keys, [start], F.col(start) - F.lag(end).over(w) >= under)
    return grouped.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def runs(df: DataFrame, keys: list[str], order: str, value: str, wanted: list[str] | None = None, least: int = 2) -> DataFrame:
    """(keys, first, last, direction, length) of maximal runs of one value."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = islands(df, keys, [order], F.lag(value).over(w) != F.col(value))
    out = marked.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias("direction"), F.count("*").alias("length"))
    out = out.filter(F.col("length") >= least).drop("island")
    return out.filter(F.col("direction").isin(*wanted)) if wanted else out


def repeats(df: DataFrame, keys: list[str], order: str, text: str, least_run: int = 3, least_chars: int = 6) -> DataFrame:
    """Adds ``repeated``: true for all but the first of a long run of one long line."""
    bare = strip(F.col(text))
    w = W.partitionBy(*keys).orderBy(order)
    marked = islands(df.withColumn("_bare", bare), keys, [order], F.lag("_bare").over(w) != F.col("_bare"))
    inside = W.partitionBy(*keys, "island")
    again = (F.count("*").over(inside) >= least_run) & (F.length("_bare") >= least_chars) & (F.row_number().over(inside.orderBy(order)) > 1)
    return marked.withColumn("repeated", again).drop("_bare", "island")


def clamp_last(df: DataFrame, keys: list[str], order: str, start: str, end: str, most) -> DataFrame:
    """The last row of each group ends at most ``most`` after it starts."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc())) == 1
    return df.withColumn(end, F.when(last, F.least(F.col(end), F.col(start) + most)).otherwise(F.col(end)))


def flag_margin(found: DataFrame, keys: list[str], n: str, margin: int = 2) -> DataFrame:
    """(keys, idx): every index within ``margin`` of a run, inside [0, n), once."""
    spread = F.sequence(F.greatest(F.lit(0), F.col("first") - margin), F.least(F.col(n) - 1, F.col("last") + margin))
    return found.select(*keys, F.explode(spread).alias("idx")).distinct()
