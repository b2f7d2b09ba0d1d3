"""Recognition in windows, and a second pass over speech that the first left without words.

A recogniser is injected: clips (file_id, clip, a, b) -> segments (file_id, clip, start, end, text, words)
with times from the clip's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.intervals import find_holes, merge_close, pad_and_clip
from .cues import shift
from .storage import kept

Recogniser = Callable[[DataFrame], DataFrame]
MARGIN, LEAST_HOLE, MERGE, PAD, SLACK = 0.5, 1.0, 2.0, 1.0, 0.2


def recognise(clips: DataFrame, recogniser: Recogniser, low: str | None = None, high: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Segments of all clips in file time; with ``low`` and ``high`` (columns of ``clips``) only the words between them.

    ``more`` names columns of ``clips`` that segments keep.
    """
    bounds = [c for c in (low, high) if c]
    found = recogniser(clips.select("file_id", "clip", "a", "b")).join(clips.select("file_id", "clip", F.col("a").alias("_from"), *bounds, *more), ["file_id", "clip"])
    return shift(found, F.col("_from"), F.col(low) if low else None, F.col(high) if high else None, SLACK).drop("_from", *bounds)


def in_order(segments: DataFrame, *order: str) -> DataFrame:
    """Segments numbered by start; equal starts keep the given order."""
    w = W.partitionBy("file_id").orderBy("start", *order)
    return segments.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def fill_gaps(
    segments: DataFrame, speech: DataFrame, ends: DataFrame, recogniser: Recogniser, bucket: int = 600, margin: float = MARGIN, least: float = LEAST_HOLE, merge: float = MERGE, pad: float = PAD, keys: tuple[str, ...] = ("file_id",)
) -> tuple[DataFrame, DataFrame]:
    """(segments with those of the second pass, stats): speech without words is recognised again, ``pad`` seconds wider.

    Clips stay within ``begin`` (0 if there is none) and ``end`` of ``ends``. ``keys`` are the file and, where its windows are
    filled one by one, the window. stats: (keys, holes, seconds, recovered).
    """
    words = segments.select(*keys, F.explode("words").alias("w")).select(*keys, F.col("w.start").alias("a"), F.col("w.end").alias("b"))
    # tables, as both are read more than once
    holes = kept(merge_close(find_holes(speech, words, list(keys), F.lit(margin), bucket), list(keys), least, merge), "gap-holes")
    numbered = holes.withColumn("clip", F.row_number().over(W.partitionBy("file_id").orderBy("a", "b"))).withColumns({"low": F.col("a"), "high": F.col("b")})
    begin = F.col("begin") if "begin" in ends.columns else F.lit(0.0)
    clips = pad_and_clip(numbered.join(ends, list(keys)), pad, begin, F.col("end")).drop("begin", "end")
    found = kept(recognise(clips, recogniser, "low", "high", keys[1:]).withColumn("gap_fill", F.lit(True)), "gap-found")
    both = segments.withColumn("_pass", F.lit(0)).unionByName(found.withColumn("_pass", F.lit(1)), allowMissingColumns=True)
    out = in_order(both, "_pass", "clip", "idx").drop("_pass", "clip")
    stats = holes.groupBy(*keys).agg(F.count("*").alias("holes"), F.sum(F.col("b") - F.col("a")).alias("seconds"))
    recovered = found.groupBy(*keys).agg(F.count("*").alias("recovered"))
    return out, stats.join(recovered, list(keys), "left").na.fill(0, ["recovered"])
