"""When lines are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip

CHARS_PER_S, LEAST_S, MOST_S = 17, 1.0, 7.0
CLOSE_MS, FRAME_MS = 250.0, 83.0


def display_times(units: DataFrame, key: str = "file_id", order: str = "idx", text: str = "en") -> DataFrame:
    """Adds show_start_ms and show_end_ms, null where there is no text: long enough to read, no flicker, no overlap."""
    shown = F.coalesce(strip(F.col(text)), F.lit("")) != ""
    rows = units.withColumn("_shown", shown)
    following = F.lead("start_ms").over(W.partitionBy(key, "_shown").orderBy(order))
    start = F.col("start_ms")
    wanted = F.greatest(F.lit(LEAST_S), F.length(squeeze(F.col(text))) / CHARS_PER_S) * 1000
    rows = rows.withColumn("_end", F.greatest(F.greatest("end_ms", start + 1).cast("double"), start + F.least(wanted, F.lit(MOST_S * 1000)))).withColumn("_limit", following - FRAME_MS)
    end = F.when(F.col("_limit").isNull(), F.col("_end")).when(F.col("_limit") + FRAME_MS - F.col("_end") < CLOSE_MS, F.col("_limit")).otherwise(F.least("_end", "_limit"))
    end = F.bround(F.greatest(end, start + 1)).cast("bigint")
    return rows.withColumn("show_start_ms", F.when(F.col("_shown"), start)).withColumn("show_end_ms", F.when(F.col("_shown"), end)).drop("_shown", "_end", "_limit")


def stretch(cues: DataFrame, key: str = "file_id", order: str = "idx", least_ms: int = 700) -> DataFrame:
    """Adds end_ms: at least ``least_ms`` on screen, up to the next cue's start, and never before start + 1."""
    following = F.lead("t_ms").over(W.partitionBy(key).orderBy(order))
    end = F.greatest(F.col("t_ms") + F.col("dur_ms"), F.col("t_ms") + least_ms)
    return cues.withColumn("end_ms", F.greatest(F.least(end, F.coalesce(following, end)), F.col("t_ms") + 1))
