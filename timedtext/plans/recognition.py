"""Recognition in windows: from detected speech to segments, window by window, each kept as soon as it is there.

Windows are cut in pauses of the whole file. Those that an earlier run with the same key finished, up to the first one
that differs, are used again. The others are recognised in rounds of ``at_once`` windows of every file, first pass
and gap filling within each window, and every round puts its windows into the keyed table. The segments of all windows
are then put together in the order of windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.folds import plan_windows
from ..operators.intervals import overlap_join
from ..schemas import WORD
from ..streaming.windows import reusable_windows
from .gaps import Recogniser, fill_gaps, recognise
from .storage import kept
from .tables import Table

SEGMENT = {"start": "double", "end": "double", "text": "string", "avg_logprob": "double", "no_speech_prob": "double", "compression_ratio": "double", "words": f"array<{WORD}>", "gap_fill": "boolean"}
_STRUCT = ",".join(f"{c}:{kind}" for c, kind in SEGMENT.items())
SCHEMA = f"file_id string, key string, idx int, a double, b double, segments array<struct<{_STRUCT}>>, holes bigint, seconds double, recovered bigint"


@dataclass
class Heard:
    segments: DataFrame  # (file_id, idx, window, and the columns of SEGMENT)
    windows: DataFrame  # (file_id, idx, a, b, reused)
    stats: DataFrame  # (file_id, windows, reused, holes, seconds, recovered)
    stopped: bool


def window_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, SCHEMA, ["file_id", "key", "idx"])


def speech_in(windows: DataFrame, speech: DataFrame, bucket: int) -> DataFrame:
    """(file_id, window, a, b): the parts of the stretches that lie in each window."""
    spans = windows.select("file_id", F.col("idx").alias("window"), F.col("a").alias("s"), F.col("b").alias("e"))
    met = overlap_join(spans, speech.select("file_id", F.col("a").alias("s"), F.col("b").alias("e")), ["file_id"], bucket=bucket, levels=3)
    return met.select(F.col("l_file_id").alias("file_id"), F.col("l_window").alias("window"), F.greatest("l_s", "r_s").alias("a"), F.least("l_e", "r_e").alias("b"))


def _typed(segments: DataFrame) -> DataFrame:
    return segments.withColumns({c: (F.col(c) if c in segments.columns else F.lit(None)).cast(kind) for c, kind in SEGMENT.items()})


def transcribe(
    speech: DataFrame, ends: DataFrame, recogniser: Recogniser, table: Table, keys: DataFrame, window: float = 600.0, search: float | None = None, bucket: int = 600, at_once: int = 1, gap_fill: bool = True, options: dict | None = None,
    should_stop: Callable[[], bool] = lambda: False, on_progress: Callable[[str, int, int], None] = lambda stage, done, total: None,
) -> Heard:
    """``speech`` (file_id, a, b), ``ends`` (file_id, end) and ``keys`` (file_id, key: what a run is made from) -> segments of all files.

    ``should_stop`` is asked before each round; what is finished by then is kept. ``options`` go to :func:`fill_gaps`.
    """
    windows = kept(plan_windows(speech, ends, window, min(60.0, window / 2) if search is None else search), "windows")
    saved = table.read().join(keys, ["file_id", "key"]).select("file_id", "idx", "a", "b", F.lit(True).alias("has_result"))
    reused = kept(reusable_windows(windows, saved), "windows-reused")
    todo = kept(windows.join(reused, ["file_id", "idx"], "left_anti"), "windows-todo")
    spoken = kept(speech_in(todo, speech, bucket), "windows-speech")
    first, last, n = todo.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
    total, stopped = windows.count(), False
    done = total - n
    for low in range(first or 0, (-1 if last is None else last) + 1, at_once):
        stopped = should_stop()
        if stopped:
            break
        now = todo.filter(F.col("idx").between(low, low + at_once - 1))
        inside = spoken.filter(F.col("window").between(low, low + at_once - 1))
        clips = now.select("file_id", F.col("idx").alias("clip"), "a", "b").withColumn("window", F.col("clip"))
        found = kept(recognise(clips, recogniser, more=("window",)), "windows-found")
        stats = None
        if gap_fill:
            bounds = now.select("file_id", F.col("idx").alias("window"), F.col("a").alias("begin"), F.col("b").alias("end"))
            found, stats = fill_gaps(found, inside, bounds, recogniser, bucket, keys=("file_id", "window"), **(options or {}))
        listed = _typed(found).groupBy("file_id", F.col("window").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*SEGMENT).alias("s")))), lambda x: x["s"]).alias("segments"))
        rows = now.join(keys, "file_id").join(listed, ["file_id", "idx"], "left")
        if stats is not None:
            rows = rows.join(stats.withColumnRenamed("window", "idx"), ["file_id", "idx"], "left")
        else:
            rows = rows.withColumns({"holes": F.lit(0), "seconds": F.lit(0.0), "recovered": F.lit(0)})
        table.put(rows.withColumn("segments", F.coalesce("segments", F.array())).na.fill(0, ["holes", "seconds", "recovered"]).select("file_id", "key", "idx", "a", "b", "segments", F.col("holes").cast("long").alias("holes"), "seconds", F.col("recovered").cast("long").alias("recovered")))
        done += now.count()
        on_progress("transcribe", done, total)
    held = kept(windows.join(table.read().join(keys, ["file_id", "key"]).drop("key"), ["file_id", "idx", "a", "b"]), "windows-held")
    said = held.select("file_id", F.col("idx").alias("window"), F.posexplode("segments").alias("at", "s")).select("file_id", "window", "at", "s.*")
    order = W.partitionBy("file_id").orderBy("window", "at")
    segments = said.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).select("file_id", "idx", "window", *SEGMENT)
    marked = windows.join(reused.select("file_id", "idx", F.lit(True).alias("reused")), ["file_id", "idx"], "left").na.fill(False, ["reused"])
    fresh = held.join(reused.select("file_id", "idx"), ["file_id", "idx"], "left_anti").groupBy("file_id").agg(F.sum("holes").alias("holes"), F.sum("seconds").alias("seconds"), F.sum("recovered").alias("recovered"))
    stats = marked.groupBy("file_id").agg(F.count("*").alias("windows"), F.count_if("reused").alias("reused")).join(fresh, "file_id", "left").na.fill(0)
    return Heard(segments, marked, stats, stopped)
