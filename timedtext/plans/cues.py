"""Recogniser segments to cues and units: the composed batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_gap_fragment, is_phantom, round_decimals, strip, to_ms
from ..operators.folds import segment, split_long, to_pieces
from ..operators.islands import clamp_last, gap_groups, repeats


def clean(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): phantom phrases, then one-character gap fills, then loops of one line; dropped rows say why."""
    reason = F.when(is_phantom(F.col("text"), F.col("no_speech_prob")), "phantom phrase").when(is_gap_fragment(F.col("text"), F.col("gap_fill")), "gap-fill fragment")
    marked = segments.withColumn("reason", reason)
    passed = repeats(marked.filter("reason is null"), ["file_id"], "idx", "text")
    kept = passed.filter(~F.col("repeated")).drop("reason", "repeated")
    looped = passed.filter("repeated").withColumn("reason", F.lit("repeated line")).drop("repeated")
    return kept, marked.filter("reason is not null").unionByName(looped)


def shift(segments: DataFrame, offset: Column | float, low: Column | float | None = None, high: Column | float | None = None, slack: float = 0.2) -> DataFrame:
    """Move segments by ``offset`` seconds and, within [low, high], keep only the words there; times are rounded to ms."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    moved = F.transform("words", lambda w: F.struct(round_decimals(w["start"] + offset).alias("start"), round_decimals(w["end"] + offset).alias("end"), w["word"].alias("word"), w["p"].alias("p")))
    rows = segments.withColumn("words", moved).withColumn("start", round_decimals(F.col("start") + offset)).withColumn("end", round_decimals(F.col("end") + offset))
    if low is None or high is None:
        return rows
    rows = rows.withColumn("words", F.filter("words", lambda w: (w["end"] > low - slack) & (w["start"] < high + slack))).filter(F.size("words") > 0)
    text = F.array_join(F.transform("words", lambda w: w["word"]), "")
    return rows.withColumn("start", F.element_at("words", 1)["start"]).withColumn("end", F.element_at("words", -1)["end"]).withColumn("text", text)


def to_cues(segments: DataFrame, max_word_gap: float = 1.0, max_word_s: float = 1.5, max_cue_s: float = 7.0) -> DataFrame:
    """Segments -> cues (file_id, idx, t_ms, dur_ms, ja, segs): cut at long pauses, then long runs, then clamp last words."""
    worded = segments.filter(F.size(F.coalesce("words", F.array().cast(segments.schema["words"].dataType))) > 0)
    words = worded.select("file_id", F.col("idx").alias("seg"), F.posexplode("words").alias("w", "x")).select("file_id", "seg", "w", "x.start", "x.end", "x.word")
    group = ["file_id", "seg", "island"]
    parts = split_long(gap_groups(words, ["file_id", "seg"], "start", "end", max_word_gap, order=["w"]), group, "w", max_cue_s)
    parts = clamp_last(parts, [*group, "part"], "w", "start", "end", max_word_s)
    each = parts.groupBy(*group, "part").agg(F.array_sort(F.collect_list(F.struct("w", "start", "end", "word"))).alias("ws"))
    each = each.withColumn("t_ms", to_ms(F.element_at("ws", 1)["start"])).withColumn("dur_ms", F.greatest(F.lit(1), to_ms(F.element_at("ws", -1)["end"]) - F.col("t_ms")))
    segs = F.transform("ws", lambda w, i: F.struct(F.when(i == 0, F.regexp_replace(w["word"], r"(?U)^\s+", "")).otherwise(w["word"]).alias("text"), to_ms(w["start"]).alias("t_ms")))
    each = each.withColumn("segs", segs).withColumn("ja", F.array_join(F.transform("segs", lambda s: s["text"]), ""))
    plain = segments.join(worded.select("file_id", "idx"), ["file_id", "idx"], "left_anti")
    plain = plain.select("file_id", F.col("idx").alias("seg"), F.lit(0).cast("bigint").alias("island"), F.lit(0).alias("part"), to_ms(F.col("start")).alias("t_ms"), F.greatest(F.lit(1), to_ms(F.col("end")) - to_ms(F.col("start"))).alias("dur_ms"), strip(F.col("text")).alias("ja"), F.lit(None).cast(each.schema["segs"].dataType).alias("segs"))
    both = each.select(*plain.columns).unionByName(plain).filter(strip(F.col("ja")) != "")
    order = W.partitionBy("file_id").orderBy("seg", "island", "part")
    return both.select("file_id", (F.row_number().over(order) - 1).alias("idx"), "t_ms", "dur_ms", "ja", "segs")


def to_transcript(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept, dropped = clean(segments)
    return to_cues(kept), dropped.select("file_id", to_ms(F.col("start")).alias("t_ms"), F.col("text").alias("ja"), "reason")


def to_units(cues: DataFrame, gap_ms: int = 2000, max_chars: int = 64, cue_end_min_chars: int | None = None, drop_tag_only: bool = True, limit: int = 0) -> DataFrame:
    """Cues -> units; a limit keeps each file's first cues, before anything else is done."""
    if limit:
        cues = cues.withColumn("_n", F.row_number().over(W.partitionBy("file_id").orderBy("idx"))).filter(F.col("_n") <= limit).drop("_n")
    return segment(to_pieces(cues, drop_tag_only), gap_ms, max_chars, cue_end_min_chars)
