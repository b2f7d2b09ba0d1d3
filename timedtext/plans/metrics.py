"""Quality figures of cues against a reference, as plans of joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.intervals import points_inside, uncovered
from ..operators.islands import runs

FOREVER = 10**12


def coverage(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many reference cues (s, e, chars) no candidate overlaps, and the other way round."""
    missed = uncovered(reference, candidate, keys)
    extra = uncovered(candidate, reference, keys)
    total = reference.agg(F.count("*").alias("n_reference"), F.coalesce(F.sum("chars"), F.lit(0)).alias("reference_chars"))
    lost = missed.agg(F.count("*").alias("n_missed"), F.coalesce(F.sum("chars"), F.lit(0)).alias("missed_chars"))
    more = extra.agg(F.count("*").alias("n_extra"))
    # three rows of one each
    return total.crossJoin(lost).crossJoin(more)


def score(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: cues (start, end in ms, text), under 1 s, over 7 s, overlapping the next, over 20 characters a second."""
    seconds = (F.col("end") - F.col("start")) / 1000
    overlap = F.col("end") > F.lead("start").over(W.partitionBy(key).orderBy("idx"))
    fast = F.length("text") / F.greatest(seconds, F.lit(0.001)) > 20
    rows = cues.select(key, seconds.alias("s"), overlap.alias("overlap"), fast.alias("fast"))
    return rows.groupBy(key).agg(
        F.count("*").alias("cues"), F.count_if(F.col("s") < 1).alias("under_1s"), F.count_if(F.col("s") > 7).alias("over_7s"), F.count_if("overlap").alias("overlaps"), F.count_if("fast").alias("cps_over_20")
    )


def silent_gaps(cues: DataFrame, key: str, least_ms: int = 10_000) -> DataFrame:
    """Stretches without a cue, from 0 to the first and from the last on (key, s, e)."""
    w = W.partitionBy(key).orderBy("idx")
    inner = cues.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("s"), F.col("start").alias("e"))
    last = cues.groupBy(key).agg(F.max_by("end", "idx").alias("s"), F.lit(FOREVER).cast("bigint").alias("e"))
    return inner.unionByName(last).filter(F.col("e") - F.col("s") >= least_ms)


def against_reference(cues: DataFrame, reference: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: reference cues (s, e) that are not shown, their share as text, and the speech of those in long silences."""
    shown = cues.select(key, F.col("start").alias("s"), F.col("end").alias("e"))
    missed = uncovered(reference, shown, [key])
    stranded = points_inside(missed.withColumn("at", F.col("s")).withColumn("len", F.col("e") - F.col("s")).drop("s", "e"), silent_gaps(cues, key), [key], "at")
    n = reference.groupBy(key).agg(F.count("*").alias("n_reference"))
    m = missed.groupBy(key).agg(F.count("*").alias("n_missed"))
    s = stranded.groupBy(key).agg(F.sum("len").alias("stranded_ms"))
    out = n.join(m, key, "left").join(s, key, "left").na.fill(0)
    share = F.format_string("%d/%d (%.0f%%)", "n_missed", "n_reference", F.bround(F.col("n_missed") * 100 / F.col("n_reference")))
    return out.withColumn("missed", share)


def verdict_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    return verdicts.groupBy(*keys).pivot("verdict", ["same", "prev", "next", "none", "?"]).count().na.fill(0)


def without_noise(reference: DataFrame, text: str) -> DataFrame:
    """Reference cues of more than one character; the others are stray digits and filler."""
    return reference.filter(F.length(strip(F.col(text))) > 1)


def first_lines(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key, for a report."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def align_report(units: DataFrame, verdicts: DataFrame, least_run: int = 2) -> DataFrame:
    """Per file: its lines, how many have each verdict, and its shifted runs (first, last, direction)."""
    counts = verdict_counts(verdicts, ["file_id"])
    found = runs(verdicts, ["file_id"], "idx", "verdict", ["prev", "next"], least_run)
    listed = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "direction"))).alias("shifted"))
    lines = units.groupBy("file_id").agg(F.count("*").alias("lines"))
    none = F.array().cast("array<struct<first:int,last:int,direction:string>>")
    return lines.join(counts, "file_id", "left").na.fill(0).join(listed, "file_id", "left").withColumn("shifted", F.coalesce("shifted", none))


def joined_reports(*reports: DataFrame) -> DataFrame:
    """Reports of different columns as one table; what a report lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
