"""Interval algebra. Overlap joins go by time buckets, so they are equi-joins and never nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cuts import may_cut, pause_point
from .islands import islands

SLICE_ROWS, SLICE_BYTES = 1_000_000, 256 << 20
STEP = 64


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "s", end: str = "e", bucket: int = 300_000, levels: int = 1) -> DataFrame:
    """Pairs with ``l.s < r.e and l.e > r.s``; columns come back as l_* and r_*.

    Both sides are laid into the buckets that they touch. Where intervals may be very long, more ``levels`` of buckets bound how many
    these are: on each level they are ``STEP`` times as wide as on the one below, and an interval of more than ``STEP``
    buckets is laid into a wider level. Every interval is laid into its own level and the wider ones. A pair is kept in the
    first bucket that it shares on the wider of its two levels. Columns must not be null; an interval of no length still
    overlaps one that it lies inside of.
    """
    length = (F.col(end) - F.col(start)) / bucket
    level = F.when(length > STEP, F.least(F.ceil(F.log(float(STEP), length)) - 1, F.lit(levels - 1))).otherwise(0) if levels > 1 else F.lit(0)

    def laid(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns], *keys, level.cast("int").alias(f"{side}_level"))
        named = named.withColumn("level", F.explode(F.sequence(F.col(f"{side}_level"), F.lit(levels - 1))) if levels > 1 else F.lit(0))
        width = bucket * F.pow(F.lit(float(STEP)), F.col("level")) if levels > 1 else F.lit(bucket)
        first = F.floor(F.col(f"{side}_{start}") / width)
        # the last bucket that holds a point before the end
        last = F.greatest(first, F.ceil(F.col(f"{side}_{end}") / width) - 1)
        return named.withColumns({f"{side}_first": first, "bucket": F.explode(F.sequence(first, last))})

    both = laid(left, "l").join(laid(right, "r"), [*keys, "level", "bucket"] if levels > 1 else [*keys, "bucket"])
    if levels == 1:
        both = both.drop("level")
    meets = (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"l_{end}") > F.col(f"r_{start}"))
    once = F.col("bucket") == F.greatest("l_first", "r_first")
    if levels > 1:
        once &= F.col("level") == F.greatest("l_level", "r_level")
    return both.filter(meets & once).drop("bucket", "level", "l_first", "r_first", "l_level", "r_level", *keys)


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _latest_end(left: DataFrame, at: Column, right: DataFrame, keys: list[str], start: str, end: str, equal: bool, slice_rows: int | None) -> DataFrame:
    """``left`` with ``_latest``: the largest end of the key's right rows that start before ``at`` (or, with ``equal``, at it).

    Nothing is paired: one sorted sweep over both sides carries the latest end on. A key of more than ``slice_rows`` rows is cut into
    slices of time, so it is many tasks: the largest end of each slice is carried on over the slices of its key, one row
    each, and comes into a slice as its first row. Where no number is given and both sides are estimated at so few bytes that one
    task can sort them all, there are no slices; else a slice has about ``SLICE_ROWS`` rows.
    """
    whole = slice_rows is None and _estimated_bytes(left) + _estimated_bytes(right) <= SLICE_BYTES
    slice_rows = slice_rows or SLICE_ROWS
    none = F.lit(None).cast(right.schema[end].dataType)
    rows = left.select("*", at.alias("_at"), F.lit(0 if equal else -1).alias("_side"), none.alias("_end"), F.lit(True).alias("_left"))
    kind = rows.schema["_at"].dataType
    marks = right.select(*keys, F.col(start).cast(kind).alias("_at"), F.lit(-1 if equal else 0).alias("_side"), F.col(end).alias("_end"), F.lit(False).alias("_left"))
    if whole:
        over = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
        swept = rows.unionByName(marks, allowMissingColumns=True).withColumn("_latest", F.max("_end").over(over))
        return swept.filter("_left").drop("_at", "_side", "_end", "_left")
    places = rows.select(*keys, "_at").unionByName(marks.select(*keys, "_at")).groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    # at most one for so many rows
    large = places.filter((F.col("_n") > slice_rows) & (F.col("_high") > F.col("_low"))).select(*keys, "_low", ((F.col("_high") - F.col("_low")) / F.ceil(F.col("_n") / slice_rows)).alias("_width"))
    slice_ = F.floor((F.col("_at") - F.col("_low")) / F.col("_width"))
    both = rows.unionByName(marks, allowMissingColumns=True).join(large, keys, "left").withColumn("_slice", F.coalesce(slice_, F.lit(0))).drop("_low", "_width")
    tops = marks.join(large, keys).groupBy(*keys, slice_.alias("_slice")).agg(F.max("_end").alias("_end"))
    asked = rows.join(large, keys).select(*keys, slice_.alias("_slice")).distinct().withColumn("_end", none)
    over = W.partitionBy(*keys).orderBy("_slice")
    carried = tops.unionByName(asked).groupBy(*keys, "_slice").agg(F.max("_end").alias("_end")).withColumn("_end", F.max("_end").over(over.rowsBetween(W.unboundedPreceding, -1))).filter("_end is not null")
    # before all rows of its slice
    firsts = carried.select(*keys, "_slice", F.lit(None).cast(kind).alias("_at"), F.lit(-2).alias("_side"), "_end", F.lit(False).alias("_left"))
    so_far = W.partitionBy(*keys, "_slice").orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
    swept = both.unionByName(firsts, allowMissingColumns=True).withColumn("_latest", F.max("_end").over(so_far))
    return swept.filter("_left").drop("_at", "_side", "_end", "_left", "_slice")


def uncovered(left: DataFrame, right: DataFrame, keys: list[str], start: str = "s", end: str = "e", slice_rows: int | None = None) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` overlaps (anti join).

    A row is overlapped where, of all that start before its end, the latest end lies behind its start. Keys of very many rows are swept in slices.
    """
    swept = _latest_end(left, F.col(end), right, keys, start, end, equal=False, slice_rows=slice_rows)
    return swept.filter(~F.coalesce(F.col("_latest") > F.col(start), F.lit(False))).drop("_latest")


def points_inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "s", end: str = "e", slice_rows: int | None = None) -> DataFrame:
    """Rows whose ``at`` lies in a span, ``start <= at < end`` (semi join)."""
    swept = _latest_end(points, F.col(at), spans, keys, start, end, equal=True, slice_rows=slice_rows)
    return swept.filter(F.col("_latest") > F.col(at)).drop("_latest")


def find_holes(speech: DataFrame, words: DataFrame, keys: list[str], margin: Column | float, bucket: int, slice_rows: int | None = None) -> DataFrame:
    """Parts of speech [a, b] farther than ``margin`` from any word (a, b): rows (keys, sp, a, b); ``sp`` is the stretch's start.

    A sweep over the words tells the silences between them, which do not overlap, so every pair of a stretch and a silence is a hole.
    """
    wide = words.select(*keys, (F.col("a") - margin).alias("s"), (F.col("b") + margin).alias("e")).groupBy(*keys, "s").agg(F.max("e").alias("e"))
    swept = _latest_end(wide, F.col("s"), wide, keys, "s", "e", equal=False, slice_rows=slice_rows)
    inner = swept.filter(F.col("_latest") < F.col("s")).select(*keys, F.col("_latest").alias("s"), F.col("s").alias("e"))
    heard = wide.groupBy(*keys).agg(F.min("s").alias("first"), F.max("e").alias("last"))
    spans = speech.groupBy(*keys).agg(F.min("a").alias("low"), F.max("b").alias("high")).join(heard, keys, "left")
    edge = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    outer = spans.select(*keys, F.inline(F.array(edge(F.col("low"), F.coalesce("first", "high")), edge(F.coalesce("last", "high"), F.col("high"))))).filter("s < e")
    met = overlap_join(speech.select(*keys, F.col("a").alias("s"), F.col("b").alias("e")), inner.unionByName(outer), keys, bucket=bucket, levels=3)
    return met.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_s").alias("sp"), F.greatest("l_s", "r_s").alias("a"), F.least("l_e", "r_e").alias("b"))


def merge_close(holes: DataFrame, keys: list[str], least, merge) -> DataFrame:
    """Drop what is shorter than ``least``, then join what is less than ``merge`` apart."""
    long = holes.filter(F.col("b") - F.col("a") >= least)
    w = W.partitionBy(*keys).orderBy("a", "b")
    grouped = islands(long, keys, ["a", "b"], F.col("a") - F.lag("b").over(w) >= merge)
    return grouped.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max_by("b", F.struct("a", "b")).alias("b")).drop("island")


def complement(speech: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between, before and after the stretches, up to each key's ``end`` (from ``ends``)."""
    w = W.partitionBy(*keys).orderBy("a", "b")
    rows = ends.join(speech, keys, "left").withColumn("before", F.coalesce(F.lag("b").over(w), F.lit(0)))
    gaps = rows.select(*keys, F.col("before").alias("a"), F.coalesce("a", "end").alias("b"))
    last = rows.filter("b is not null").groupBy(*keys).agg(F.max_by("b", F.struct("a", "b")).alias("a"), F.first("end").alias("b"))
    return gaps.unionByName(last).filter("b > a")


def choose_cut(gaps: DataFrame, marks: DataFrame, keys: list[str], search, least_after, margin) -> DataFrame:
    """Per mark (keys, mark, after) the point inside a gap nearest to it, at least ``margin`` from either side; else the mark.

    Marks meet only gaps in reach. A gap is laid into buckets that are as wide as itself, twice the search range at least and a
    power of two times that, so it touches two at most. A mark looks into the one or two buckets around it of every width that its key has.
    """
    width = lambda level: F.lit(2.0 * search) * F.pow(F.lit(2.0), level)
    touched = lambda low, high: F.explode(F.array_distinct(F.array(F.floor(low / width(F.col("_level"))), F.floor(high / width(F.col("_level"))))))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("b") - F.col("a")) / (2.0 * search)))).cast("int")
    sized = gaps.withColumn("_level", F.coalesce(level, F.lit(0)))
    laid = sized.withColumn("_bucket", touched(F.col("a"), F.col("b")))
    levels = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    asked = marks.join(levels, keys, "left").withColumn("_level", F.explode(F.coalesce("_levels", F.array(F.lit(0))))).drop("_levels")
    asked = asked.withColumn("_bucket", touched(F.col("mark") - search, F.col("mark") + search))
    met = asked.join(laid, [*keys, "_level", "_bucket"], "left")
    t = pause_point(F.col("a"), F.col("b"), F.col("mark"), margin)
    good = F.col("a").isNotNull() & may_cut(t, F.col("mark"), F.col("after"), search, least_after)
    # of equally near ones the earlier gap's
    best = met.groupBy(*keys, "mark", "after").agg(F.min(F.when(good, F.struct(F.abs(t - F.col("mark")).alias("far"), F.col("a"), t.alias("cut")))).alias("best"))
    return best.select(*keys, "mark", "after", F.coalesce("best.cut", "mark").alias("cut"))


def pad_and_clip(df: DataFrame, pad, low: Column, high: Column) -> DataFrame:
    return df.withColumn("a", F.greatest(F.col("a") - pad, low)).withColumn("b", F.least(F.col("b") + pad, high))


def clip(df: DataFrame, low, high) -> DataFrame:
    """The parts inside [low, high]."""
    return df.filter((F.col("b") > low) & (F.col("a") < high)).withColumn("a", F.greatest(F.col("a"), F.lit(low))).withColumn("b", F.least(F.col("b"), F.lit(high)))
