"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target number of words; every document of a source gets an expected number of
copies, proportional to ``size ** exponent`` and never above ``max_copies``. The whole part of that
number is taken for certain. The rest is an inclusion probability p; documents are ranked by their
random odds over their inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the lowest ranks are
taken until the words still missing from the target are reached (the last one only where that comes
nearer). ``u`` is a hash of ``doc_id``, text and the seed, so reruns agree.

No source is ever gathered in one task: ranks are first counted in ``RANGES`` ranges of the rank's
value per source; the range in which a source's sample ends is cut into ranges again, until it holds at most
``EDGE_ROWS`` rows, and only these are looked at one by one.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 are never taken; rows that share a doc_id, or have none, are drawn each for itself
unless their texts are equal too, then they are taken or left together; an empty table gives an empty result; columns that are not needed are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, finish, scratch, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANGES, EDGE_ROWS = 4096, 1_000_000
FINEST = 1 << 48  # ranks that agree to so many parts are not told apart by ranges
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(no_source, src, source_size)`` -> the same with ``target``.

    All sizes together are shared by weight; where that is above ``max_copies`` times a source's
    size, the excess goes to the others by weight. That is one water level L with
    ``target = least(cap, L * weight)``; with sources sorted by cap / weight, L follows from running
    sums. One row per source is all that this window sees.
    """
    by_name = W.orderBy("no_source", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "src")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - before) / after)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the first source, in order of level, whose share is under its cap sets the water level
    rows = rows.withColumn("water", F.max(fits).over(every))
    return rows.select("no_source", "src", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _rates(sized: DataFrame, sources: DataFrame, exponent: float, max_copies: int) -> DataFrame:
    """Per source the factor k with which ``least(max_copies, k * size ** exponent)`` copies make its target.

    The sums run over the distinct sizes of a source, not over its documents.
    """
    hist = sized.filter("size > 0").groupBy("no_source", "src", "size").agg(F.count("*").alias("n"))
    hist = hist.join(sources, ["no_source", "src"]).withColumn("lean", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    words = F.col("n") * F.col("size")
    down = W.partitionBy("no_source", "src").orderBy(F.col("lean").desc(), F.col("size").desc())
    full = F.coalesce(F.sum(words).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * max_copies
    rest = F.sum(words * F.col("lean")).over(down.rowsBetween(0, W.unboundedFollowing))
    hist = hist.withColumn("rate", (F.col("target") - full) / rest)
    fits = F.when(F.col("rate") * F.col("lean") <= max_copies, F.col("rate"))
    return hist.groupBy("no_source", "src", "source_size", "target").agg(F.max(fits).alias("rate"))


def _drawn(df: DataFrame, exponent: float, max_copies: int, seed: int) -> DataFrame:
    """Adds ``whole`` (certain copies), ``rank`` (null where nothing is left to draw) and ``span`` (range of ranks)."""
    copies = F.when(F.col("size") > 0, F.least(F.lit(float(max_copies)), F.coalesce(F.col("rate") * F.pow(F.col("size").cast("double"), F.lit(exponent)), F.lit(float(max_copies))))).otherwise(0.0)
    df = df.withColumn("whole", F.floor(copies + 1e-9).cast("long")).withColumn("p", copies - F.col("whole"))
    u = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 48)) + 0.5) / float(1 << 48)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    df = df.withColumn("rank", F.when(F.col("p") > 1e-9, odds / (1 + odds)))
    return df.withColumn("span", F.floor(F.col("rank") * RANGES))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, exponent: float = 0.25, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(sized, plan)``: the narrow table of document sizes, and one row per source with what decides for its documents.

    A document's copies then follow from its own row and its source's row, see :func:`copies`.
    """
    key = [F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source"), F.lit("")).alias("src")]
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    sources = cut(targets(sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size")), weights, max_copies), "mix-targets")
    rates = sources.join(_rates(sized, sources, exponent, max_copies).select("no_source", "src", "rate"), ["no_source", "src"], "left")
    rates = cut(rates, "mix-rates")
    drawn = _drawn(sized.join(rates, ["no_source", "src"]), exponent, max_copies, seed)

    # words by source and range of ranks; the certain copies count in a range before all others
    counted = drawn.groupBy("no_source", "src", F.coalesce("span", F.lit(-1)).alias("span")).agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words"))
    each = W.partitionBy("no_source", "src")
    counted = counted.join(sources, ["no_source", "src"])
    counted = counted.withColumn("missing", F.col("target") - F.sum("certain").over(each))
    up_to = F.coalesce(F.sum("words").over(each.orderBy("span").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    counted = counted.withColumn("before", up_to - F.coalesce("words", F.lit(0))).withColumn("up_to", up_to)
    ends = counted.filter("words is not null and before < missing and up_to >= missing").select("no_source", "src", F.col("span").alias("end_span"), "before", "missing")

    # the range where the sample ends is cut into ranges again, until few enough rows are left in it to be looked at one by one
    name, scale = ["no_source", "src"], RANGES
    narrow = ends.withColumnRenamed("end_span", "place")
    while True:
        edge = cut(drawn.join(narrow, name).filter(F.floor(F.col("rank") * scale) == F.col("place")), "mix-edge")
        most = edge.groupBy(*name).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= EDGE_ROWS or scale >= FINEST:
            break
        scale *= RANGES
        inner = edge.groupBy(*name, F.floor(F.col("rank") * scale).alias("place")).agg(F.sum("size").alias("words"), F.first("before").alias("low"), F.first("missing").alias("missing"))
        inner = inner.withColumn("up_to", F.col("low") + F.sum("words").over(W.partitionBy(*name).orderBy("place").rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("up_to") - F.col("words"))
        narrow = cut(inner.filter("before < missing and up_to >= missing").select(*name, "place", "before", "missing"), "mix-narrow")

    along = W.partitionBy(*name).orderBy("rank", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.sum("size").over(along) + F.col("before"))
    last = edge.filter(F.col("run") - F.col("size") / 2 <= F.col("missing")).groupBy(*name).agg(F.max(F.struct("rank", "doc_id", "text_hash")).alias("found"))
    # where no row of the range is taken, all before it are
    below = narrow.select(*name, F.struct((F.col("place") / scale).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash")).alias("below"))
    plan = (
        rates.join(counted.groupBy(*name).agg(F.max("missing").alias("missing"), F.max("up_to").alias("open_words")), name, "left")
        .join(ends.select(*name, "end_span"), name, "left")
        .join(last, name, "left")
        .join(below, name, "left")
        .withColumn("last", F.coalesce("found", "below"))
        .drop("found", "below")
    )
    return sized, cut(plan, "mix-plan")


def copies(rows: DataFrame, plan: DataFrame, max_copies: int = MAX_COPIES, exponent: float = 0.25, seed: int = 17) -> DataFrame:
    """Join ``rows`` (doc_id, no_source, src, size, text_hash and anything else) with their source's plan; adds ``n_copies``."""
    df = _drawn(rows.join(plan, ["no_source", "src"]), exponent, max_copies, seed)
    here = F.struct("rank", "doc_id", "text_hash")
    picked = F.when(F.col("rank").isNull(), False).when(F.col("end_span").isNull(), F.col("open_words") <= F.col("missing")).when(F.col("span") != F.col("end_span"), F.col("span") < F.col("end_span")).otherwise(F.coalesce(here <= F.col("last"), F.lit(False)))
    return df.withColumn("n_copies", F.col("whole") + F.coalesce(picked, F.lit(False)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, with its own columns."""
    with scratch(docs.sparkSession):
        plan = finish(plan_mix(docs, **options)[1], "mix-plan")
    rest = {k: v for k, v in options.items() if k != "weights"}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source"), F.lit("")).alias("src"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    taken = copies(keyed, plan, **rest).filter("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        sized, plan = plan_mix(table(spark, sf_dir, "documents"))
        return finish(copies(sized, plan).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("n_copies") * F.col("size")).alias("taken")), "mix-taken")
