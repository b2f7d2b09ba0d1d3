"""Transcripts, results and caches as tables; folders of media; blocks of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import media_kind, stem
from ..schemas import TRANSCRIPT

MOST_PARTITIONS, FOLDER_TASKS = "spark.sql.files.maxPartitionNum", 200


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cues, broken): cues of all readable files, and the files that are corrupt or have no cues."""
    docs = spark.read.schema(TRANSCRIPT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    docs = docs.select(F.col("_metadata.file_name").alias("file_id"), "*")
    broken = docs.filter(F.col("cues").isNull()).select("file_id", F.coalesce("_corrupt_record", F.lit("no cues")).alias("reason"))
    cues = docs.filter(F.col("cues").isNotNull()).select("file_id", "source", F.posexplode("cues").alias("idx", "c")).select("file_id", "source", "idx", "c.*")
    return cues, broken


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, stem, kind, size, mtime) of media and transcripts in a folder, in order of name; a transcript beside media of its stem is left out.

    Folders below are not looked into; ``path`` may name several folders by a pattern, each of which is one by itself.
    """
    from ..plans.storage import kept

    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    rows = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), stem(F.col("path")).alias("stem"), media_kind(F.col("path")).alias("kind"), "size", "mtime").filter("kind is not null")
    # contents are not read, so what counts is how many files there are: a bounded number of tasks looks at each once
    own = spark.conf.get(MOST_PARTITIONS, None)
    spark.conf.set(MOST_PARTITIONS, str(FOLDER_TASKS))
    try:
        rows = kept(rows.withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)), "folder")
    finally:
        if own is None:
            spark.conf.unset(MOST_PARTITIONS)
        else:
            spark.conf.set(MOST_PARTITIONS, own)
    media = rows.filter("kind != 'transcript'").select("folder", "stem").distinct()
    out = rows.filter("kind != 'transcript'").unionByName(rows.filter("kind = 'transcript'").join(media, ["folder", "stem"], "left_anti"))
    return out.select("path", "name", "stem", "kind", "size", "mtime").orderBy("name", "path")


def reusable(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Cached results whose source identity and options are all equal to what is wanted."""
    same = [wanted[k].eqNullSafe(cache[k]) for k in ("name", "size", "mtime", *keys)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return cache.join(wanted, condition, "left_semi")


ABOUT = {"source": "string", "backend": "string", "model": "string", "gap_ms": "int", "generated_at": "string", "glossary": "string"}


def _with_about(each: DataFrame, about: DataFrame | None, key: str, wanted: dict[str, str]) -> DataFrame:
    """Join what is known about each file; columns that ``about`` lacks are null."""
    if about is not None:
        each = each.join(about.select(key, *[c for c in wanted if c in about.columns]), key, "left")
    return each.withColumns({c: (F.col(c) if c in each.columns else F.lit(None)).cast(kind) for c, kind in wanted.items()})


def result_document(units: DataFrame, key: str = "file_id", about: DataFrame | None = None) -> DataFrame:
    """One JSON text per file: its title, what ``about`` (key and columns of ``ABOUT``) says, and its units.

    Missing translations are null, and nulls are written. The glossary is JSON already.
    """
    en = F.when(F.coalesce("en", F.lit("")) != "", F.col("en"))
    unit = F.struct("idx", F.col("start_ms").alias("t_ms"), "end_ms", "ja", en.alias("en"))
    each = _with_about(units.groupBy(key).agg(F.array_sort(F.collect_list(unit)).alias("units")), about, key, ABOUT)
    listed = F.transform("units", lambda u: F.struct(u["t_ms"].alias("t_ms"), u["end_ms"].alias("end_ms"), u["ja"].alias("ja"), u["en"].alias("en")))
    document = F.struct(F.col(key).alias("title"), *[c for c in ABOUT if c != "glossary"], F.try_parse_json("glossary").alias("glossary"), listed.alias("units"))
    return each.select(key, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def transcript_document(cues: DataFrame, dropped: DataFrame, about: DataFrame, key: str = "file_id") -> DataFrame:
    """One JSON text per file in ``about`` (key, duration_s, source, captured_at), as :func:`read_transcripts` reads it; a file may be without cues."""
    said = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.struct("t_ms", "dur_ms", "ja", "segs").alias("cue")))).alias("cues"))
    gone = dropped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t_ms", "ja", "reason"))).alias("dropped"))
    each = about.join(said, key, "left").join(gone, key, "left")
    each = each.withColumn("cues", F.coalesce(F.transform("cues", lambda c: c["cue"]), F.array())).withColumn("dropped", F.coalesce("dropped", F.array()))
    return each.select(key, F.to_json(F.struct(F.col(key).alias("title"), "duration_s", "source", "captured_at", F.size("cues").alias("cue_count"), "cues", "dropped")).alias("document"))


def recogniser_document(segments: DataFrame, windows: DataFrame, about: DataFrame, key: str = "file_id") -> DataFrame:
    """One JSON text per file in ``about`` (key and any further columns): its windows and segments in order."""
    spans = windows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "a", "b"))), lambda w: F.array(w["a"], w["b"])).alias("windows"))
    columns = [c for c in segments.columns if c not in (key, "idx", "window")]
    said = segments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*columns).alias("s")))), lambda x: x["s"]).alias("segments"))
    each = about.join(spans, key, "left").join(said, key, "left").withColumn("segments", F.coalesce("segments", F.array()))
    return each.select(key, F.to_json(F.struct(*[c for c in about.columns if c != key], "windows", "segments")).alias("document"))


def blocks_of(samples: Column, block: int) -> Column:
    """Fixed slices of an array, the last one shorter."""
    n = F.size(samples)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(block)), lambda i: F.slice(samples, i + 1, F.lit(block)))).otherwise(F.array().cast("array<array<float>>"))


def reblock(chunks: DataFrame, block: int, rate: int = 16000) -> DataFrame:
    """(file_id, chunk, samples) of any sizes -> (file_id, block_no, t0, samples) of exactly ``block`` samples, the last shorter."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_id").orderBy("chunk")
    at = chunks.withColumn("_at", F.coalesce(F.sum(F.size("samples")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = at.select("file_id", "_at", F.posexplode("samples").alias("p", "x")).withColumn("n", F.col("_at") + F.col("p"))
    each = rows.groupBy("file_id", F.floor(F.col("n") / block).alias("block_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("samples"))
    return each.select("file_id", "block_no", (F.col("block_no") * block / rate).alias("t0"), "samples")


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / 32768.0).cast("float"))
