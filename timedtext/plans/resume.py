"""Translation that outlives its job: what was answered is put into a keyed table, batch by batch.

A file's rows stand under the key of what they were made from: its lines, their times, the model and the options. Rows
under another key are not looked at, and go when the file is done. The analysis is asked for once, chunks of lines come as a
stream of micro-batches, and each batch puts in its lines when they are there, so an interruption costs a
batch. Files without missing lines are taken out at the end; the others stay, so a rerun asks for their missing lines alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_of
from .model import Backend, analyse, answers, frames_of, with_lines
from .storage import kept, shared_path
from .tables import Table

SCHEMA, KEYS = "file_id string, key string, idx int, answer string", ["file_id", "key", "idx"]
GLOSSARY = -1  # the place under which a file's analysis stands


def checkpoint_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, SCHEMA, KEYS)


def work_keys(units: DataFrame, model: str, size: int, echo: bool) -> DataFrame:
    """(file_id, key). Lines are hashed by chunk and chunks by file, so no row holds a file's whole text."""
    line = F.struct("idx", "ja", "start_ms")
    chunks = units.groupBy("file_id", F.floor(F.col("idx") / size).alias("chunk")).agg(key_of(F.array_sort(F.collect_list(line))).alias("digest"))
    files = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "digest"))).alias("chunks"))
    return files.select("file_id", key_of(F.col("chunks"), F.lit(model), F.lit(size), F.lit(echo)).alias("key"))


class Resumed:
    """What a run found, asked and left."""

    def __init__(self, units: DataFrame, glossary: DataFrame, failures: DataFrame, asked: DataFrame, stopped: bool):
        self.units, self.glossary, self.failures = units, glossary, failures
        self.asked = asked  # (file_id, idx) that this run put to the model
        self.stopped = stopped


def translate_kept(
    units: DataFrame, backend: Backend, analyst: Backend, table: Table, model: str = "", known: DataFrame | None = None, echo: bool = True, size: int = 20, batches: int = 16, in_flight: int = 1,
    should_stop: Callable[[], bool] = lambda: False, on_progress: Callable[[str, int, int], None] = lambda stage, done, total: None,
) -> Resumed:
    """Translate what ``table`` does not hold yet, in about ``batches`` micro-batches of chunks.

    ``should_stop`` is asked before each batch. ``on_progress`` hears of every batch: ("translate", chunks done, chunks in all).
    """
    spark = units.sparkSession
    keys = kept(work_keys(units, model, size, echo), "resume-keys")
    held = kept(table.read().join(keys, ["file_id", "key"]), "resume-held")

    analysed = held.filter(F.col("idx") == GLOSSARY).select("file_id", F.col("answer").alias("glossary"))
    fresh = units.join(analysed, "file_id", "left_anti")
    if not fresh.isEmpty():
        found = kept(analyse(fresh, analyst, known, in_flight=in_flight), "resume-analysis")
        table.put(found.join(keys, "file_id").select("file_id", "key", F.lit(GLOSSARY).alias("idx"), F.col("glossary").alias("answer")))
        analysed = kept(analysed.unionByName(found.select("file_id", "glossary")), "resume-glossary")

    lines = held.filter("idx >= 0 and answer != ''").select("file_id", "idx", F.col("answer").alias("en"))
    wanted = kept(units.join(lines, ["file_id", "idx"], "left_anti").select("file_id", "idx", "ja").withColumn("chunk", F.floor(F.col("idx") / size).cast("int")), "resume-wanted")
    chunks, total = wanted.select("file_id", "chunk").distinct(), units.select("file_id", F.floor(F.col("idx") / size)).distinct().count()
    path, asked_path, state = (shared_path(spark, f"resume-{x}") for x in ("chunks", "asked", "state"))
    part = F.pmod(F.xxhash64("file_id", "chunk"), F.lit(batches))
    chunks.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(path)  # a file for each batch
    frames = kept(frames_of(units, size), "resume-frames")
    before = done = total - chunks.count()
    stopped = False

    def answer(batch: DataFrame, number: int) -> None:
        nonlocal done, stopped
        stopped = stopped or should_stop()
        if stopped:
            return
        # written and read by this session: the batch belongs to the stream's
        batch.write.mode("overwrite").parquet(f"{asked_path}/batch={number}")
        some = spark.read.schema("file_id string, chunk int").parquet(f"{asked_path}/batch={number}")
        got = answers(wanted.join(some, ["file_id", "chunk"], "left_semi"), frames, backend, analysed, echo, size, in_flight)
        table.put(got.join(keys, "file_id").select("file_id", "key", "idx", F.col("en").alias("answer")))
        done += some.count()
        on_progress("translate", done, total)

    stream = spark.readStream.schema("file_id string, chunk int").option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(answer).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    now = table.read().join(keys, ["file_id", "key"]).filter("idx >= 0").select("file_id", "idx", F.col("answer").alias("en"))
    out, failures = with_lines(units, now, size)
    out = kept(out, "resume-lines")
    failures = kept(failures, "resume-failures")
    whole = out.groupBy("file_id").agg(F.count_if(F.col("en") == "").alias("missing")).filter("missing = 0")
    table.remove(whole.select("file_id"))
    went = spark.read.schema("file_id string, chunk int").parquet(f"{asked_path}/*") if done > before else chunks.limit(0)
    return Resumed(out, analysed, failures, wanted.join(went, ["file_id", "chunk"], "left_semi").select("file_id", "idx"), stopped)
