"""Events as a stream of speech stretches, read to its end, so that the windows come back as a finite table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import stream_windows

SCHEMA = "file_id string, seen double, a double, b double, total double"


def stretches(spark: SparkSession, d: str) -> DataFrame:
    """Views of each user as stretches of six hours at most; time counts from the user's first event.

    Only a user's last row, which holds no stretch, tells how long it all is.
    """
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_type").alias("kind"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("t"))
    w = W.partitionBy("user_id")
    e = e.withColumn("a", F.col("t") - F.min("t").over(w)).withColumn("total", F.max("t").over(w) - F.min("t").over(w)).filter("kind = 'view' and total > 0")
    nxt = F.lead("a").over(w.orderBy("a"))
    e = e.withColumn("b", F.least(F.col("a") + 21_600, F.coalesce(nxt, F.col("total"))))
    rows = e.filter("b > a").select(F.col("user_id").cast("string").alias("file_id"), F.col("b").alias("seen"), "a", "b", "total")
    none = F.lit(None).cast("double")
    last = rows.groupBy("file_id").agg(F.max("total").alias("total")).select("file_id", F.col("total").alias("seen"), none.alias("a"), none.alias("b"), "total")
    return rows.withColumn("total", none).unionByName(last)


def windows_of_events(spark: SparkSession, d: str, batches: int = 4) -> DataFrame:
    """The stretches come in ``batches`` micro-batches in order of time, so state is carried from one to the next."""
    from ..plans.storage import shared_path

    # views are whole stretches, so the shortest pause between two of them counts
    root = shared_path(spark, "stream")
    parts = stretches(spark, d).repartitionByRange(batches, "seen").withColumn("part", F.spark_partition_id())
    parts.write.partitionBy("part").parquet(f"{root}/in")
    out, state = f"{root}/out", f"{root}/state-{uuid.uuid4().hex}"
    names = sorted(r[0] for r in spark.read.parquet(f"{root}/in").select("part").distinct().collect())  # ``batches`` numbers at most
    for part in names:
        # a part arrives in files by file_id, and is a batch of its own
        spark.read.schema(SCHEMA).parquet(f"{root}/in/part={part}").repartition("file_id").write.mode("append").parquet(f"{root}/arrived")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/arrived")
        stream_windows(stream, 864_000.0, 86_400.0, join_under=0.0).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file_id string, a double, b double").parquet(out)


STEP = 600  # seconds of a sample


def sample_blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Users' stretches as sound: a sample every ten minutes, 1 where a stretch holds all of them, in blocks of a day."""
    rows = stretches(spark, d)
    low, past, day = F.ceil(F.col("a") / STEP), F.floor(F.col("b") / STEP), F.col("block_no") * 144
    loud = rows.filter("a is not null").select("file_id", low.alias("low"), past.alias("past")).filter("past > low")
    loud = loud.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("low") / 144), F.floor((F.col("past") - 1) / 144))))
    ends = rows.filter("total is not null").select("file_id", F.floor(F.col("total") / STEP).alias("n")).filter("n > 0")
    days = ends.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 144))).alias("block_no"))
    heard = loud.groupBy("file_id", "block_no").agg(F.collect_list(F.struct((F.col("low") - day).alias("low"), (F.col("past") - day).alias("past"))).alias("runs"))
    size = F.least(F.lit(144).cast("long"), F.col("n") - day)
    # a day has few runs, so each sample looks at those and not at all loud samples
    one = lambda k: F.exists("runs", lambda r: (k >= r["low"]) & (k < r["past"])).cast("float")
    samples = F.when(F.col("runs").isNull(), F.array_repeat(F.lit(0.0).cast("float"), size.cast("int"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), one))
    # rows are few bytes and much work, so Spark must not put them into fewer tasks
    wide = days.join(heard, ["file_id", "block_no"], "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")
    return wide.select("file_id", "block_no", samples.alias("samples"), (F.col("n") * STEP).cast("double").alias("total"), ((F.col("block_no") + 1) * 144 >= F.col("n")).alias("last"))


def loud_runs(samples: np.ndarray, rate: float) -> list[tuple[float, float]]:
    edge = np.diff(np.concatenate([[0], (samples > 0).astype(int), [0]]))
    return [(float(a / rate), float(b / rate)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def count_loud(samples: np.ndarray, rate: float) -> list[tuple]:
    """A recogniser that hears how many samples are loud."""
    said = str(int(samples.sum()))
    return [(0.0, 0.5, said, [(0.0, 0.5, said, 1.0)])]


def windows_of_blocks(spark: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The blocks come in ``parts``; after each the stream is stopped, and it is started again for the next. (file_id, idx, a, b, text) of all windows."""
    from ..plans.recognition import window_table
    from ..plans.storage import kept, shared_path
    from .blocks import BLOCKS, hear_blocks, keep_windows

    root = shared_path(spark, "blocks")
    table = window_table(spark, f"{root}/windows")
    blocks = kept(sample_blocks_of(spark, d), "blocks")
    part = F.floor(F.col("block_no") * parts * 144 / (F.col("total") / STEP + 144)).cast("int")
    for k in range(parts):
        blocks.filter(part == k).repartition("file_id").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(BLOCKS).parquet(f"{root}/in")
        keep_windows(hear_blocks(stream, 1 / STEP, loud_runs, count_loud, 864_000.0, 86_400.0), table, "loud", f"{root}/state").awaitTermination()
    return table.read().select("file_id", "idx", "a", "b", F.col("segments")[0]["text"].alias("text"))
