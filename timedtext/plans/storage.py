"""Intermediate and kept tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES, BROADCAST = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.autoBroadcastJoinThreshold"
BATCH_BYTES, BROADCAST_BYTES = 8 << 20, 1 << 20
_open = threading.local()


@contextmanager
def _set(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    own = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python 8 MB at a time at most, however long texts are and however many rows a task has; a lower setting stays."""
    now = (spark.conf.get(ARROW_BYTES, None) or "67108864").rstrip("b")
    if now.isdigit() and 0 < int(now) <= BATCH_BYTES:
        yield
        return
    with _set(spark, ARROW_BYTES, BATCH_BYTES):
        yield


@contextmanager
def bounded_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside broadcast tables of 1 MB at most; a lower setting stays.

    A broadcast table is built in the driver's memory, all those of a plan at once, and each counts as it is stored: compressed, many times smaller.
    """
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() <= BROADCAST_BYTES:
        yield
        return
    with _set(spark, BROADCAST, BROADCAST_BYTES):
        yield


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. A local session without one gets a temporary folder; on a cluster that is an error.

    Inside :func:`scratch` what is put there goes when the block ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timedtext-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if stack := getattr(_open, "paths", None):
        stack[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside are deleted at the end, but those that :func:`finish` made."""
    stack = _open.paths = getattr(_open, "paths", None) or []
    stack.append([])
    try:
        yield
    finally:
        for name in stack.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: a model's answers are asked for once, whatever executor is lost later."""
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    with bounded_batches(df.sparkSession), bounded_broadcasts(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def finish(df: DataFrame, name: str) -> DataFrame:
    """A block's result as a table that outlives the block; an outer block takes it over."""
    out = kept(df, name)
    stack = getattr(_open, "paths", None) or []
    if stack:
        path = stack[-1].pop()
        if len(stack) > 1:
            stack[-2].append(path)
    return out


def with_positions(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Join lists by position; a position that one side lacks is an error, not a dropped row."""
    both = left.withColumn("_left", F.lit(True)).join(right.select(*keys, value, F.lit(True).alias("_right")), keys, "full")
    whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    checked = F.when(whole, F.col(value)).otherwise(F.raise_error(F.lit("lists of unequal length")).cast(right.schema[value].dataType))
    return both.withColumn(value, checked).drop("_left", "_right")


def new_in_queue(added: DataFrame, known: DataFrame, path: str = "path", order: str = "pos") -> DataFrame:
    """Added rows whose path is not known yet, each path once, in the order in which it was added first."""
    first = added.groupBy(path).agg(F.min_by(F.struct(*added.columns), order).alias("_row")).select("_row.*")
    return first.join(known.select(path), path, "left_anti").orderBy(order)


def status_counts(queue: DataFrame, status: str = "status") -> DataFrame:
    return queue.groupBy(status).agg(F.count("*").alias("n"))
