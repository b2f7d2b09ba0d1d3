"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
BATCH_BYTES = 8 << 20
_open = threading.local()


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, batches that go to Python hold 8 MB at most, however long their texts are; a lower setting stays.

    The session's own setting comes back afterwards.
    """
    own = spark.conf.get(ARROW_BYTES, None)
    now = (own or "67108864").rstrip("b")
    lower = not now.isdigit() or not 0 < int(now) <= BATCH_BYTES
    if lower:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if lower and own is None:
            spark.conf.unset(ARROW_BYTES)
        elif lower:
            spark.conf.set(ARROW_BYTES, own)


def bound_session(spark: SparkSession) -> None:
    """The same for a whole session, for a job that owns it and hands on frames that run later."""
    now = (spark.conf.get(ARROW_BYTES, None) or "67108864").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session that does not name one gets a temporary folder; on a cluster that is an error, as
    executors would not see the driver's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timedtext-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; with ``by``, in a folder for each value of these columns.

    This ends the lineage in files that outlive any executor, and gives Spark exact sizes to plan
    later joins with. Inside :func:`scratch` the table goes when the block ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    if held := getattr(_open, "paths", None):
        held[-1].append(path)
    with bounded_batches(spark):
        if by:
            spark.conf.set(WRITERS, "8")  # a file for each value at once, instead of a sort
            df.write.partitionBy(*by).parquet(path)
            spark.conf.unset(WRITERS)
        else:
            df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end, but those that :func:`finish` made."""
    stack = _open.paths = getattr(_open, "paths", None) or []
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _delete(spark, path)


def finish(df: DataFrame, name: str) -> DataFrame:
    """Cut a block's result to a table that outlives the block; an outer block takes it over."""
    out = cut(df, name)
    stack = getattr(_open, "paths", None) or []
    if stack:
        stack[-1].remove(out.cut_path)
        if len(stack) > 1:
            stack[-2].append(out.cut_path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables that :func:`cut` returned and that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.cut_path)


def drop_part(df: DataFrame, part: str) -> None:
    """Delete what a table that :func:`cut` wrote by columns holds in the folder ``part``."""
    _delete(df.sparkSession, f"{df.cut_path}/{part}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does when the driver collects their plans, which listeners hold a moment longer."""
    time.sleep(0.1)
    spark._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """``name``, or it with underscores, so that no column of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
