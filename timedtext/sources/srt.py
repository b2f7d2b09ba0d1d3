"""SubRip text: parse and render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STAMP, stamp_ms, strip, timestamp, wrap


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, idx, start, end, text) of all files under ``path``."""
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_id"), "value"))


def parse(files: DataFrame) -> DataFrame:
    """(file_id, value) -> (file_id, idx, start, end, text); blocks without a stamp line are left out."""
    clean = strip(F.regexp_replace("value", "\r\n", "\n"))
    blocks = files.select("file_id", F.posexplode(F.split(clean, r"\n\s*\n")).alias("block", "body"))
    lines = F.split("body", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(STAMP)), True)
    rows = blocks.withColumn("at", at).filter("at > 0").withColumn("line", F.element_at(lines, F.col("at").cast("int")))
    text = F.array_join(F.slice(lines, F.col("at").cast("int") + 1, F.size(lines)), "\n")
    rows = rows.select("file_id", "block", stamp_ms(F.col("line"), 1).alias("start"), stamp_ms(F.col("line"), 5).alias("end"), text.alias("text"))
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("file_id").orderBy("block")) - 1).select("file_id", "idx", "start", "end", "text")


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """One text per file from rows (key, n, start, end, body)."""
    block = F.format_string("%d\n%s --> %s\n%s", F.col("n"), timestamp(F.col("start")), timestamp(F.col("end")), F.col("body"))
    each = rows.select(key, "n", block.alias("block")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks"))
    return each.select(key, F.concat(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("srt"))


def render_units(units: DataFrame, key: str = "file_id", order: str = "idx", text: str = "en", least_ms: int = 700, original: str | None = None, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Translated (or bilingual) SRT per file: empty lines are skipped and the rest numbered anew."""
    rows = units.filter(strip(F.coalesce(text, F.lit(""))) != "")
    body: Column = wrap(F.col(text))
    if original:
        body = F.concat(F.col(original), F.lit("\n"), body)
    rows = rows.select(key, F.row_number().over(W.partitionBy(key).orderBy(order)).alias("n"), F.col(start).alias("start"), F.greatest(F.col(end), F.col(start) + least_ms).alias("end"), body.alias("body"))
    return _joined(rows, key)


def render_cues(cues: DataFrame, key: str = "file_id", order: str = "idx") -> DataFrame:
    """SRT of cues (t_ms, end_ms, ja), as :func:`timedtext.operators.timing.stretch` leaves them."""
    rows = cues.filter(strip(F.coalesce("ja", F.lit(""))) != "")
    rows = rows.select(key, F.row_number().over(W.partitionBy(key).orderBy(order)).alias("n"), F.col("t_ms").alias("start"), F.col("end_ms").alias("end"), strip(F.col("ja")).alias("body"))
    return _joined(rows, key)
