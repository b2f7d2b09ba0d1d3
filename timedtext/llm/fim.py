r"""Fill-in-middle transformation by escaped marker injection (DataFrame functions only).

A text's units are its code points. A mark that no escaped text holds is put behind every unit: the mark and
the escape character are escaped first, each as two characters that count as one unit. The number of marks
is the number of units, and ``substring_index`` cuts the text at marks by their rank, from the left or from the
right. What it cuts loses the marks and the escapes again, and the three parts are put together.

Forms, with the sentinels ``<P>``, ``<S>`` and ``<M>``: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, and ``plain`` is the text as it was. No sentinel overlaps itself or another, and
a text that holds one stays plain, so :func:`restore` finds the parts again by the sentinels alone.

Where a text is cut and which form it gets follow from the SHA-256 of ``seed:doc_id``, so reruns agree.

Defined cases: null text is empty, and empty texts stay plain; a null doc_id counts as the empty text in the
hash; rows are transformed one by one, so repeated rows give equal results; an empty table gives an empty
result; extra columns are ignored. Every row is worked on by itself: nothing is shuffled, and a text's marks
take as many bytes as it has units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK, ESCAPE = "\u0001", "\u0002"
UNIT = rf"(?s){ESCAPE}?."
SEED, TRANSFORMED, SPM = 1, 90, 20


def mark_units(text: Column) -> Column:
    """``text`` escaped, with a mark behind every code point."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))
    return F.regexp_replace(escaped, UNIT, "$0" + MARK)


def unmark(marked: Column) -> Column:
    """The text that :func:`mark_units` marked, or any run of its units."""
    bare = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def count_marks(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(MARK), F.lit("")))).cast("long")


def up_to(marked: Column, delimiter: str, rank: Column) -> Column:
    """What stands before the mark of that rank; ranks below 0 count from the right and give what stands behind."""
    return F.call_function("substring_index", marked, F.lit(delimiter), rank.cast("int"))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def assemble(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    head, middle = up_to(output, MIDDLE, F.lit(1)), up_to(output, MIDDLE, F.lit(-1))
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.length(head)
    body = F.substring(head, 4, 2**31 - 1)
    left = F.call_function("substring_index", body, first, F.lit(1))
    right = F.substr(head, F.length(left) + 7, second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def transform(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): the parts are null where the form is plain.

    Of a hundred texts ``transformed`` are cut, and ``spm`` of a hundred of those begin with the suffix.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("marked", mark_units(F.col("text"))).withColumn("n", count_marks(F.col("marked")))
    form = F.when((F.col("n") == 0) | held | (h3 % 100 >= transformed), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    cut = F.col("form") != "plain"
    marked, a, b, n = (F.col(c) for c in ("marked", "a", "b", "n"))
    middle = up_to(up_to(marked, MARK, b), MARK, a - b)
    rows = rows.select(
        "doc_id", "text", "n", "form", F.when(cut, unmark(up_to(marked, MARK, a))).alias("prefix"), F.when(cut, unmark(middle)).alias("middle"), F.when(cut, unmark(up_to(marked, MARK, b - n - 1))).alias("suffix")
    )
    output = F.coalesce(assemble(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix")), F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op11_marker_injection_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents
), h AS (
  SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
