"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are which hashed n-grams of its lower-cased bytes (3 to 6 of them, white space as one
kind of byte) occur in it. From labelled texts, each n-gram gets the log of its smoothed share of toxic
texts over its share of the others; the n-grams whose ratios stand out most are kept, present features
have their ratio as value, and a logistic regression is fitted on those values.

The fit reads at most ``max_labelled`` labelled rows, the ones with the smallest hashes of their
doc_id; documents of that bounded set are found with a broadcast of their ids. Counts are made in
Spark; the regression gets one short list of kept features per labelled row. Scoring runs over whole
texts of all documents with a lookup table of fixed size.

Defined cases: null and empty texts score as the intercept does; labels that are null are left out,
and repeated ones count as toxic if any is; repeated documents score alike; without labels of both
kinds every score is the share of toxic labels (0 without labels); an empty table gives an empty
result; extra columns are ignored, and labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, finish, scratch, table, text_of

BITS = 20
SIZES = (3, 4, 5, 6)
MAX_LABELLED = 12_000
KEEP = 512
LEAN = 0.5
AT_ONCE = 500_000
AS_SPACE = np.arange(256, dtype=np.uint8)
AS_SPACE[:33] = 32


@dataclass
class Model:
    slot: np.ndarray  # for each bucket its kept feature, or -1
    weight: np.ndarray  # ratio times regression weight, by kept feature
    intercept: float


def batches_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: (text number, bucket) of every place where one starts."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    b = AS_SPACE[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(b) < n:
            return
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in SIZES:
            inside = doc[: len(h)] == doc[n - 1 :]
            bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            yield doc[: len(h)][inside], bucket[inside]


def present(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, kept feature) pairs, once each, in order of text."""
    found = []
    for doc, bucket in grams(texts):
        f = slot[bucket]
        hit = f >= 0
        found.append(doc[hit].astype(np.int64) << 32 | f[hit])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(toxic, text) of the labelled rows that the fit may see."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & fold).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # so many rows at most are broadcast
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").select("toxic", "text")


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for b in batches:
            y = np.array(b.column(0).to_pylist(), np.int32)
            for first, texts in batches_of(b.column(1).to_pylist()):
                pairs = np.unique(np.concatenate([doc.astype(np.int64) << BITS | bucket for doc, bucket in grams(texts)]))
                is_toxic = y[first + (pairs >> BITS)] == 1
                bucket = pairs & ((1 << BITS) - 1)
                toxic += np.bincount(bucket[is_toxic], minlength=1 << BITS).astype(np.int32)
                other += np.bincount(bucket[~is_toxic], minlength=1 << BITS).astype(np.int32)
        used = np.flatnonzero(toxic + other).astype(np.int32)
        for i in range(0, len(used), 100_000):
            k = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(toxic[k]), pa.array(other[k])], ["bucket", "toxic", "other"])

    return rows.mapInArrow(run, "bucket int, toxic int, other int").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _regress(y: np.ndarray, row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, l2: float, steps: int, lean: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on x[row, feature] = ratio[feature]; the rarer kind weighs more, by the kinds' ratio to the power ``lean``."""
    x, n, k = ratio[feature], len(y), len(ratio)
    share = np.where(y == 1, y.mean(), 1 - y.mean()) ** -lean
    share /= share.sum()
    w, c = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, x * w[feature], minlength=n) + c
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.append(np.bincount(feature, x * gap[row], minlength=k) + l2 * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:k]
        c -= step[k]
    return w, c


def fit(docs: DataFrame, labels: DataFrame, fold: Column | None = None, max_labelled: int = MAX_LABELLED, keep: int = KEEP, alpha: float = 0.5, l2: float = 1e-4, steps: int = 300, lean: float = LEAN) -> Model:
    rows = cut(training_rows(docs, labels, F.lit(True) if fold is None else fold, max_labelled), "tox-train")
    size = dict(rows.groupBy("toxic").count().collect())  # two numbers
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not n_toxic or not n_other:
        p = n_toxic / max(1, n_toxic + n_other)
        return Model(slot, np.zeros(0), float(np.log(p / (1 - p))) if 0 < p < 1 else (30.0 if p else -30.0))
    ratio = F.log((F.col("toxic") + alpha) / (n_toxic + 2 * alpha)) - F.log((F.col("other") + alpha) / (n_other + 2 * alpha))
    stands_out = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha))
    kept = _counts(rows).filter("toxic + other >= 3").withColumn("ratio", ratio).orderBy(stands_out.desc(), "bucket").limit(keep).select("bucket", "ratio").toPandas()  # ``keep`` rows at most
    slot[kept["bucket"].to_numpy()] = np.arange(len(kept))
    held = docs.sparkSession.sparkContext.broadcast(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_pylist()
            for first, texts in batches_of(b.column(1).to_pylist()):
                row, feature = present(texts, held.value)
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(y[first : first + len(texts)], pa.int32()), lists], ["toxic", "features"])

    with bounded_batches(docs.sparkSession):
        found = rows.mapInArrow(run, "toxic int, features array<int>").toArrow()  # one row per labelled row of the bounded sample
    lists = found.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    y = found.column("toxic").to_numpy().astype(np.float64)
    r = kept["ratio"].to_numpy(np.float64)
    w, c = _regress(y, np.repeat(np.arange(len(y)), lengths), lists.values.to_numpy().astype(np.int64), r, l2, steps, lean)
    held.unpersist()
    return Model(slot, w * r, c)


def score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` with their score, 0 to 1, as ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            z = np.full(b.num_rows, model.intercept)
            for first, texts in batches_of(b.column(b.num_columns - 1).to_pylist()):
                row, feature = present(texts, model.slot)
                z[first : first + len(texts)] += np.bincount(row, model.weight[feature] if len(feature) else None, minlength=len(texts))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], name])

    # columns come back by place, so names may clash
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], text_of())
    out = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(run, out)


def outside_fold(fold: int = 0, folds: int = 5) -> Column:
    """True for rows that may be learned from: crc32 of the doc_id's text, modulo ``folds``, is not ``fold``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold


def op5_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        model = fit(docs, table(spark, sf_dir, "labels"), outside_fold())
        out = score(docs, model, ["doc_id"])
        return finish(out.select("doc_id", F.coalesce(~outside_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), "tox-scores")
