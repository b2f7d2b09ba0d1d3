"""Vector columns: what takes part, and arrays to matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for vectors without null or non-finite components that are not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def sample(vectors: DataFrame, most: int, seed: int) -> dict[int, np.ndarray]:
    """At most ``most`` vectors, the same ones at every run, as one matrix per length."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(most).toPandas()
    return {int(n): matrix(some.tolist()) for n, some in rows["embedding"].groupby(rows["embedding"].map(len))} if len(rows) else {}
