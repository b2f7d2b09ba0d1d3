"""Embedding near-dedup with a pivot-permutation index.

Reference points are vectors of a bounded sample, in numbers that grow with the rows so that lists stay
short. A vector is described by its nearest reference points in order of closeness. An inverted list is
kept for every reference point (for every pair of them where there are too many vectors for the reference
points that may be broadcast), and two vectors that meet in a list are candidates if they share at least
``SHARED`` reference points and the shared ones, weighed by their ranks in both orders, count enough. How many
nearest points are kept, and what is enough, is fitted: sampled vectors are turned away until their cosine
is the threshold, and ``RECALL`` of these pairs, and of the near pairs inside the sample, must be candidates. The cosine of candidates is computed in
double precision.

Two vectors that share ``SHARED`` of ``n`` points share one of the first ``n - SHARED + 1`` of either, by
number, so only that many lists hold a vector. Equal vectors are one class and only its smallest vec_id
is indexed; the others count with it. Lists with one class are dropped. A long list is cut into tiles, and
pairs of tiles are compared as matrices in tasks of bounded size; a pair is counted in the list of its first
shared points only. A tile returns one count per vector and one link per vector to its part of the
tile's link graph, not its pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
of different lengths have no cosine and are not linked, those of one length are, however few they are; a null
vec_id is left out; rows that repeat a vec_id are vectors of their own that share its component; ties go
to the smaller vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, finish, partitions, scratch, table
from .components import components
from .vectors import matrix, sample, usable

SHARED = 2
NEAREST = (5, 6, 8, 10, 12, 16)
RECALL, TURNED = 0.98, 1500
LIST, TILE = 400, 1024
MOST_POINTS, MOST_BYTES, FLAT = 65_536, 64 << 20, 2048
LENGTH_SHIFT = 20


def _top(closeness: np.ndarray, n: int) -> np.ndarray:
    """The places of each row's ``n`` largest, largest first, equal ones by place."""
    if closeness.shape[1] > n:
        top = np.sort(np.argpartition(-closeness, n - 1, axis=1)[:, :n], axis=1)
    else:
        top = np.tile(np.arange(closeness.shape[1]), (len(closeness), 1))
    order = np.argsort(-np.take_along_axis(closeness, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


@dataclass
class Points:
    """Reference points of one length. Many of them are searched by cells: the nearest few of about sqrt(8 n) of the points, and what lies nearest to those."""

    unit: np.ndarray
    cells: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, unit: np.ndarray) -> Points:
        if len(unit) <= FLAT:
            return cls(unit)
        coarse = unit[: int(np.sqrt(8 * len(unit)))]
        near = np.concatenate([(unit[i : i + 4096] @ coarse.T).argmax(axis=1) for i in range(0, len(unit), 4096)])
        return cls(unit, [np.flatnonzero(near == c) for c in range(len(coarse))])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        n = min(n, len(self.unit))
        if not self.cells:
            return _top(x @ self.unit.T, n)
        near = _top(x @ self.unit[: len(self.cells)].T, 8)
        best, names = np.full((len(x), 8, n), -np.inf), np.zeros((len(x), 8, n), np.int64)
        for c in np.unique(near):
            row, place = np.nonzero(near == c)
            cell = self.cells[c]
            if not len(cell):
                continue
            found = x[row] @ self.unit[cell].T
            top = _top(found, n)
            best[row, place, : top.shape[1]] = np.take_along_axis(found, top, 1)
            names[row, place, : top.shape[1]] = cell[top]
        best, names = best.reshape(len(x), -1), names.reshape(len(x), -1)
        return np.take_along_axis(names, _top(best, n), 1)


@dataclass
class Index:
    points: dict[int, Points]
    nearest: int = NEAREST[0]
    least: dict[int, float] = field(default_factory=dict)  # by length, where the sample tells

    def of_length(self, dim: int) -> Points:
        """Lengths that the sample missed are rare; fixed random directions serve them."""
        if dim not in self.points:
            v = np.random.default_rng(dim).normal(size=(64, dim))
            self.points[dim] = Points.of(v / np.linalg.norm(v, axis=1, keepdims=True))
        return self.points[dim]

    def describe(self, x: np.ndarray) -> np.ndarray:
        """Names of the nearest points of unit vectors, nearest first; points of different lengths have different names."""
        return self.of_length(x.shape[1]).nearest(x, self.nearest) + (x.shape[1] << LENGTH_SHIFT)


def weights(n: int) -> np.ndarray:
    """Of ranks 0 to n - 1: nearer points count more; all together, squared, are 1."""
    w = np.arange(n, 0, -1, dtype=np.float64)
    return w / np.sqrt((w * w).sum())


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: how many points two descriptions share, and the weight of those."""
    same = a[:, :, None] == b[:, None, :]
    w = weights(a.shape[1])
    return same.sum(axis=(1, 2)), (same * w[:, None] * w[None, :]).sum(axis=(1, 2))


def build(points: dict[int, np.ndarray], share: dict[int, float], n: int, threshold: float, seed: int) -> Index:
    """Points for ``n`` vectors of which each length has its share, and how many of them describe a vector."""
    rng = np.random.default_rng(seed)
    index = Index({})
    for dim, x in points.items():
        wanted = min(MOST_POINTS, MOST_BYTES // (8 * dim), max(32, int(n * share[dim] * NEAREST[2] / LIST)))
        index.points[dim] = Points.of(x[:wanted])

    def pairs(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
        x, some = points[dim][-TURNED:], points[dim][-2 * TURNED :]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(side, axis=1, keepdims=True)
        turned = np.where(size > 1e-9, threshold * x + np.sqrt(1 - threshold**2) * side / np.maximum(size, 1e-9), x)
        near = np.argwhere(np.triu(some @ some.T >= threshold, 1))
        near = near[rng.permutation(len(near))[: 4 * TURNED]]
        return [(x, turned), *([tuple(some[near.T])] if len(near) else [])]

    held = {dim: pairs(dim) for dim in points}
    for index.nearest in NEAREST:
        found = [_shared(index.describe(a), index.describe(b)) for a, b in held[max(share, key=share.get)]]
        if all((count >= SHARED).mean() >= RECALL for count, _ in found):
            break
    for dim, some in held.items():
        if len(points[dim]) >= TURNED:
            found = [_shared(index.describe(a), index.describe(b)) for a, b in some]
            index.least[dim] = min((float(np.quantile(weight[count >= SHARED], 0.002)) for count, weight in found if (count >= SHARED).any()), default=0.0)
    return index


def describe(classes: DataFrame, index: Index) -> DataFrame:
    """Adds ``pivots``: the ordered nearest reference points."""
    held = classes.sparkSession.sparkContext.broadcast(index)

    def run(frames):
        for pdf in frames:
            length = pdf["embedding"].map(len)
            for _, some in pdf.groupby(length):
                x = matrix(some["embedding"])
                yield some.assign(pivots=list(held.value.describe(x / np.linalg.norm(x, axis=1, keepdims=True))))

    return classes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", pivots array<long>")


def _tile(rows: list, threshold: float, least: dict[int, float]) -> list[tuple]:
    """Counts and links of one cell: pairs of the two tiles, or within the one tile."""
    ti, tj, names = rows[0].ti, rows[0].tj, list(rows[0].names)
    orders = np.stack([r.pivots for r in rows])
    known, at = np.unique(orders, return_inverse=True)
    weight = np.zeros((len(rows), len(known)), np.float32)
    np.put_along_axis(weight, at.reshape(orders.shape), weights(orders.shape[1]).astype(np.float32)[None, :], 1)
    held = (weight > 0).astype(np.float32)
    least_shared = min(SHARED, orders.shape[1])
    near = (held @ held.T >= least_shared) & (weight @ weight.T >= least.get(len(rows[0].embedding), 0.0) - 1e-4)
    np.fill_diagonal(near, False)
    if ti != tj:
        side = np.array([r.t for r in rows])
        near &= side[:, None] != side[None, :]
    before = held[:, (known < names[-1]) & ~np.isin(known, names)]  # a pair that shares one of these is another list's
    near &= before @ before.T == 0
    if not near.any():
        return []
    x = np.stack([r.embedding for r in rows]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near &= x @ x.T >= threshold
    if not near.any():
        return []
    ids = np.array([r.id for r in rows])
    copies = np.array([r.copies for r in rows])
    links = near @ copies
    label = np.arange(len(rows))
    while True:  # smallest label in each part of the tile's link graph
        low = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(ids[i]), int(links[i]), int(ids[label[i]])) for i in np.flatnonzero(near.any(axis=1))]


def tile_links(described: DataFrame, n: int, index: Index, threshold: float) -> DataFrame:
    """(id, links, near): parts of each class's count of linked vectors, and a class it is connected with."""
    points = sum(len(p.unit) for p in index.points.values())
    by_number = F.array_sort("pivots")
    first = F.slice(by_number, F.lit(1), F.greatest(F.size("pivots") - SHARED + 1, F.lit(1)))
    names = F.transform(first, lambda p: F.array(p))
    if n * index.nearest > 8 * LIST * max(points, 1):
        pairs = F.array(*[F.array(F.get(by_number, F.lit(i)), F.get(by_number, F.lit(j))) for i, j in combinations(range(index.nearest), 2)])
        names = F.when(F.size("pivots") == index.nearest, pairs).otherwise(names)
    postings = described.select("id", F.explode(names).alias("names"))
    lists = postings.groupBy("names").agg(F.count("*").alias("n")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    held = postings.join(lists, "names").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("t")).alias("ti"), F.greatest(o, F.col("t")).alias("tj"))))
    cells = held.select("id", "names", "t", cell.alias("c")).select("id", "names", "t", "c.ti", "c.tj").join(described, "id")
    least = index.least

    def run(frames):
        import pandas as pd

        rows, now = [], None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                key = (tuple(r.names), r.ti, r.tj)
                if key != now:
                    out += _tile(rows, threshold, least) if len(rows) > 1 else []
                    rows, now = [], key
                rows.append(r)
            yield pd.DataFrame(out, columns=["id", "links", "near"])
        if len(rows) > 1:
            yield pd.DataFrame(_tile(rows, threshold, least), columns=["id", "links", "near"])

    cells = cells.repartition(partitions(described.sparkSession), "names", "ti", "tj").sortWithinPartitions("names", "ti", "tj")
    return cells.mapInPandas(run, "id long, links long, near long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row with a vec_id."""
    spark = embeddings.sparkSession
    rows = embeddings.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = usable(F.col("embedding"))
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    with scratch(spark):
        good = rows.filter(fit)
        classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        classes = cut(classes.withColumn("id", F.monotonically_increasing_id()).select("id", "first", "copies", "embedding"), "vec-classes")
        n = classes.count()
        wanted = min(MOST_POINTS, max(4 * TURNED, n * NEAREST[2] // LIST))
        points = sample(classes.withColumnRenamed("first", "vec_id"), wanted, seed)
        if not points:
            return finish(alone, "near-vectors")
        total = sum(len(x) for x in points.values())
        unit = {d: x / np.linalg.norm(x, axis=1, keepdims=True) for d, x in points.items()}
        index = build(unit, {d: len(x) / total for d, x in points.items()}, n, threshold, seed)
        described = cut(describe(classes, index), "vec-described")
        found = cut(tile_links(described.select("id", "copies", "embedding", "pivots"), n, index, threshold), "vec-links")
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        parts = components(found.select(F.col("id").alias("a"), F.col("near").alias("b"))).join(described.select(F.col("id").alias("node"), "first"), "node")
        heads = parts.groupBy("component").agg(F.min("first").alias("head"))
        labels = parts.join(heads, "component").select(F.col("node").alias("id"), "head")
        of_class = described.join(counts, "id", "left").join(labels, "id", "left")
        of_class = cut(of_class.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "first").alias("component_id")), "vec-classes")
        out = good.join(of_class, "embedding").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
        return finish(out.unionByName(alone), "near-vectors")


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
