"""Nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The upper tree is fitted on a bounded sample: every node's points are split into ``branch`` k-means cells
until a node holds few of them. Then all vectors are put into the leaf that they reach by the closest child
at each level, and leaves that hold more than ``LEAF_ROWS`` of them are grown further in Spark, each
from a bounded sample of its own vectors, round by round, until leaves are small or the tree has all the
nodes that may be broadcast. A query walks the tree with a priority queue of nodes by their centre's
distance, and takes leaves in the order in which they come out. How many leaves it takes is calibrated: for
``CALIBRATED`` of the queries the true neighbours among all vectors are computed, and visits are widened
until ``recall`` of them are met; a query goes on while its leaves hold too few vectors. Distances are
exact, on the original vectors.

Leaves are dealt in blocks of vectors against blocks of queries, so a leaf with a third of all rows (equal
vectors, which no tree can part) is many tasks, and each cell returns its best few per query.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries
too; vectors of different lengths are no neighbours, and every length has a tree of its own; a null vec_id takes
no part; the query's own vec_id is no candidate; rows that repeat a query's vec_id ask once, with the smallest
of their vectors; repeated rows are candidates of their own; ties go to the smaller vec_id; with fewer
candidates than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_tables, finish, partitions, scratch, table
from .vectors import matrix, sample, usable

SAMPLE = 20_000
BRANCH, LEAF_POINTS = 8, 150
LEAF_ROWS, ROUNDS = 1000, 6
MOST_BYTES = 64 << 20
VECTORS, QUERIES = 4096, 512
RECALL, CALIBRATED = 0.97, 100
LENGTH_SHIFT = 24


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


@dataclass
class Tree:
    centres: np.ndarray  # of every node; the root is node 0, and nodes without children are leaves
    children: list[list[int]]
    visits: int = 0  # 0: all
    sizes: dict[int, int] = field(default_factory=dict)  # vectors by leaf
    solid: set[int] = field(default_factory=set)  # leaves whose points are all equal

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            near = _squares(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def walk(self, v: np.ndarray):
        """Leaves in best-bin-first order for one query; the centres below a node are looked at when it comes up."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield node
                continue
            far = self.centres[kids] - v
            for pair in zip(np.einsum("ij,ij->i", far, far).tolist(), kids, strict=True):
                heapq.heappush(queue, pair)

    def leaves_for(self, x: np.ndarray, wanted: int) -> list[list[int]]:
        out = []
        for v in x:
            held, seen = [], 0
            for leaf in self.walk(v):
                held.append(leaf)
                seen += self.sizes.get(leaf, 0)
                if self.visits and len(held) >= self.visits and seen > wanted:
                    break
            out.append(held)
        return out

    def graft(self, leaf: int, part: Tree) -> None:
        """Let a tree of a leaf's own vectors stand in its place."""
        if len(part.children) == 1:
            self.solid.add(leaf)
            return
        shift = len(self.children) - 1  # the part's root is the leaf
        name = lambda k: k + shift if k else leaf
        self.children[leaf] = [name(k) for k in part.children[0]]
        self.children += [[name(k) for k in kids] for kids in part.children[1:]]
        self.centres = np.concatenate([self.centres, part.centres[1:]])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        kept = [x[near == j].mean(axis=0) for j in range(len(centres)) if (near == j).any()]
        centres = np.stack(kept)
    return centres


def grow(points: np.ndarray, branch: int = BRANCH, leaf_points: int = LEAF_POINTS, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, todo = [points.mean(axis=0)], [[]], [(0, points)]
    while todo:
        node, x = todo.pop()
        if len(x) <= leaf_points:
            continue
        cells = _kmeans(x, min(branch, len(x)), rng)
        near = _squares(x, cells).argmin(axis=1)
        found = np.unique(near)
        if len(found) == 1:  # equal points stay one leaf
            continue
        for j in found:
            centres.append(cells[j])
            children.append([])
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, x[near == j]))
    return Tree(np.stack(centres), children)


@dataclass
class Forest:
    """One tree per length of vectors; leaves are named by length and node."""

    trees: dict[int, Tree]

    def of_length(self, dim: int) -> Tree:
        """A length that the sample missed is rare: its tree is one leaf."""
        return self.trees.setdefault(dim, Tree(np.zeros((1, dim)), [[]]))

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.of_length(x.shape[1]).place(x) + (x.shape[1] << LENGTH_SHIFT)

    def leaves_for(self, x: np.ndarray, wanted: int) -> list[list[int]]:
        base = x.shape[1] << LENGTH_SHIFT
        return [[base + leaf for leaf in some] for some in self.of_length(x.shape[1]).leaves_for(x, wanted)]

    def at(self, name: int) -> tuple[Tree, int]:
        return self.of_length(name >> LENGTH_SHIFT), name & ((1 << LENGTH_SHIFT) - 1)

    def n_bytes(self) -> int:
        return sum(t.centres.nbytes for t in self.trees.values())


def by_length(pdf: pd.DataFrame):
    for _, some in pdf.groupby(pdf["embedding"].map(len)):
        yield some, matrix(some["embedding"])


def put(good: DataFrame, forest: Forest) -> DataFrame:
    """Vectors with their leaf; the leaves' sizes are noted in the trees (a row per leaf, so the broadcast's bound holds)."""
    held = good.sparkSession.sparkContext.broadcast(forest)

    def run(frames):
        for pdf in frames:
            for some, x in by_length(pdf):
                yield some.assign(leaf=held.value.place(x))

    placed = cut(good.mapInPandas(run, f"vec_id long, embedding {dict(good.dtypes)['embedding']}, leaf long"), "tree-placed")
    for tree in forest.trees.values():
        tree.sizes = {}
    for r in placed.groupBy("leaf").count().collect():
        tree, leaf = forest.at(r["leaf"])
        tree.sizes[leaf] = r["count"]
    return placed


def refine(placed: DataFrame, forest: Forest, seed: int) -> bool:
    """Grow the leaves that hold too many vectors; false if there is none, or no room for more nodes."""
    room = MOST_BYTES - forest.n_bytes()
    wide = sorted(((n, (dim << LENGTH_SHIFT) + leaf) for dim, t in forest.trees.items() for leaf, n in t.sizes.items() if n > LEAF_ROWS and leaf not in t.solid), reverse=True)
    some, taken = [], 0
    for n, name in wide:
        # an upper guess of what the leaf's tree will hold; the widest leaves come first
        taken += 8 * (name >> LENGTH_SHIFT) * (2 * min(n, SAMPLE) // LEAF_POINTS + 2)
        if taken > room:
            break
        some.append((name, min(1.0, SAMPLE / n), max(LEAF_POINTS // 3, int(LEAF_ROWS * min(1.0, SAMPLE / n) / 2))))
    if not some:
        return False
    spark = placed.sparkSession
    wanted = F.broadcast(spark.createDataFrame(some, "leaf long, share double, leaf_points int"))  # leaves of the broadcast tree
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    points = placed.join(wanted, "leaf").filter(drawn).select("leaf", "leaf_points", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = grow(matrix(pdf["embedding"]), leaf_points=int(pdf["leaf_points"].iloc[0]), seed=seed)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "node": range(len(tree.children)), "children": tree.children, "centre": list(tree.centres)})

    grown = points.groupBy("leaf").applyInPandas(run, "leaf long, node int, children array<int>, centre array<double>").toPandas()  # within the broadcast's bound
    for name, part in grown.sort_values(["leaf", "node"]).groupby("leaf"):
        tree, leaf = forest.at(int(name))
        tree.graft(leaf, Tree(matrix(part["centre"]), [[int(k) for k in c] for c in part["children"]]))
    for name, _, _ in some:
        tree, leaf = forest.at(name)
        if not tree.children[leaf]:
            tree.solid.add(leaf)
    return True


def calibrate(placed: DataFrame, asked: DataFrame, forest: Forest, k: int, recall: float, seed: int) -> None:
    """Set each tree's visits so that ``recall`` of the true neighbours of some queries, among all vectors, are met."""
    some = asked.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(CALIBRATED).toPandas()
    if not len(some):
        return
    groups = {x.shape[1]: (part["query_id"].to_numpy(), x) for part, x in by_length(some)}
    held = placed.sparkSession.sparkContext.broadcast(groups)

    def run(frames):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in frames:
            for part, x in by_length(pdf):
                if x.shape[1] not in held.value:
                    continue
                ids, q = held.value[x.shape[1]]
                d = _squares(q, x)
                d[ids[:, None] == part["vec_id"].to_numpy()[None, :]] = np.inf
                leaf = np.broadcast_to(part["leaf"].to_numpy(), d.shape)
                if x.shape[1] in best:
                    d, leaf = np.hstack([best[x.shape[1]][0], d]), np.hstack([best[x.shape[1]][1], leaf])
                top = np.argsort(d, axis=1)[:, :k]
                best[x.shape[1]] = np.take_along_axis(d, top, 1), np.take_along_axis(leaf, top, 1)
        for dim, (d, leaf) in best.items():
            q = np.repeat(np.arange(len(d)), d.shape[1])
            yield pd.DataFrame({"dim": dim, "q": q, "distance": d.ravel(), "leaf": leaf.ravel()})

    order = W.partitionBy("dim", "q").orderBy("distance")
    met = placed.mapInPandas(run, "dim int, q int, distance double, leaf long").filter("distance < double('infinity')")
    near = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).toPandas()  # k rows per query of a bounded number
    for dim, part in near.groupby("dim"):
        tree, needed = forest.trees[dim], []
        q = groups[dim][1]
        for i, rows in part.groupby("q"):
            at = {leaf: n + 1 for n, leaf in enumerate(tree.walk(q[i]))}
            needed += [at[int(x) & ((1 << LENGTH_SHIFT) - 1)] for x in rows["leaf"]]
        tree.visits = int(np.quantile(needed, recall, method="higher"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, most_sampled: int = SAMPLE, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by Euclidean distance. ``is_query`` is told from vec_id."""
    spark = vectors.sparkSession
    good = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")))
    with scratch(spark):
        forest = Forest({dim: grow(x, seed=seed) for dim, x in sample(good, most_sampled, seed).items()})
        placed = put(good, forest)
        for n in range(ROUNDS):
            if not refine(placed, forest, seed + n):
                break
            drop_tables(placed)
            placed = put(good, forest)
        kind = dict(good.dtypes)["embedding"]
        asking = cut(placed.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "tree-queries")
        calibrate(placed, asking, forest, k, recall, seed)
        aware = spark.sparkContext.broadcast(forest)

        def leaves(frames):
            for pdf in frames:
                for some, x in by_length(pdf):
                    yield some.assign(leaf=aware.value.leaves_for(x, k))

        asked = cut(asking.mapInPandas(leaves, f"query_id long, embedding {kind}, leaf array<long>").withColumn("leaf", F.explode("leaf")), "tree-asked")
        blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("vb")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qb")), "leaf")
        blocks = cut(blocks, "tree-blocks")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        v = placed.join(blocks, "leaf").select("leaf", slot("vec_id", "vb").alias("i"), every("qb").alias("j"), "vec_id", "embedding")
        q = asked.join(blocks, "leaf").select("leaf", every("vb").alias("i"), slot("query_id", "qb").alias("j"), "query_id", "embedding")

        def nearest(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(qs) and len(vs):
                a, b, ids = matrix(qs["embedding"]), matrix(vs["embedding"]), vs["vec_id"].to_numpy()
                d = _squares(a, b)
                d[qs["query_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
                top = min(k, d.shape[1])
                # squares made by a matrix product are off by rounding; what may be near is measured anew
                limit = np.partition(d, top - 1, axis=1)[:, top - 1] + 1e-12 * ((a * a).sum(axis=1) + (b * b).sum(axis=1).max())
                for row, query in enumerate(qs["query_id"]):
                    near = np.flatnonzero((d[row] <= limit[row]) & np.isfinite(d[row]))
                    exact = np.sqrt(((b[near] - a[row]) ** 2).sum(axis=1))
                    for p in np.lexsort((ids[near], exact))[:k]:
                        out.append((query, ids[near[p]], exact[p]))
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        n = partitions(spark)
        met = q.repartition(n, "leaf", "i", "j").groupBy("leaf", "i", "j").cogroup(v.repartition(n, "leaf", "i", "j").groupBy("leaf", "i", "j")).applyInPandas(nearest, "query_id long, vec_id long, score double")
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        return finish(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "tree-found")


def op6_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
