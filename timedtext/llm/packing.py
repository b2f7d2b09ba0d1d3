"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut, the short piece
first. Full pieces are sequences by themselves. The others are dealt by hash into blocks of about
``block_items``; each block is one bin-packing instance of bounded size, solved by several islands.
An island starts from best-fit decreasing with its own noise and breeds: a crossover puts whole
well-filled bins of one parent into the other, drops the bins that hold the same documents twice, and
best-fits the displaced documents. After every epoch an island receives the best packing of its
neighbour. A block that reaches the lower bound ``ceil(tokens / capacity)`` stops early, as nothing
can beat it. Blocks and islands are rows, so epochs are ordinary Spark stages over cut tables.

Defined cases: a null or empty text is one token (the end id); equal and repeated documents are
pieces of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, finish, scratch, table, text_of
from .tokens import BYTE_LEVEL, crc32, vocabulary, worker_encoder

CAPACITY = 2048
END = b"\0\0\0\0"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenise and cut: ``(doc_id, piece, start, length, ids_crc32)``."""
    path = path or vocabulary(BYTE_LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, leading_space=True)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                ids += END
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, v in zip(out, (doc, k, lo, hi - lo, crc32(ids[4 * lo : 4 * hi])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECE)


# --- one island --------------------------------------------------------------------------------


class Bins:
    """Open bins by what they have left; ``fit`` finds the one that an item fills best."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], rest: int) -> None:
        self.bins.append(items)
        if rest:
            self.by_rest[rest].append(len(self.bins) - 1)
            self.mask |= 1 << rest

    def fit(self, item: int) -> None:
        size = self.lengths[item]
        over = self.mask >> size
        if not over:
            self.add([item], self.capacity - size)
            return
        rest = size + (over & -over).bit_length() - 1
        k = self.by_rest[rest].pop()
        if not self.by_rest[rest]:
            self.mask ^= 1 << rest
        self.bins[k].append(item)
        if rest > size:
            self.by_rest[rest - size].append(k)
            self.mask |= 1 << (rest - size)


def best_fit(lengths: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * rng.random()))
    b = Bins(lengths, capacity)
    for i in order:
        b.fit(i)
    return b.bins


def score(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the sum of squared fills."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(mine: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    full = [b for b in other if sum(lengths[i] for i in b) == capacity]
    if not full or len(full) < len(other) // 8:
        full = sorted(other, key=lambda b: -sum(lengths[i] for i in b))[: max(1, len(other) // 4)]
    given = rng.sample(full, max(1, len(full) // 3))
    here = {i for b in given for i in b}
    child, displaced = Bins(lengths, capacity), []
    for b in given:
        child.add(list(b), capacity - sum(lengths[i] for i in b))
    loose = capacity * (0.97 + 0.03 * rng.random())  # the worst-filled bins are emptied too
    for b in mine:
        held = [i for i in b if i not in here]
        fill = sum(lengths[i] for i in b)
        if len(held) == len(b) and fill >= loose:
            child.add(list(b), capacity - fill)
        else:
            displaced += held
    displaced.sort(key=lambda i: (-lengths[i], rng.random()))
    for i in displaced:
        child.fit(i)
    return child.bins


def evolve(lengths: list[int], start: list[list[list[int]]], capacity: int, rng: random.Random, size: int, births: int) -> list[list[int]]:
    """The best packing after ``births`` children of a population grown from ``start``."""
    bound = -(-sum(lengths) // capacity)
    people = [(score(b, lengths, capacity), b) for b in start]
    while len(people) < size and min(p[0][0] for p in people) > bound:
        b = best_fit(lengths, capacity, rng, 0.25 * rng.random())
        people.append((score(b, lengths, capacity), b))
    for _ in range(births):
        people.sort(key=lambda p: p[0])
        if people[0][0][0] <= bound or len(people) < 2:
            break
        a, b = rng.sample(people[: max(2, size)], 2)
        child = crossover(a[1], b[1], lengths, capacity, rng)
        people.append((score(child, lengths, capacity), child))
        people = sorted(people, key=lambda p: p[0])[:size]
    return min(people, key=lambda p: p[0])[1]


def _groups(labels: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, x in enumerate(labels):
        bins.setdefault(x, []).append(i)
    return list(bins.values())


def _places(bins: list[list[int]], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Each item's bin and its gapless place there."""
    labels, offsets = [0] * len(lengths), [0] * len(lengths)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            labels[i], offsets[i] = k, at
            at += lengths[i]
    return labels, offsets


# --- blocks and islands as rows -----------------------------------------------------------------

ISLAND = "block int, island int, lengths array<int>, labels array<int>, offsets array<int>, n_bins int, done boolean"


def _epoch(rows: DataFrame, capacity: int, seed: int, size: int, births: int) -> DataFrame:
    """rows: (block, island, lengths, own labels or null, the neighbour's labels or null)."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                rng = random.Random(seed * 1_000_003 + r.block * 1009 + r.island)
                start = [_groups(list(x)) for x in (r.own, r.other) if x is not None]
                start = start or [best_fit(lengths, capacity, rng, 0.02 * r.island)]
                best = evolve(lengths, start, capacity, rng, size, births)
                out.append((r.block, r.island, lengths, *_places(best, lengths), len(best), len(best) <= -(-sum(lengths) // capacity)))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "labels", "offsets", "n_bins", "done"])

    return rows.mapInPandas(run, ISLAND)


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = 8000, islands: int = 3, epochs: int = 2, size: int = 4, births: int = 12, seed: int = 11) -> DataFrame:
    """``items`` (as :func:`pieces` gives them) with ``sequence_id`` and ``offset``."""
    items = cut(items, "pack-pieces")
    full = items.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    loose = items.filter(F.col("length") < capacity)
    blocks = max(1, -(-loose.count() // block_items))
    # dealt by place in the table just written, so that repeated rows spread too
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(blocks)).cast("int")
    loose = loose.withColumn("block", block)
    item = F.struct((-F.col("length")).alias("order"), "doc_id", "piece", "start", "length", "ids_crc32")
    held = cut(loose.groupBy("block").agg(F.array_sort(F.collect_list(item)).alias("items")), "pack-blocks")
    lengths = F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")
    none = F.lit(None).cast("array<int>")
    each = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), lengths, none.alias("own"), none.alias("other"))
    n_tasks = min(blocks * islands, 4 * items.sparkSession.sparkContext.defaultParallelism)
    state = cut(_epoch(each.repartition(n_tasks, "block", "island"), capacity, seed, size, births), "pack-islands")
    for k in range(1, epochs):
        # elite migration along a ring; finished blocks stay as they are
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("labels").alias("other"))
        open_blocks = state.groupBy("block").agg(F.max("done").alias("any_done")).filter("not any_done").select("block")
        going = state.join(open_blocks, "block", "left_semi").join(elite, ["block", "island"]).select("block", "island", "lengths", F.col("labels").alias("own"), "other")
        rest = state.join(open_blocks, "block", "left_anti")
        state = cut(rest.unionByName(_epoch(going.repartition(n_tasks, "block", "island"), capacity, seed + k, size, births)), "pack-islands")
    best = state.groupBy("block").agg(F.min_by(F.struct("labels", "offsets"), F.struct("n_bins", "island")).alias("best"))
    laid = held.join(best, "block").select("block", F.explode(F.arrays_zip("items", F.col("best.labels").alias("labels"), F.col("best.offsets").alias("offsets"))).alias("x"))
    laid = laid.select("x.items.doc_id", "x.items.piece", "x.items.start", "x.items.length", "x.items.ids_crc32", (F.col("block").cast("long") * (1 << 32) + F.col("x.labels")).alias("sequence_id"), F.col("x.offsets").cast("long").alias("offset"))
    return full.select(*laid.columns).unionByName(laid)


def op2_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return finish(pack(pieces(table(spark, sf_dir, "documents"))), "packed")
