"""Token ids as binary shard files with a minimal perfect hash index from document keys to records.

Shards hold whole documents in ascending doc_id order, each followed by the end id:

    magic, raw ids, first byte of every record and the end (u64 each), id width (u32), records (u64), magic

Ids are little-endian and two bytes wide where the vocabulary fits (four otherwise). Tasks write
shards under names of their own attempt, and only shards that the manifest names count, so a task that
is lost and run again leaves nothing wrong behind.

The index is dealt by key hash into parts. A part is a minimal perfect hash of its keys, built level
by level: on each level every remaining key sets one bit of a bit array by its hash, bits hit twice
are cleared, and their keys go on to the next level; a key's slot is the rank of its bit over all
levels. Slots hold (fingerprint, shard, record, records with this key), so a lookup is a few bit
probes and one slot, and unknown keys are told by their fingerprint.

Shards are ranges of (key, hash of the text), so one key may hold any share of all rows: its records then go
on from shard to shard, each shard's run of them is an entry of the index under the key and the run's number,
and the first entry tells how many runs there are.

Defined cases: a null or empty text is only the end id; rows with a null doc_id come first, under a
key of their own; repeated doc_ids are neighbouring records, ordered by a hash of their text; an
empty table makes no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, finish, partitions, scratch, shared_path, table, text_of
from .tokens import WORD_LEVEL, crc32, vocabulary, worker_encoder

MAGIC = b"TTIDS001"
NULL_KEY = -(1 << 63)
SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("record", "<u4"), ("count", "<u4"), ("runs", "<u4")])
SHARD_BYTES = 64 << 20
PART_KEYS = 1 << 20
LEVELS, SPREAD = 40, 2.0


def store(root: str):
    """File system and path of a folder that all machines reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


# --- minimal perfect hash ------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) for x in levels]
        self.ranks = []
        seen = 0
        for bits in levels:
            self.ranks.append(seen + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[:-1])
            seen += int(bits.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(len(rest) * SPREAD))
            at = (mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            rest = rest[hits[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it (some unknown keys only)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[rest], k) % np.uint64(self.sizes[k])).astype(np.int64)
            here = bits[at]
            out[rest[here]] = self.ranks[k][at[here]]
            rest = rest[~here]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, at, levels = struct.unpack_from("<I", raw)[0], 4, []
        for _ in range(n):
            size = struct.unpack_from("<Q", raw, at)[0]
            length = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, length, at + 8), count=size).astype(bool))
            at += 8 + length
        return cls(levels), at


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


# --- shards --------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, root: str, path: str, shards: int, end_id: int = 1) -> DataFrame:
    """Tokenise in doc_id order and write one shard per partition; the manifest (key, shard, file, record, n_tokens)."""
    fields = [("key", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("record", pa.int32()), ("n_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = worker_encoder(path, leading_space=False)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        keys, ends, out = [], [0], None
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for b in batches:
            if out is None and b.num_rows:
                where, base = store(root)
                out = where.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                raw = np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes()
                keys.append(key)
                ends.append(ends[-1] + len(raw))
                out.write(raw)
        if out is None:
            return
        out.write(np.array(ends, "<u8").tobytes() + struct.pack("<IQ", width, len(keys)) + MAGIC)
        out.close()
        n = len(keys)
        sizes = np.diff(np.array(ends)) // width
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([task.partitionId()] * n, pa.int32()), pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(sizes, pa.int64())], [f for f, _ in fields])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), text_of().alias("text"), F.xxhash64("text").alias("mix"))
    rows = rows.repartitionByRange(shards, "key", "mix").sortWithinPartitions("key", "mix", "text").select("key", "text")
    return rows.mapInArrow(run, "key long, shard int, file string, record int, n_tokens long")


class Shard:
    def __init__(self, where, path: str):
        self.file = where.open_input_file(path)
        size, tail = self.file.size(), 12 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        assert end[12:] == MAGIC, path
        self.width, n = struct.unpack_from("<IQ", end)
        self.at = np.frombuffer(self.file.read_at(8 * (n + 1), size - tail - 8 * (n + 1)), "<u8").astype(np.int64)

    def first_id(self, record: int) -> int:
        return int(self.at[record]) // self.width

    def ids(self, record: int) -> np.ndarray:
        lo, hi = self.at[record : record + 2]
        return np.frombuffer(self.file.read_at(int(hi - lo), int(lo) + len(MAGIC)), f"<u{self.width}").astype("<u4")


def build_index(manifest: DataFrame, root: str, parts: int) -> DataFrame:
    """Write one index file per part; returns (part, file, keys)."""

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        held = [f for f in frames if len(f)]
        if not held:
            return
        where, base = store(root)
        out = []
        for part, pdf in pd.concat(held).groupby("part"):
            keys = run_keys(pdf["key"].to_numpy(np.int64), pdf["run"].to_numpy(np.int64))
            tree = PerfectHash.of(keys)
            slots = np.zeros(len(keys), SLOT)
            at = tree.slots(keys)
            slots["mark"][at] = fingerprint(keys)
            for name in ("shard", "record", "count", "runs"):
                slots[name][at] = pdf[name].to_numpy()
            name = f"index-{part:06d}-{TaskContext.get().taskAttemptId()}.mph"
            with where.open_output_stream(f"{base}/{name}") as f:
                f.write(tree.dump() + slots.tobytes())
            out.append((part, name, len(keys)))
        yield pd.DataFrame(out, columns=["part", "file", "keys"])

    entries = manifest.groupBy("key", "shard").agg(F.min("record").alias("record"), F.count("*").cast("int").alias("count"))
    along = W.partitionBy("key")  # a row per shard that holds the key
    entries = entries.withColumn("run", F.row_number().over(along.orderBy("shard")) - 1).withColumn("runs", F.count("*").over(along).cast("int"))
    entries = entries.withColumn("part", part_of(F.col("key"), parts))
    return entries.repartition(parts, "part").mapInPandas(run, "part int, file string, keys long")


def run_keys(keys: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """64-bit keys of (key, run); the first run's is the key itself."""
    with np.errstate(over="ignore"):
        return np.where(runs == 0, keys.view(np.uint64), mixed(keys.view(np.uint64) + runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 77))


def part_of(key, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def lookup(keys: DataFrame, index: DataFrame, root: str, parts: int) -> DataFrame:
    """``keys`` (key) -> (key, shard, record, count) of those that the index knows: once each, or once per run."""

    def run(frames):
        import pandas as pd

        where, base = store(root)
        loaded: dict[str, tuple[PerfectHash, np.ndarray]] = {}
        for pdf in frames:
            for name, some in pdf.groupby("file"):
                if name not in loaded:
                    loaded.clear()
                    with where.open_input_stream(f"{base}/{name}") as f:
                        raw = f.read()
                    tree, at = PerfectHash.load(raw)
                    loaded[name] = tree, np.frombuffer(raw, SLOT, offset=at)
                tree, slots = loaded[name]
                keys, run = some["key"].to_numpy(np.int64), 0
                while len(keys):
                    wanted = run_keys(keys, np.full(len(keys), run))
                    at = tree.slots(wanted)
                    good = at >= 0
                    good[good] = slots["mark"][at[good]] == fingerprint(wanted[good])
                    keys, hit, run = keys[good], slots[at[good]], run + 1
                    yield pd.DataFrame({"key": keys, **{c: hit[c].astype(np.int32) for c in ("shard", "record", "count")}})
                    keys = keys[hit["runs"] > run]

    rows = keys.select("key").distinct().withColumn("part", part_of(F.col("key"), parts)).join(index, "part")
    return rows.repartition(parts, "part").sortWithinPartitions("part").select("key", "file").mapInPandas(run, "key long, shard int, record int, count int")


def read_records(found: DataFrame, files: DataFrame, root: str, shards: int) -> DataFrame:
    """Read the records of looked-up keys: (key, shard, first, n_tokens, ids_crc32)."""

    def run(frames):
        import pandas as pd

        where, base = store(root)
        name, shard = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.file != name:
                    name, shard = r.file, Shard(where, f"{base}/{r.file}")
                for k in range(r.record, r.record + r.count):
                    ids = shard.ids(k)
                    out.append((r.key, r.shard, shard.first_id(k), len(ids), crc32(ids.tobytes())))
            yield pd.DataFrame(out, columns=["key", "shard", "first", "n_tokens", "ids_crc32"])

    rows = found.join(files, "shard").repartition(shards, "shard").sortWithinPartitions("shard", "record")
    return rows.select("key", "shard", "record", F.col("count"), "file").mapInPandas(run, "key long, shard int, first long, n_tokens long, ids_crc32 long")


def op3_perfect_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = partitions(spark)
    # from the size of the files that the scan will read
    shards = max(parts, -(-int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SHARD_BYTES))
    root = shared_path(spark, "token-ids")
    where, base = store(root)
    where.create_dir(base)
    with scratch(spark):
        return finish(_written_and_read(docs, root, shards, parts), "ids-read")


def _written_and_read(docs: DataFrame, root: str, shards: int, parts: int, part_keys: int = PART_KEYS) -> DataFrame:
    """``parts`` of the index at least, and so many that a part holds about ``part_keys`` keys."""
    manifest = cut(write_shards(docs, root, vocabulary(WORD_LEVEL), shards), "ids-manifest")
    parts = max(parts, -(-manifest.count() // part_keys))
    index = cut(build_index(manifest, root, parts), "ids-index")
    # one row per shard: its file, and the ids in all shards before it
    total = manifest.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n_tokens").alias("ids"))
    files = cut(total.withColumn("base", F.sum("ids").over(W.orderBy("shard")) - F.col("ids")), "ids-files")
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"))
    read = read_records(lookup(keys, index, root, parts), files.select("shard", "file"), root, shards)
    out = read.join(files.select("shard", "base"), "shard")
    doc_id = F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id")
    return out.select(doc_id, (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
