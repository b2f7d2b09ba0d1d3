"""Near-duplicate documents: DartMinHash signatures, banded joins, exact verification, components.

Texts are bags of five-word shingles (lower-cased words between ASCII white space), each weighed by how
often it occurs. Darts are thrown into these weighted regions, so signatures agree with the chance of the
weighted Jaccard similarity, and that is also what pairs are verified by. Texts with the same words are one
copy class. Classes that share a band key are candidates; links are pairs with an exact similarity of
``threshold`` or more.

Buckets may hold very many classes, so pairs are not listed:

1. every bucket's first member is compared with all other members (one pair a member), and
   components are taken;
2. buckets whose other members then lie in more than one component are compared in blocks: the members
   outside the bucket's largest component against all members in other components, tile by tile,
   each pair in the first band that it shares only. Tiles are bounded in words, so that a member goes to as few
   as memory allows, and within its task a tile is compared some members at a time. It
   returns one link per member and component that it meets, not its pairs.

So every candidate pair is either in one component already or verified.

Defined cases: every row is a document of its own, whatever its doc_id; texts without words, null ones
included, link with nothing but rows of the same doc_id; texts of fewer than five words have one shingle, of all of them; repeated rows
and equal texts are one class; the smallest doc_id names a class and its row is kept (of rows that share
it, any one), null doc_ids come last; an empty table gives an empty result; extra columns, whatever
their names, are ignored by :func:`near_duplicates` and kept by :func:`keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_tables, finish, forget_shuffles, free_name, partitions, scratch, table, text_of
from .components import components
from .repeats import repeated
from .shingles import WORDS, band_keys, dart_signatures, occurrences, shingle_bags

COORDINATES, BANDS = 96, 24
THRESHOLD = 0.8
REST_TILE, ALL_TILE = 256, 1024
REST_WORDS, ALL_WORDS, MEMBER_WORDS = 500_000, 2_000_000, 100


def signatures(texts: DataFrame, k: int = COORDINATES, bands: int = BANDS, seed: int = 0) -> DataFrame:
    """Key columns and, last, ``text`` -> the key columns with (copy_key, n_words, bands)."""
    keys = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shingle_bags(b.column(len(keys)).to_pylist()))
            some = [found[i : i + 256] for i in range(0, len(found), 256)]
            signed = np.concatenate([np.zeros((0, bands), np.int64), *[band_keys(dart_signatures([x[0] for x in f], k, [x[1] for x in f], seed), bands) for f in some]])
            # beside the word sequence's hash the shingles' sum, so that classes are told apart by 128 bits
            both = pa.array([f"{w:016x}{int(np.add.reduce(s, dtype=np.uint64)):016x}" for s, _, w, _ in found], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signed.size + 1, bands), pa.int32()), pa.array(signed.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], both, pa.array([x[3] for x in found], pa.int32()), lists], [*keys, "copy_key", "n_words", "bands"])

    added = T.StructType().add("copy_key", T.StringType()).add("n_words", T.IntegerType()).add("bands", T.ArrayType(T.LongType()))
    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:-1], *added.fields]))


def shingles_of(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, shingles), every occurrence of a shingle as an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [occurrences(s, n).view(np.int64) for s, n, _, _ in shingle_bags(b.column(1).to_pylist())]
            ends = np.cumsum([0, *[len(s) for s in sets]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the shingles that occur on both sides."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    step = max(1, 4_000_000 // (len(left) + len(right)))

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        ok = shared[at] == flat
        return owner[ok], at[ok]

    (ro, rc), (ao, ac) = rows(left), rows(right)
    for lo in range(0, len(shared), step):
        hi = min(lo + step, len(shared))
        x, y = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        m = (rc >= lo) & (rc < hi)
        x[ro[m], rc[m] - lo] = 1
        m = (ac >= lo) & (ac < hi)
        y[ao[m], ac[m] - lo] = 1
        out += x @ y.T
    return out


def _links_in_tile(rest: dict, every: dict, band: int, threshold: float) -> list[tuple[int, int]]:
    """Links between members of ``rest`` and ``every`` in different components; one per member and component."""
    inter = _overlaps(rest["sets"], every["sets"])
    sizes = np.array([len(s) for s in rest["sets"]])[:, None] + np.array([len(s) for s in every["sets"]])[None, :] - inter
    linked = (inter >= threshold * sizes - 1e-6) & (rest["component"][:, None] != every["component"][None, :])
    if band:
        for k in range(band):
            linked &= rest["bands"][:, k][:, None] != every["bands"][:, k][None, :]
    out: dict[tuple[int, int], int] = {}
    for i, j in zip(*np.nonzero(linked), strict=True):
        out.setdefault((int(rest["id"][i]), int(every["component"][j])), int(every["id"][j]))
    return [(a, b) for (a, _), b in out.items()]


def _verify_blocks(cells: DataFrame, threshold: float) -> DataFrame:
    """cells: (bucket, i, j, band, in_rest, id, component, bands, shingles), a cell's rows together and in order of ``in_rest``."""

    def run(frames):
        import pandas as pd

        def member(rows: list) -> dict:
            return {"id": np.array([r.id for r in rows]), "component": np.array([r.component for r in rows]), "bands": np.array([r.bands for r in rows]), "sets": [np.asarray(r.shingles) for r in rows]}

        def close(rows: list) -> list[tuple[int, int]]:
            rest, every = [r for r in rows if r.in_rest], [r for r in rows if not r.in_rest]
            others = [member(every[y : y + ALL_TILE]) for y in range(0, len(every), ALL_TILE)]
            some = [member(rest[x : x + REST_TILE]) for x in range(0, len(rest), REST_TILE)]
            return [link for x in some for y in others for link in _links_in_tile(x, y, rows[0].band, threshold)]

        held, cell = [], None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.bucket, r.i, r.j) != cell:
                    out += close(held) if held else []
                    held, cell = [], (r.bucket, r.i, r.j)
                held.append(r)
            yield pd.DataFrame(out, columns=["a", "b"])
        if held:
            yield pd.DataFrame(close(held), columns=["a", "b"])

    return cells.mapInPandas(run, "a long, b long")


def shared_buckets(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``classes`` (id, n_words, bands) -> (bucket, band, id, n_words, first) of the buckets that hold several; ``first`` is their smallest id.

    A bucket is a band's key with a level of size. Two bags are at most as similar as the smaller is large beside the
    other, so links lie on one level or on neighbouring ones: each class stands on its own level and on the next.
    """
    postings = classes.select("id", "n_words", F.posexplode("bands").alias("band", "bucket"))
    wide = cut(repeated(classes.select("bands")).withColumnRenamed("key", "bucket"), "dup-wide")
    forget_shuffles(classes.sparkSession)
    met = cut(postings.join(wide.hint("shuffle_hash"), "bucket"), "dup-met")
    drop_tables(wide)
    forget_shuffles(classes.sparkSession)
    own = F.floor(F.log(F.greatest(F.col("n_words") - WORDS + 1, F.lit(1))) / math.log(1.001 / min(threshold, 1)))
    on = met.withColumn("own", own).withColumn("level", F.explode(F.array("own", F.col("own") + 1)))
    on = on.select(F.xxhash64("bucket", "level").alias("bucket"), "band", "id", "n_words", (F.col("own") == F.col("level")).alias("own"))
    # without a class of this level all of them meet on the level below
    several = on.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("own").alias("own")).filter("n > 1 and own")
    out = cut(on.drop("own").join(several.select("bucket", "first"), "bucket"), "dup-shared")
    drop_tables(met)
    forget_shuffles(classes.sparkSession)
    return out


def verified_links(classes: DataFrame, shared: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``classes`` (id, bands), their :func:`shared_buckets` and ``sets`` (id, shingles) of those in them -> components (node, component)."""
    spark = classes.sparkSession
    star = shared.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both >= threshold * (F.size("sa") + F.size("sb") - both) - 1e-6
    links = cut(star.join(a, "a").join(b, "b").filter(similar).select("a", "b"), "dup-links")
    forget_shuffles(spark)
    first = components(links)

    # buckets that still hold several components, without their first members, which were compared with all others
    placed = shared.filter("id != first").select("bucket", "band", "id", "n_words").join(first, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", "n_words", F.coalesce("component", "id").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    largest = F.max(F.struct("n", "component", "words"))
    main = counts.groupBy("bucket").agg(largest["component"].alias("main"), F.sum("n").alias("n"), F.sum("words").alias("words"), (F.sum("n") - largest["n"]).alias("n_rest"), (F.sum("words") - largest["words"]).alias("words_rest"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = cut(placed.join(main, "bucket"), "dup-open")
    forget_shuffles(spark)
    if open_.isEmpty():
        return first
    # every member weighs some words more, for what is held beside its shingles
    tiles = lambda n, words, most: F.ceil((F.col(words) + MEMBER_WORDS * F.col(n)) / most).cast("int")
    n_rest, n_all = tiles("n_rest", "words_rest", REST_WORDS), tiles("n", "words", ALL_WORDS)
    slot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rest = open_.filter("component != main").select("*", F.lit(True).alias("in_rest"), slot(n_rest).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"))
    every = open_.select("*", F.lit(False).alias("in_rest"), F.explode(F.sequence(F.lit(0), n_rest - 1)).alias("i"), slot(n_all).alias("j"))
    cells = rest.unionByName(every).select("bucket", "i", "j", "band", "in_rest", "id", "component")
    cells = cells.join(cut(sets.join(classes, "id").select("id", "bands", "shingles"), "dup-members"), "id").select("bucket", "i", "j", "band", "in_rest", "id", "component", "bands", "shingles")
    cells = cells.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = cut(_verify_blocks(cells, threshold), "dup-more")
    drop_tables(open_)
    forget_shuffles(spark)
    return components(links.unionByName(more))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, text): a number for every row, written once so that it stays the row's."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return cut(rows, "dup-rows")


def classes_of_rows(rows: DataFrame, threshold: float, k: int, bands: int, spent: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, text_hash, text) -> (row, doc_id, text_hash, class_id, kept); one row of each class is kept. ``spent`` is a table to drop once texts are read."""
    signed = cut(signatures(rows, k, bands), "dup-signed")
    # without words, only rows of one doc_id are copies
    signed = signed.withColumn("copy_key", F.when(F.col("n_words") > 0, F.col("copy_key")).otherwise(F.concat(F.lit("doc "), "doc_id")))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    grouped = signed.filter("copy_key is not null").groupBy("copy_key").agg(F.min(order).alias("head"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words"))
    classes = cut(grouped.select("copy_key", F.col("head.row").alias("id"), "head", "n_words", "bands"), "dup-classes")
    shared = shared_buckets(classes.filter("n_words > 0").select("id", "n_words", "bands"), threshold)
    ids = shared.select("id").distinct()
    sets = cut(shingles_of(rows.join(ids, rows["row"] == ids["id"], "left_semi").select("row", "text")), "dup-sets")
    if spent is not None:
        drop_tables(spent)
    forget_shuffles(rows.sparkSession)
    found = verified_links(classes.select("id", "bands"), shared, sets, threshold)
    placed = classes.join(found, classes["id"] == found["node"], "left").select("copy_key", "head", F.coalesce("component", "id").alias("component"))
    heads = placed.groupBy("component").agg(F.min("head").alias("best"))
    of_key = cut(placed.join(heads, "component").select("copy_key", "best"), "dup-heads")
    alone = signed.filter("copy_key is null").select("row", "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return signed.join(of_key, "copy_key").select("row", "doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), (F.col("best.row") == F.col("row")).alias("kept")).unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, kept) per row of ``docs``; class_id is the smallest doc_id that links reach."""
    with scratch(docs.sparkSession):
        rows = numbered(docs)
        return finish(classes_of_rows(rows, threshold, k, bands, spent=rows).select("doc_id", "class_id", "kept"), "near-duplicates")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """``docs`` with one row of each class.

    Only what must go or is repeated is joined with the documents: doc_ids with the hash of a text, which
    also name the rows to keep one of.
    """
    with scratch(docs.sparkSession):
        rows = numbered(docs)
        found = classes_of_rows(rows, threshold, k, bands, spent=rows)
        named = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        marked = finish(named.filter("not kept or n > 1"), "dup-marked")
    held_id, held_hash = (free_name(docs.columns, n) for n in ("held_id", "held_hash"))
    keyed = docs.withColumns({held_id: F.col("doc_id").cast("long"), held_hash: F.xxhash64(text_of())})

    def met(some: DataFrame, how: str) -> DataFrame:
        names = some.select(F.col("doc_id").alias("marked_id"), F.col("text_hash").alias("marked_hash"))
        return keyed.join(names, keyed[held_id].eqNullSafe(names["marked_id"]) & (keyed[held_hash] == names["marked_hash"]), how)

    once = met(marked, "left_anti")
    again = met(marked.filter("kept"), "left_semi").dropDuplicates([held_id, held_hash])
    return once.unionByName(again).drop(held_id, held_hash)


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
