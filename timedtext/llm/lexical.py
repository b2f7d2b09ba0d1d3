"""Ranked lexical search over dual-sorted wavelet trees.

Documents are cut into shards where they lie, without a shuffle. A shard holds, term after term, the postings of
its documents ordered by impact (what a term's occurrences add to a score, but for the term's weight),
as a wavelet tree over the documents' numbers in doc_id order (laid out level by level, zeros before ones). So a
term's list is sorted both ways: along the list by impact, down the tree by doc_id. In every node a list's postings
still stand by impact, so its first one bounds the node, and the weighted sum of the terms' first ones
bounds the score of every document below. A search walks the nodes best bound first, all terms of an
item side by side; a leaf's bound is its document's exact score. It ends when no node can enter the best k,
so the result is exact. A task carries its best k from shard to shard, and a window over the tasks' results
takes the best k of all.

A score is the sum over the item's terms, repeats included, of w * ((1000000000 * tf) div (1000 * tf + 12 * m)), with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 75 + (25 * n * N) div L. Terms are known by 64-bit hashes.

Nothing is collected but the terms of a block of items, of about ``BLOCK_TERMS``, with their document frequencies;
blocks are asked one after another. A shard has about ``SHARD_WORDS`` words, or one batch of documents if
that is more; a longer text is a shard of its own.

Defined cases: null and empty texts, and texts without terms, are found by nothing and do not count; rows of one doc_id
are documents of their own; a null doc_id (as which the largest long counts too) comes after all others at equal scores;
items of one item_id are one item, so are those with a null one; items without terms, or without any document that
scores, have no rows; terms of weight 0 add nothing; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, finish, scratch, table, text_of
from .shingles import AT_ONCE, _powers, mix

SHARD_WORDS, BLOCK_TERMS = 1 << 20, 100_000
AT_A_TIME, FRONTIER_BYTES = 16, 64 << 20
NO_ID = np.iinfo(np.int64).max
INDEX = "docs long, ids binary, terms binary, offsets binary, impacts binary, bits binary"
#: Bytes to bytes: A-Z lower-cased, ASCII that is neither letter nor digit a blank, all else as it is.
LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))

# --- terms -----------------------------------------------------------------------------------------


def term_blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of the text) of every term, in blocks of about ``AT_ONCE`` bytes; long texts are cut at blanks."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        raw, at = text.encode().translate(LETTERS), 0
        while at < len(raw):
            stop = len(raw) if len(raw) - at <= AT_ONCE else raw.rfind(b" ", at, at + AT_ONCE) + 1 or raw.find(b" ", at) + 1 or len(raw)
            held.append((i, raw[at:stop]))
            size, at = size + stop - at + 1, stop
            if size >= AT_ONCE:
                yield _terms(held)
                held, size = [], 0
    if held:
        yield _terms(held)


def _terms(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b" ".join(p for _, p in parts), np.uint8)
    edge = np.diff(np.concatenate([[0], (b != 32).view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        up, down = _powers(len(b) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        h = mix((sums[stop] - sums[start]) * down[start])
    ends = np.cumsum([len(p) + 1 for _, p in parts])
    return h.view(np.int64), np.array([i for i, _ in parts])[np.searchsorted(ends, start, "right")]


# --- the tree of one shard ----------------------------------------------------------------------------


class Tree:
    """Postings (term by term, by impact) as a wavelet tree over document numbers.

    ``rank0[d, p]`` counts the zeros before place p on level d, and ``impact[d, p]`` is the impact of the posting at
    p there; level ``depth`` is that of the leaves.
    """

    def __init__(self, ids: np.ndarray, terms: np.ndarray, offsets: np.ndarray, impacts: np.ndarray, bits: np.ndarray):
        self.ids, self.terms, self.offsets = ids, terms, offsets
        self.depth, n = bits.shape
        self.rank0 = np.zeros((self.depth, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int32)
        self.impact = np.zeros((self.depth + 1, n + 1), np.int32)
        self.impact[0, :n] = now = impacts
        for d in range(self.depth):
            zero = bits[d] == 0
            np.cumsum(zero, out=self.rank0[d, 1:])
            self.zeros[d] = self.rank0[d, n]
            self.impact[d + 1, :n] = now = np.concatenate([now[zero], now[~zero]])

    @classmethod
    def load(cls, row) -> Tree:
        of = lambda name, kind: np.frombuffer(row[name], kind)
        impacts = of("impacts", np.int32)
        packed = of("bits", np.uint8)
        width = -(-len(impacts) // 8)
        bits = np.unpackbits(packed.reshape(-1, width), axis=1, count=len(impacts))
        return cls(of("ids", np.int64), of("terms", np.int64), of("offsets", np.int64), impacts, bits)


def tree_row(ids: np.ndarray, term: np.ndarray, doc: np.ndarray, n_docs: int, n_words: int) -> dict | None:
    """The row of ``INDEX`` for a shard: ids of its documents, and the term and the document (a place in ``ids``) of every word; None if it has no word."""
    length = np.bincount(doc, minlength=len(ids))
    held = np.flatnonzero(length)
    if not len(held):
        return None
    held = held[np.argsort(ids[held], kind="stable")]
    number = np.zeros(len(ids), np.int64)
    number[held] = np.arange(len(held))
    terms, term = np.unique(term, return_inverse=True)
    key, tf = np.unique(term * len(held) + number[doc], return_counts=True)
    term, doc = key // len(held), key % len(held)
    m = 75 + 25 * length[held].astype(np.int64) * n_docs // n_words
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    by_impact = np.lexsort((doc, -impact, term))
    doc = doc[by_impact]
    depth, bits, now = max(1, int(len(held) - 1).bit_length()), [], doc
    for d in range(depth):
        bit = (now >> (depth - 1 - d)) & 1
        bits.append(np.packbits(bit.astype(np.uint8)))
        now = np.concatenate([now[bit == 0], now[bit == 1]])
    offsets = np.searchsorted(term, np.arange(len(terms) + 1))  # terms keep their places, their order is the list's
    arrays = {"ids": ids[held], "terms": terms, "offsets": offsets, "impacts": impact[by_impact].astype(np.int32), "bits": np.concatenate(bits)}
    return {"docs": len(held)} | {name: x.tobytes() for name, x in arrays.items()}


# --- best-first search ------------------------------------------------------------------------------


class Best:
    """The best k documents so far of every item, by score and then by smaller doc_id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((items, k), np.int64), np.full((items, k), NO_ID)

    def may_enter(self, item: np.ndarray, bound: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        last = self.score[item, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (least_doc < self.doc[item, -1]))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        some = np.unique(item)
        item = np.concatenate([np.repeat(some, self.k), item])
        score, doc = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.doc[some].ravel(), doc])
        order = np.lexsort((doc, -score, item))
        order = order[_place_in_group(item[order]) < self.k]
        self.score[some], self.doc[some] = score[order].reshape(-1, self.k), doc[order].reshape(-1, self.k)


def _place_in_group(sorted_keys: np.ndarray) -> np.ndarray:
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, sorted_keys)


def walk(tree: Tree, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Search a shard for items (rows item, term, weight, sorted by item) and enter what is found into ``best``."""
    at = np.minimum(np.searchsorted(tree.terms, term), len(tree.terms) - 1)
    there = tree.terms[at] == term
    item, at, weight = item[there], at[there], weight[there]
    place = _place_in_group(item)
    asking, row = np.unique(item, return_inverse=True)
    first = 0
    while first < len(asking):
        # as many items as fit, if all their nodes were open at once
        width = int(place[row == first].max()) + 1
        some = max(1, FRONTIER_BYTES // (8 * width * len(tree.ids)))
        mine = (row >= first) & (row < first + some)
        _walk(tree, asking[first : first + some], row[mine] - first, place[mine], at[mine], weight[mine], best)
        first += some


def _walk(tree: Tree, asking: np.ndarray, row: np.ndarray, place: np.ndarray, at: np.ndarray, weight: np.ndarray, best: Best) -> None:
    shape = (len(asking), int(place.max()) + 1)
    lo, hi, w = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int64)
    lo[row, place], hi[row, place], w[row, place] = tree.offsets[at], tree.offsets[at + 1], weight

    def bounds(depth, lo, hi, item):
        return (np.where(hi > lo, tree.impact[depth[:, None], lo], 0) * w[item]).sum(axis=1)

    item = np.arange(len(asking))
    depth, prefix = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    bound = bounds(depth, lo, hi, item)
    while len(item):
        alive = best.may_enter(asking[item], bound, tree.ids[prefix << (tree.depth - depth)])
        order = np.flatnonzero(alive)
        order = order[np.lexsort((-bound[order], item[order]))]
        now = _place_in_group(item[order]) < AT_A_TIME
        opened, rest = order[now], order[~now]
        level, s, e = depth[opened][:, None], lo[opened], hi[opened]
        zs, ze, z = tree.rank0[level, s], tree.rank0[level, e], tree.zeros[level]
        both = lambda x, y: np.concatenate([x, y])
        c_item, c_depth, c_prefix = np.tile(item[opened], 2), np.tile(depth[opened] + 1, 2), both(prefix[opened] * 2, prefix[opened] * 2 + 1)
        c_lo, c_hi = both(zs, z + s - zs), both(ze, z + e - ze)
        c_bound = bounds(c_depth, c_lo, c_hi, c_item)
        leaf = (c_depth == tree.depth) & (c_bound > 0)
        if leaf.any():
            best.add(asking[c_item[leaf]], c_bound[leaf], tree.ids[c_prefix[leaf]])
        inner = np.flatnonzero((c_depth < tree.depth) & (c_bound > 0))
        item, depth, prefix, bound, lo, hi = (
            both(old[rest], new[inner]) for old, new in ((item, c_item), (depth, c_depth), (prefix, c_prefix), (bound, c_bound), (lo, c_lo), (hi, c_hi))
        )


# --- Spark jobs ---------------------------------------------------------------------------------------


def terms_in(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, n): how often each term stands in each row's ``text``; keys stay as they are."""

    def run(frames):
        for pdf in frames:
            for term, row in term_blocks(pdf["text"].tolist()):
                yield pd.DataFrame({key: pdf[key].iloc[row].to_numpy(), "term": term, "n": 1})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text_of().alias("text")).mapInPandas(run, f"{key} {kind}, term long, n int").groupBy(key, "term").agg(F.sum("n").alias("n"))


def collection(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""
    n = F.size(F.regexp_extract_all(text_of(), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def build(docs: DataFrame, n_docs: int, n_words: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row of ``INDEX`` per shard."""

    def run(frames):
        ids, term, doc, size = [], [], [], 0

        def shard():
            row = tree_row(np.concatenate(ids), np.concatenate(term), np.concatenate(doc), n_docs, n_words) if size else None
            return [pd.DataFrame([row])] if row else []

        for pdf in frames:
            before = sum(map(len, ids))
            ids.append(pdf["doc_id"].to_numpy(np.int64))
            for h, i in term_blocks(pdf["text"].tolist()):
                term.append(h)
                doc.append(i + before)
                size += len(h)
            if size >= shard_words:
                yield from shard()
                ids, term, doc, size = [], [], [], 0
        yield from shard()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    return docs.select(key.alias("doc_id"), text_of().alias("text")).mapInPandas(run, INDEX)


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Of the given terms (sorted), how many documents hold each. The driver gets a row per term."""
    aware = index.sparkSession.sparkContext.broadcast(terms)

    def run(frames):
        asked, n = aware.value, np.zeros(len(aware.value), np.int64)
        for pdf in frames:
            for held, offsets in zip(pdf["terms"], pdf["offsets"], strict=True):
                held, offsets = np.frombuffer(held, np.int64), np.frombuffer(offsets, np.int64)
                at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
                n += np.where(held[at] == asked, offsets[at + 1] - offsets[at], 0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"term": asked[some], "n": n[some]})

    counts = index.select("terms", "offsets").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}


def _ask(index: DataFrame, rows: list, n_docs: int, k: int, item_type: str) -> DataFrame:
    """(item_id, doc_id, score): the best k of every task for a block of items; ``rows`` are (item_id, term, n)."""
    terms = np.unique(np.array([r["term"] for r in rows], np.int64))
    df = document_frequencies(index, terms)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in terms.tolist()}
    of: dict = {}
    for r in rows:
        if w := r["n"] * weight[r["term"]]:
            of.setdefault(r["item_id"], []).append((r["term"], w))
    # items with the most terms first, as those walked together take the room of the widest
    names = sorted(of, key=lambda i: -len(of[i]))
    flat = [(no, term, w) for no, name in enumerate(names) for term, w in of[name]]
    aware = index.sparkSession.sparkContext.broadcast((names, *np.array(flat, np.int64).reshape(-1, 3).T.copy()))

    def run(frames):
        names, item, term, weight = aware.value
        best = Best(len(names), k)
        for pdf in frames:
            for row in pdf.to_dict("records"):
                walk(Tree.load(row), item, term, weight, best)
        no, place = np.nonzero(best.score)
        doc = best.doc[no, place]
        yield pd.DataFrame({"item_id": pd.Series([names[i] for i in no], dtype=object), "doc_id": pd.Series([None if d == NO_ID else d for d in doc.tolist()], dtype=object), "score": best.score[no, place]})

    return index.mapInPandas(run, f"item_id {item_type}, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k best documents with a score above 0."""
    terms = cut(terms_in(items, "item_id"), "lexical-items")
    blocks = max(1, -(-terms.count() // block_terms))
    item_type = terms.schema["item_id"].dataType.simpleString()
    found = []
    for b in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found.append(cut(_ask(index, rows, n_docs, k, item_type), "lexical-found"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, shard_words: int = SHARD_WORDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Index all documents and search them for all items."""
    with scratch(docs.sparkSession):
        n_docs, n_words = collection(docs)
        index = cut(build(docs, n_docs, n_words, shard_words), "lexical-index")
        return finish(search(index, items, n_docs, k, block_terms), "lexical-ranked")


def op13_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), s AS (SELECT count(*) FILTER (len(ts) > 0) AS all_docs, sum(len(ts))::BIGINT AS all_terms FROM lowered),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
),
p AS (SELECT doc_id, len AS n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM lowered) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, len, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
c AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 20
"""
