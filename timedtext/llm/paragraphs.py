"""Substring dedup by paragraphs: MinHash banding, exact Jaccard verification, removal by components.

Paragraphs are lines and, as repeated passages also stand inside longer lines, the parts of lines: they are
cut after sentences of some words, and parts of over ``LONG`` words without sentence marks at places that
their own words choose. Lines with at least ``LEAST_WORDS`` words, and such parts of lines of over ``LONG`` words, go through
the same banded join as documents do, as bags of five-word shingles with bands tuned for recall (a pair
at similarity 0.8 is missed with a chance of about 1 in 10,000), and are linked at an exact weighted
Jaccard similarity of 0.8 or more. The other parts are classes of equal words. And of every ``SPACING``
neighbouring runs of ``ANCHOR`` words the one with the smallest hash is an anchor (winnowing), so that any
``LEAST_WORDS`` equal words hold an equal anchor, wherever they stand and whatever their marks, and the
anchors inside a passage touch; runs that short are similar at 0.8 only if they are equal, so they have no
bands. Where a passage's anchors end, its words are compared with those of the first place, one by one, for
``REACH`` words to both sides.

Classes that are linked are one component, whose first place, by doc_id and word, stays. Repeated places
of a document that lie at most ``GAP_WORDS`` apart make one run; the places of runs that reach over at
least ``LEAST_WORDS`` words are reported, joined where they touch, and removed but for first places. Words
between them that were not found again are neither. Places are counted in words (runs of anything but ASCII
white space), so spans hold for the original text.

Defined cases: a document is a doc_id together with its text, so rows that share a doc_id but not the
text never meet each other's places, and rows that repeat both are one document; null and empty texts have
no paragraphs; a paragraph repeated within one text is removed there too; ties go to the smaller
doc_id and then the earlier word; documents with a null doc_id are neither compared nor changed; a document
that loses all it has is dropped by :func:`remove_repeats`, one that was empty before stays; an empty
table gives an empty result; extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_part, drop_tables, finish, forget_shuffles, free_name, scratch, table, text_of
from .neardup import THRESHOLD, shared_buckets, verified_links
from .repeats import repeated
from .shingles import WORDS, band_keys, dart_signatures, grouped, mix, occurrences, sequence_hash, shingles_in_order, words_in

COORDINATES, BANDS = 18, 9
LEAST_WORDS = 20
SENTENCE_WORDS, SEGMENT_WORDS = 6, 4
LONG, APART, NESTED = 64, 16, 0.6
SPACING, REACH = 10, 16
ANCHOR = LEAST_WORDS - SPACING + 1
GAP_WORDS = 4
DARTS_AT_ONCE = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = ["doc_id", "text_hash"]
SPAN = "doc_id long, text_hash long, word int, n_words int, key1 long, key2 long, bands array<long>, words array<int>"


def edges(h: np.ndarray, at: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word: is it the last one of its line, and is it the last one of its part of the line."""
    broken = np.concatenate([[0], np.cumsum(b == 10)])
    line_end = np.ones(len(h), bool)
    line_end[:-1] = broken[start[1:]] > broken[stop[:-1]]
    line_end[at[1:][at[1:] > 0] - 1] = True
    last, before = b[stop - 1], b[np.maximum(stop - 2, start)]
    mark = lambda x: (x == 46) | (x == 33) | (x == 63)  # noqa: E731  . ! ?
    closing = (last == 34) | (last == 39) | (last == 41) | (last == 93)
    wide = stop - start >= 3
    third = b[np.maximum(stop - 3, 0)]
    wide &= ((third == 0xE3) & (before == 0x80) & (last == 0x82)) | ((third == 0xEF) & (before == 0xBC) & ((last == 0x81) | (last == 0x9F)))
    sentence = mark(last) | (closing & mark(before)) | wide
    here = np.arange(len(h))
    past = np.concatenate([[-1], np.maximum.accumulate(np.where(sentence | line_end, here, -1))[:-1]])
    ends = line_end | (sentence & (here - past >= SENTENCE_WORDS))
    return line_end, chosen_cuts(h, ends)


def chosen_cuts(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends``, with parts of over ``LONG`` words cut before runs of three words whose hash is the least of all within ``APART`` words."""
    n = len(h) - 2
    stops = np.flatnonzero(ends)
    sizes = np.diff(np.concatenate([[-1], stops]))
    wide = np.repeat(sizes > LONG, sizes)
    if n <= 2 * APART or not wide.any():
        return ends
    key = shingles_in_order(h, 3)
    least = np.ones(n, bool)
    least[:APART] = least[n - APART :] = False
    for j in range(1, APART + 1):
        least[j:] &= key[j:] < key[:-j]
        least[:-j] &= key[:-j] <= key[j:]
    cuts = np.flatnonzero(least & wide[:n] & (np.arange(n) > 0)) - 1
    out = ends.copy()
    out[cuts[wide[cuts]]] = True
    return out


def anchors(h: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors begin, and their keys. Of equal ones (runs of one word) every ``SPACING``th is taken."""
    here = np.arange(max(0, len(h) - ANCHOR + 1))
    n = len(here) - SPACING + 1
    if n <= 0:
        return here[:0], np.zeros(0, np.uint64)
    key = sequence_hash(h, here, here + ANCHOR)
    order = (key & ~np.uint64(15)) | ((here - at[owner[here]]) % SPACING).astype(np.uint64)
    best, least, size = order, here, 1
    while size < SPACING:  # the least of ever more neighbours, the earlier of equal ones
        by = min(size, SPACING - size)
        less = best[by:] < best[:-by]
        best, least, size = np.where(less, best[by:], best[:-by]), np.where(less, least[by:], least[:-by]), size + by
    chosen = np.unique(least[owner[:n] == owner[np.arange(n) + SPACING + ANCHOR - 2]])
    return chosen, key[chosen]


def bags(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each run ``lo`` to ``hi`` (not included): its distinct elements and how often each occurs."""
    if not len(lo):
        return []
    size = hi - lo
    past = np.cumsum(size)
    owner = np.repeat(np.arange(len(lo)), size)
    flat = s[np.arange(past[-1]) + np.repeat(lo - past + size, size)]
    # runs together, and in them equal elements: 40 bits of an element tell those of one run apart, or else it counts as two
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (flat >> np.uint64(24)))
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
    counts, at = np.diff(np.concatenate([first, [len(flat)]])), np.searchsorted(owner[first], np.arange(len(lo) + 1))
    flat = flat[first]
    return [(flat[x:y], counts[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _signed(sets: list[tuple[np.ndarray, np.ndarray]], k: int, bands: int) -> np.ndarray:
    """Band keys of all bags (elements, counts), so many shingles at once."""
    out, first, size = [np.zeros((0, bands), np.int64)], 0, 0
    for i, (s, _) in enumerate(sets):
        size += len(s)
        if size >= DARTS_AT_ONCE or i + 1 == len(sets):
            out.append(band_keys(dart_signatures([x for x, _ in sets[first : i + 1]], k, [n for _, n in sets[first : i + 1]]), bands))
            first, size = i + 1, 0
    return np.concatenate(out)


def spans(texts: DataFrame, least_words: int, k: int, bands: int) -> DataFrame:
    """(doc_id, text_hash, text) -> paragraphs as ``SPAN``, with ``bands`` empty, and once more with them those that not only equal words link.

    A document's anchors are one row: their keys of 64 bits in ``bands``, and where they begin in ``words``.
    """
    names = [f.split()[0] for f in SPAN.split(", ")]

    def of_group(docs: list[np.ndarray], texts: list[str]) -> Iterator[pa.RecordBatch]:
        h, at, b, start, stop = words_in(texts)
        if not len(h):
            return
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        line_end, part_end = edges(h, at, b, start, stop)
        again = mix(h ^ np.uint64(0x94D049BB133111EB))
        s = shingles_in_order(h)

        def ends(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            hi = np.flatnonzero(flag) + 1
            return np.concatenate([[0], hi[:-1]]), hi

        def lists(values: np.ndarray, past: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(past, pa.int32()), pa.array(values, kind))

        def batch(lo: np.ndarray, size: np.ndarray, key1: np.ndarray, key2: np.ndarray, bands: pa.Array, words: pa.Array) -> pa.RecordBatch:
            columns = [*[pa.array(d[owner[lo]], pa.int64()) for d in docs], pa.array(lo - at[owner[lo]], pa.int32()), pa.array(size, pa.int32()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), bands, words]
            return pa.RecordBatch.from_arrays(columns, names)

        (lo, hi), (plo, phi) = ends(line_end), ends(part_end)
        inner = (phi - plo >= SEGMENT_WORDS) & ~(np.isin(plo, lo) & np.isin(phi, hi) & (phi - plo >= least_words))  # the others are told as lines
        lines = hi - lo >= least_words
        # parts of lines that say much else; a part that is nearly its line would be linked with it
        room = np.repeat(hi - lo, hi - lo)[plo[inner]]
        wide = (room > LONG) & ((phi - plo)[inner] - WORDS + 1 < NESTED * (room - WORDS + 1))
        long = np.concatenate([np.ones(lines.sum(), bool), wide & (phi - plo >= least_words)[inner]])
        lo, hi = np.concatenate([lo[lines], plo[inner]]), np.concatenate([hi[lines], phi[inner]])
        signed = _signed(bags(s, lo[long], hi[long] - WORDS + 1), k, bands)
        for some, keys in ((long, signed), (np.ones(len(lo), bool), np.zeros((len(lo), 0), np.int64))):
            x, y = lo[some], hi[some]
            held = lists(keys.ravel(), np.arange(len(x) + 1) * keys.shape[1], pa.int64())
            yield batch(x, y - x, sequence_hash(h, x, y).view(np.int64), sequence_hash(again, x, y).view(np.int64), held, lists([], np.zeros(len(x) + 1), pa.int32()))
        lo, key = anchors(h, at, owner)
        if len(lo):
            of, first = np.unique(owner[lo], return_index=True)
            past, none = [*first, len(lo)], np.zeros(len(of), np.int64)
            yield batch(at[of], none + ANCHOR, none, none, lists(key.view(np.int64), past, pa.int64()), lists(lo - at[owner[lo]], past, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [b.column(c).to_numpy() for c in range(2)]
            with np.errstate(over="ignore"):
                for first, some in grouped(b.column(2).to_pylist()):
                    yield from of_group([d[first : first + len(some)] for d in docs], some)

    return texts.mapInArrow(run, SPAN)


def shingles_of_spans(texts: DataFrame) -> DataFrame:
    """(text, wanted: array of (word, n_words, id)) -> (id, shingles), every occurrence as an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in grouped(b.column(0).to_pylist()):
                asked = b.column(1).slice(first, len(some))
                word, size, ids = [asked.flatten().field(i).to_numpy() for i in range(3)]
                with np.errstate(over="ignore"):
                    h, at = words_in(some)[:2]
                    lo = np.repeat(at[:-1], pc.list_value_length(asked)) + word
                    sets = [occurrences(*x).view(np.int64) for x in bags(shingles_in_order(h), lo, lo + size - WORDS + 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in sets]]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def linked_paragraphs(texts: DataFrame, held: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Paragraphs by ``kind`` -> (key1, key2, c1, c2): classes that are linked with others, and their component's own class. Those with bands are deleted."""
    banded = held.filter("kind = 'banded'")
    # any place of a class will do, as its words are the same; columns of fixed width are grouped without a sort
    place = [*DOC, "word", "n_words"]
    firsts = [F.first(c).alias(c) for c in place] + [F.first(F.col("bands")[i]).alias(f"band{i}") for i in range(bands)]
    classes = banded.groupBy("key1", "key2").agg(*firsts).select("key1", "key2", F.struct(*place).alias("spot"), F.array(*[f"band{i}" for i in range(bands)]).alias("bands"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "par-classes")
    drop_part(held, "kind=banded")
    forget_shuffles(texts.sparkSession)
    shared = shared_buckets(classes.select("id", F.col("spot.n_words").alias("n_words"), "bands"), threshold)
    few = cut(classes.join(shared.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "par-few")
    drop_tables(classes)
    forget_shuffles(texts.sparkSession)
    classes = few
    wanted = cut(classes.groupBy("spot.doc_id", "spot.text_hash").agg(F.collect_list(F.struct("spot.word", "spot.n_words", "id")).alias("wanted")), "par-asked")
    forget_shuffles(texts.sparkSession)
    # one text of each document, which the join has dealt by document already
    sets = cut(shingles_of_spans(texts.join(wanted, DOC).dropDuplicates(DOC).select("text", "wanted")), "par-sets")
    forget_shuffles(texts.sparkSession)
    found = verified_links(classes.select("id", "bands"), shared, sets, threshold)
    heads = classes.select(F.col("id").alias("component"), F.col("key1").alias("c1"), F.col("key2").alias("c2"))
    return found.join(classes.select(F.col("id").alias("node"), "key1", "key2"), "node").join(heads, "component").select("key1", "key2", "c1", "c2")


def words_around(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text, wanted: words at which anchors begin) -> (doc_id, text_hash, word, before, after): hashes of the words next to each anchor, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(h: np.ndarray, lo: np.ndarray, size: np.ndarray, step: int) -> pa.Array:
            """``size`` words of ``h`` from each ``lo`` on, forward or backward."""
            past = np.cumsum(size)
            flat = h[np.repeat(lo, size) + step * (np.arange(size.sum()) - np.repeat(past - size, size))]
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], past]), pa.int32()), pa.array(flat, pa.int32()))

        for b in batches:
            for first, some in grouped(b.column(2).to_pylist()):
                docs, asked = [b.column(c).slice(first, len(some)).to_numpy() for c in range(2)], b.column(3).slice(first, len(some))
                with np.errstate(over="ignore"):
                    h, at = words_in(some)[:2]
                h, word, each = h.astype(np.uint32).view(np.int32), asked.flatten().to_numpy(), pc.list_value_length(asked).to_numpy()
                lo, end = np.repeat(at[:-1], each) + word, np.repeat(at[1:], each)
                before, after = lists(h, lo - 1, np.minimum(word, REACH), -1), lists(h, lo + ANCHOR, np.clip(end - lo - ANCHOR, 0, REACH), 1)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(d, each)) for d in docs], pa.array(word), before, after], [*DOC, "word", "before", "after"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, word int, before array<int>, after array<int>")


def grown(texts: DataFrame, met: DataFrame) -> DataFrame:
    """Anchors (DOC, word, first) that are not first places -> those at the ends of passages, with the equal words
    before and after them: (DOC, word, first, left, right)."""
    along = W.partitionBy(*DOC).orderBy("word", "first")
    same_first = [F.col(f"first.{c}") for c in DOC]

    def follows(step) -> Column:
        """The next anchor on one side touches this one, here and at the first place."""
        by = F.abs(F.col("word") - step("word").over(along))
        alike = reduce(lambda x, y: x & y, [step(c).over(along) == c for c in same_first])
        return F.coalesce((by <= ANCHOR) & alike & (F.abs(F.col("first.word") - step("first.word").over(along)) == by), F.lit(False))

    ends = cut(met.distinct().withColumn("inner", follows(F.lag) & follows(F.lead)).filter("not inner").drop("inner"), "par-ends")
    forget_shuffles(texts.sparkSession)
    spots = ends.select(*DOC, "word").unionByName(ends.select("first.*")).distinct()
    wanted = cut(spots.groupBy(*DOC).agg(F.collect_list("word").alias("wanted")), "par-wanted")
    forget_shuffles(texts.sparkSession)
    around = cut(words_around(texts.join(wanted, DOC).dropDuplicates(DOC).select(*DOC, "text", "wanted")), "par-around")
    forget_shuffles(texts.sparkSession)
    there = around.select(F.struct(*DOC, "word").alias("first"), F.col("before").alias("first_before"), F.col("after").alias("first_after"))

    def equal(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        end = F.array_position(same, False).cast("int")
        return F.when(end > 0, end - 1).otherwise(F.size(same))

    both = ends.join(around, [*DOC, "word"]).join(there, "first")
    forget_shuffles(texts.sparkSession)
    return cut(both.select(*DOC, "word", "first", equal("before", "first_before").alias("left"), equal("after", "first_after").alias("right")), "par-grown")


def passages(docs: DataFrame, least_words: int, threshold: float, k: int, bands: int) -> DataFrame:
    """One row per passage that occurs more than once: (DOC, word, n_words, first, kept)."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    kind = F.when(F.size("words") > 0, "anchors").when(F.size("bands") > 0, "banded").otherwise("plain")
    held = cut(spans(texts, least_words, k, bands).withColumn("kind", kind), "par-spans", "kind")
    with scratch(docs.sparkSession):
        linked = finish(linked_paragraphs(texts, held, threshold, bands), "par-linked")
    forget_shuffles(docs.sparkSession)
    anchored, other = held.filter("kind = 'anchors'"), held.filter("kind = 'plain'").select(*DOC, "word", "n_words", "key1", "key2")
    twice = other.groupBy("key1", "key2").agg(F.count("*").alias("n")).filter("n > 1").select("key1", "key2")
    heads = twice.join(linked, ["key1", "key2"], "full").select("key1", "key2", F.coalesce("c1", "key1").alias("c1"), F.coalesce("c2", "key2").alias("c2"))
    members = cut(other.join(heads.hint("shuffle_hash"), ["key1", "key2"]).select(*DOC, "word", "n_words", "c1", "c2"), "par-members")
    forget_shuffles(docs.sparkSession)
    spot = F.struct(*DOC, "word")
    # written, so that the join stands on two exchanges and a component with very many places can be split
    whole = F.struct(*DOC, "word", (-F.col("n_words")).alias("less"))
    first = members.groupBy("c1", "c2").agg(F.min(whole).alias("first"), F.max(spot).alias("last")).select("c1", "c2", F.struct(*[F.col(f"first.{c}").alias(c) for c in [*DOC, "word"]]).alias("first"), (F.col("first.word") - F.col("first.less")).alias("first_past"), "last")
    first = cut(first.filter("first != last").drop("last"), "par-first")
    # an anchor is a component by itself
    again = repeated(anchored.select("bands", *DOC, "words"), *DOC, "word")
    again = cut(again.select(F.col("key").alias("key1"), F.struct(*DOC, F.col("word").cast("int").alias("word")).alias("first")), "par-again")
    forget_shuffles(docs.sparkSession)
    anchor = anchored.select(*DOC, F.explode(F.arrays_zip("bands", "words")).alias("x")).select(*DOC, F.col("x.words").alias("word"), F.col("x.bands").alias("key1"))
    inside = members.withColumn("past", F.col("word") + F.col("n_words")).join(first.hint("shuffle_hash"), ["c1", "c2"]).withColumn("anchor", F.lit(False))
    met = anchor.join(again.hint("shuffle_hash"), "key1").withColumns({"past": F.col("word") + ANCHOR, "first_past": F.col("first.word") + ANCHOR, "anchor": F.lit(True)})
    placed = [x.select(*DOC, "word", "past", "first", "first_past", (spot == F.col("first")).alias("kept"), "anchor") for x in (inside, met)]
    placed = cut(placed[0].unionByName(placed[1]), "par-placed")
    drop_tables(held, members, first, again)
    forget_shuffles(docs.sparkSession)
    more = grown(texts, placed.filter("anchor and not kept").select(*DOC, "word", "first"))
    begin = F.col("first.word") - F.col("left")
    grown_first = F.struct(*[F.col(f"first.{c}").alias(c) for c in DOC], begin.alias("word"))
    ends = more.select(*DOC, (F.col("word") - F.col("left")).alias("word"), (F.col("word") + ANCHOR + F.col("right")).alias("past"), grown_first.alias("first"), F.lit(False).alias("kept"), (F.col("first.word") + ANCHOR).alias("guard"))
    heads_grown = more.groupBy("first").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    heads_grown = heads_grown.select(*[F.col(f"first.{c}").alias(c) for c in DOC], begin.alias("word"), (F.col("first.word") + ANCHOR + F.col("right")).alias("past"), grown_first.alias("first"), F.lit(True).alias("kept"), F.lit(None).cast("int").alias("guard"))
    placed = placed.select(*DOC, "word", "past", "first", "kept", F.when(~F.col("kept"), F.col("first_past")).alias("guard")).unionByName(ends).unionByName(heads_grown)
    # a place that overlaps its own first place (a text that repeats a few words, a part of a line) begins after it
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & F.col("guard").isNotNull()
    placed = placed.withColumn("word", F.when(own, F.greatest("word", "guard")).otherwise(F.col("word"))).filter("word < past")
    along = W.partitionBy(*DOC, "kept").orderBy("word", "past")
    reach = F.max("past").over(along.rowsBetween(W.unboundedPreceding, -1))
    opens = placed.withColumn("opens", F.coalesce(F.col("word") > reach + GAP_WORDS, F.lit(True)).cast("int"))
    opens = opens.withColumn("parts", F.coalesce(F.col("word") > reach, F.lit(True)).cast("int"))
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    pieces = opens.withColumns({"run": F.sum("opens").over(so_far), "piece": F.sum("parts").over(so_far)}).groupBy(*DOC, "kept", "run", "piece")
    out = pieces.agg(F.min("word").alias("word"), F.max("past").alias("past"), F.min("first").alias("first"))
    # the words between the pieces of a run were not compared: they count for its length and stay
    run = W.partitionBy(*DOC, "kept", "run")
    out = out.withColumn("reach", F.max("past").over(run) - F.min("word").over(run)).filter(F.col("reach") >= least_words).withColumn("n_words", F.col("past") - F.col("word"))
    return out.select(*DOC, "word", "n_words", "first", "kept")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, threshold: float = THRESHOLD, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """One row per passage that occurs more than once, copies and near copies alike:
    (doc_id, word, n_words, first_doc_id, first_word, kept)."""
    with scratch(docs.sparkSession):
        found = passages(docs, least_words, threshold, k, bands)
        return finish(found.select("doc_id", "word", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.word").alias("first_word"), "kept"), "repeated-passages")


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the spans (word, n_words); lines that go whole take their line break along."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for word, n in sorted(gone):
        word, past = min(word, len(at)), min(word + n, len(at))
        if past <= word:
            continue
        begin, end = at[word][0], at[past - 1][1]
        before = at[word - 1][1] if word else 0
        if word and (past == len(at) or "\n" not in text[before:begin]):
            begin = before
        else:
            end = at[past][0] if past < len(at) else len(text)
        out.append(text[done : max(done, begin)])
        done = max(done, end)
    return "".join(out) + text[done:]


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, threshold: float = THRESHOLD, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """``docs`` without the repeated passages but their first occurrence; ``n_chars`` follows the text where there is one."""
    names = docs.columns
    gone_id, gone_hash, gone_spans = (free_name(names, n) for n in ("gone_id", "gone_hash", "gone_spans"))
    with scratch(docs.sparkSession):
        found = passages(docs, least_words, threshold, k, bands).filter("not kept").groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).agg(F.collect_list(F.struct("word", "n_words")).alias(gone_spans))
        found = finish(found, "par-gone")
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(len(names)).to_pylist()
            kept, new = np.ones(b.num_rows, bool), b.column(text).to_pylist()
            for i, some in enumerate(gone):
                if some is not None and new[i] is not None:
                    new[i] = without(new[i], [(g["word"], g["n_words"]) for g in some])
                    kept[i] = bool(new[i].strip())
            columns = list(b.columns[:-1])
            columns[text] = pa.array(new, b.schema.field(text).type)
            if count >= 0:
                sizes = [len(t or "") if g is not None else n for t, g, n in zip(new, gone, b.column(count).to_pylist(), strict=True)]
                columns[count] = pa.array(sizes, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(kept))

    here = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64(text_of()) == F.col(gone_hash))
    rows = docs.join(found, here, "left").select(*[docs[f"`{c}`"] for c in names], gone_spans)
    return rows.mapInArrow(run, T.StructType(docs.schema.fields))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
