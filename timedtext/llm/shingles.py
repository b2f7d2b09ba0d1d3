"""Word shingles of whole texts as 64-bit hashes, DartMinHash signatures and band keys, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
AT_ONCE = 1_000_000
DARTS_AHEAD = 4_096
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        n = max(n, AT_ONCE * 2)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs of anything but ASCII white space, lower-cased), and where each text's words begin (n + 1)."""
    return words_in(texts)[:2]


def words_in(texts: list[str]) -> tuple[np.ndarray, ...]:
    """:func:`word_hashes`, then the lower-cased bytes of all texts and where in them each word starts and stops."""
    raw = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), np.uint8)
    blank = SPACE[b]
    edge = np.diff(np.concatenate([[True], blank]).view(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    h = mix((sums[stop] - sums[start]) * down[start])
    return h, np.concatenate([[0], np.searchsorted(start, ends)]), b, start, stop


def grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= AT_ONCE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def shingles_in_order(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hash of the shingle that starts at each word, over the ends of texts too."""
    s = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(s)]
    return mix(s)


def sequence_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words ``lo`` to ``hi`` (not included), the same wherever they stand."""
    up, down = _powers(len(h) + 1)
    order = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((order[hi] - order[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingle_bags(texts: list[str], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Per text: its distinct shingle hashes in order, how often each occurs, a hash of its word sequence, and its number of words.

    A text of fewer words than a shingle has one shingle, of all its words; one without words has none.
    """
    with np.errstate(over="ignore"):
        for _, some in grouped(texts):
            h, at = word_hashes(some)
            s = shingles_in_order(h, words)
            for lo, hi, whole in zip(at[:-1].tolist(), at[1:].tolist(), sequence_hash(h, at[:-1], at[1:]).tolist(), strict=True):
                n = hi - lo
                if n >= words:
                    yield *np.unique(s[lo : hi - words + 1], return_counts=True), whole, n
                else:
                    yield np.full(min(n, 1), whole, np.uint64), np.ones(min(n, 1), np.int64), whole, n


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bag as a set: the k-th occurrence of a shingle is an element of its own.

    The Jaccard similarity of two such sets is the weighted Jaccard similarity of the bags.
    """
    if len(elements) == counts.sum():
        return elements
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.repeat(elements, counts)
    with np.errstate(over="ignore"):
        return np.unique(np.where(k > 0, mix(flat + k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), flat))


def dart_signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """DartMinHash: one row of ``k`` darts per weighted set.

    Darts fall on (element, weight, rank) as a Poisson process that depends on the element alone: in each
    band of weights ([0, 1), [1, 2), [2, 4), ...) ranks arrive with exponential gaps, and a dart's place in
    the band and its coordinate are hashes. A set is hit by the darts that lie below its elements' weights;
    per coordinate the hit of lowest rank is kept. Only darts up to a rank are thrown, enough for
    k (ln k + 3) hits; sets with an empty coordinate get twice as many, until none is empty. Rows of
    empty sets are 0. Two sets agree in a coordinate with the chance of their weighted Jaccard similarity.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    mass = np.array([float(w.sum()) for w in weights])
    reach = k * (np.log(k) + 3.0)
    with np.errstate(over="ignore"):
        while len(todo):
            size = np.array([len(sets[i]) for i in todo])
            element = np.concatenate([sets[i] for i in todo])
            row = np.repeat(np.arange(len(todo)), size)
            limit = np.repeat(reach / mass[todo], size)
            weight = np.concatenate([weights[i] for i in todo]).astype(np.float64)
            best = np.full(len(todo) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
            low, band = 0.0, 0
            while len(element):
                width = max(low, 1.0)
                h = mix(element + np.uint64(((seed * 64 + band) * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF))
                row_of, limit_of, weight_of, last, j = row, limit, weight, np.zeros(len(h)), 0
                while len(h):
                    # some thousand darts at once, so that the last elements, with most darts each, take few steps
                    ahead = max(1, min(64, DARTS_AHEAD // len(h)))
                    turns = (2 * np.arange(j, j + ahead, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE)
                    u = mix(h[:, None] + turns)
                    gaps = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                    gaps[:, 0] += last
                    ranks = np.cumsum(gaps, axis=1)
                    near = ranks <= limit_of[:, None]
                    at = np.repeat(np.arange(len(h)), near.sum(axis=1))
                    r, w, u, rank, more = row_of[at], weight_of[at], u[near], ranks[near], near[:, -1]
                    h, row_of, limit_of, weight_of, last = h[more], row_of[more], limit_of[more], weight_of[more], ranks[more, -1]
                    v = mix(u ^ np.uint64(0x5851F42D4C957F2D))
                    dart = (rank.view(np.uint64) & ~np.uint64(0xFFFFFF)) | (v & np.uint64(0xFFFFFF))
                    cell = r * k + ((v >> np.uint64(24)) % np.uint64(k)).astype(np.int64)
                    if band or (weight < 1).any():  # else every dart of the band lies under its element's weight
                        place = low + width * (mix(v) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                        cell, dart = cell[place < w], dart[place < w]
                    np.minimum.at(best, cell, dart)
                    j += ahead
                low = width if band == 0 else low * 2
                band += 1
                more = weight > low
                element, row, limit, weight = element[more], row[more], limit[more], weight[more]
            best = best.reshape(len(todo), k)
            full = (best != np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            out[todo[full]] = best[full]
            todo, reach = todo[~full], reach * 2
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of ``k / bands`` coordinates; the band's number is part of it."""
    n, k = signatures.shape
    rows = k // bands
    with np.errstate(over="ignore"):
        h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(BASE), (n, 1))
        for j in range(rows):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + signatures[:, j::rows][:, :bands])
    return h.view(np.int64)
