"""64-bit keys that occur more than once, found in blocks: tasks deal sorted arrays of keys by hash, not a row for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

KEYS_AT_ONCE = 500_000
BLOCK = "part int, keys binary, several binary, places binary"


def merged(key: np.ndarray, several: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key with its smallest place (a row of ``places``), and whether it has several; without columns in ``places`` every occurrence counts."""
    order = np.argsort(key, kind="stable")
    key, several, places = key[order], several[order], places[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    again = ~new | np.concatenate([~new[1:], [False]])[: len(key)]
    if not places.shape[1]:
        return key[new], (several | again)[new], places[new]
    if again.any():
        # only the places of keys that come again need an order
        at = np.flatnonzero(again)
        by = at[np.lexsort((*places[at].T[::-1], key[at]))]
        places[at], several[at] = places[by], several[by]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        other = (places[at] != places[first[group[at]]]).any(axis=1)
        several[first] = np.bincount(group, several, len(first)) + np.bincount(group[at], other, len(first)) > 0
    return key[new], several[new], places[new]


def repeated(df: DataFrame, *place: str) -> DataFrame:
    """(keys array<long>, place columns, each a whole number for all of a row's keys or an array with one for each) -> (key, place columns).

    These are the keys in several places, with the smallest place; without ``place``, those that occur several times.

    A task merges its own keys before it deals them, so one that is everywhere comes once from each half a million of keys.
    """
    n, width = partitions(df.sparkSession), len(place)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list) -> pa.RecordBatch:
            key, several, places = merged(*[np.concatenate(x) for x in zip(*held, strict=True)])
            part = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(n)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
            columns = [pa.array([x[order[lo:hi]].tobytes() for lo, hi in cuts], pa.binary()) for x in (key, several, places)]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *columns], ["part", "keys", "several", "places"])

        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        held, size = [], 0
        for b in batches:
            key, sizes = flat(b.column(0)), pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
            each = [flat(c) if pa.types.is_list(c.type) else np.repeat(c.to_numpy(), sizes) for c in b.columns[1:]]
            places = np.stack(each, axis=1).astype(np.int64) if width else np.zeros((len(key), 0), np.int64)
            held.append((key, np.zeros(len(key), bool), places))
            size += len(key)
            if size >= KEYS_AT_ONCE:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = (np.int64, bool, np.int64), []
        for b in batches:
            for x in zip(*[b.column(c).to_pylist() for c in ("keys", "several", "places")], strict=True):
                key, several, places = [np.frombuffer(y, kind) for y, kind in zip(x, kinds, strict=True)]
                held.append((key, several, places.reshape(len(key), width)))
        if held:
            key, several, places = merged(*[np.concatenate(x) for x in zip(*held, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(key[several]), *[pa.array(places[several, i]) for i in range(width)]], ["key", *place])

    dealt = df.mapInArrow(blocks, BLOCK).repartition(n, F.col("part"))
    return dealt.mapInArrow(found, ", ".join(f"{c} long" for c in ["key", *place]))
