"""Recognition over streams of sample blocks: windows are cut as sound comes in, heard, and kept.

Blocks (file_id, block_no, samples, total, last) come in order per file: ``total`` is the file's length in seconds where it
is known, ``last`` marks its last block. Each block's speech is found as it comes and stitched to what came before. A
window is cut as soon as the sound reaches past its search range (and, where the length is not known, a quarter of a
window past its mark), is heard at once, and leaves the state together
with its samples and stretches, so the state of a file holds less than a window, its search range and a block.
Windows go into a keyed table, batch by batch, from which :func:`timedtext.plans.recognition.transcribe` may take them too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.cuts import may_end, nearest_pause_of

#: samples, rate -> [(start, end) of speech in seconds]
FindSpeech = Callable[[np.ndarray, float], list[tuple[float, float]]]
#: samples of a window, rate -> [(start, end, text, words as (start, end, word, p))], in seconds from the window's start
Hear = Callable[[np.ndarray, float], list[tuple]]
PIECE = 1 << 18  # samples held in one value of the state
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCKS = "file_id string, block_no long, samples array<float>, total double, last boolean"
WINDOWS = "file_id string, idx int, a double, b double, segments array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string,p:double>>>>, held double"


class Windows(StatefulProcessor):
    def __init__(self, rate: float, find_speech: FindSpeech, hear: Hear, window: float, search: float, margin: float = 0.25, join_under: float = 0.05):
        self.rate, self.find_speech, self.hear = rate, find_speech, hear
        self.window, self.search, self.margin, self.join_under = window, search, margin, join_under

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: the last edge, the number of the next window, the place of the first sample held, how many have come, and the stretches since
        self.place = handle.getValueState("place", "edge double, idx int, first long, seen long, a array<double>, b array<double>")
        #: samples since the last edge, as float32 in pieces; every call to a state is a round trip, so there are few
        self.samples = handle.getListState("samples", "piece binary")

    def _at(self, t: float) -> int:
        return round(t * self.rate)

    def _edge(self, edge: float, speech: list[list[float]], seen: float) -> float:
        heard = np.array(speech, float).reshape(-1, 2)
        starts, stops = np.concatenate([[0.0], heard[:, 1]]), np.concatenate([heard[:, 0], [seen]])
        pause = stops > starts
        at = nearest_pause_of(starts[pause], stops[pause], edge + self.window, edge, self.search, self.margin)
        return round(edge + self.window if at is None else at, 3)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edge, idx, first, seen, *heard = self.place.get() or (0.0, 0, 0, 0, [], [])
        speech = [list(r) for r in zip(*heard, strict=True)]
        fresh: list[np.ndarray] = []  # blocks that came now
        held: np.ndarray | None = None  # all samples since the last edge, read when a window is cut
        out: list[tuple] = []

        def finish(until: float) -> None:
            nonlocal edge, idx, first, held, fresh
            kept = [held] if held is not None else [np.frombuffer(r[0], np.float32) for r in self.samples.get()]
            held, fresh = np.concatenate([*kept, *fresh]), []
            cut = min(self._at(until), seen) - first
            said = [(round(a + edge, 3), round(b + edge, 3), text, [(round(x + edge, 3), round(y + edge, 3), w, p) for x, y, w, p in words]) for a, b, text, words in self.hear(held[:cut], self.rate)]
            held, first = held[cut:], first + cut
            out.append((key[0], idx, edge, until, said, len(held) / self.rate))
            edge, idx = until, idx + 1
            speech[:] = [s for s in speech if s[1] > until]

        frames = list(rows)
        came = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values("block_no")
        for samples, told, is_last in zip(came["samples"], came["total"], came["last"], strict=True):
            new = np.asarray(samples, np.float32)
            before = seen / self.rate
            for a, b in self.find_speech(new, self.rate):
                if speech and a + before - speech[-1][1] < self.join_under:
                    speech[-1][1] = b + before
                else:
                    speech.append([a + before, b + before])
            fresh.append(new)
            seen += len(new)
            now = seen / self.rate
            total = 0.0 if told is None or np.isnan(told) else told
            while may_end(edge, self.window, self.search, now, now if is_last else total, is_last):
                finish(self._edge(edge, speech, now))
            if is_last and now > edge:
                finish(round(now, 3))
        self.place.update((edge, idx, first, seen, [x for x, _ in speech], [x for _, x in speech]))
        whole = np.concatenate([*([] if held is None else [held]), *fresh, np.zeros(0, np.float32)])
        pieces = [(whole[i : i + PIECE].tobytes(),) for i in range(0, len(whole), PIECE)]
        if held is None:
            if pieces:
                self.samples.appendList(pieces)
        elif pieces:  # a window went, and its samples with it
            self.samples.put(pieces)
        else:
            self.samples.clear()
        if out:
            yield pd.DataFrame(out, columns=["file_id", "idx", "a", "b", "segments", "held"])

    def close(self) -> None:
        pass


def hear_blocks(blocks: DataFrame, rate: float, find_speech: FindSpeech, hear: Hear, window: float = 600.0, search: float | None = None) -> DataFrame:
    """A stream of blocks -> a stream of windows with their segments; ``held`` is the sound left in the state, in seconds."""
    reach = min(60.0, window / 2) if search is None else search
    return blocks.groupBy("file_id").transformWithStateInPandas(statefulProcessor=Windows(rate, find_speech, hear, window, reach), outputStructType=WINDOWS, outputMode="append", timeMode="none")


def keep_windows(windows: DataFrame, table, key: str, checkpoint: str):
    """Start a query that puts every batch's windows into a table of :func:`timedtext.plans.recognition.window_table`; a batch run twice counts once.

    The state is kept by RocksDB, which this processor asks for.
    """
    from ..plans.recognition import _typed
    from ..plans.storage import shared_path

    spark = windows.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        path = shared_path(spark, f"heard-{number}")
        batch.write.parquet(path)
        rows = spark.read.schema(WINDOWS).parquet(path)
        each = _typed(rows.select("file_id", "idx", F.explode_outer("segments").alias("s"), F.monotonically_increasing_id().alias("n")).select("file_id", "idx", "n", "s.*"))
        fields = [c for c in each.columns if c not in ("file_id", "idx", "n")]
        listed = each.filter("start is not null").groupBy("file_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("segments"))
        full = rows.drop("segments", "held").join(listed, ["file_id", "idx"], "left").withColumn("segments", F.coalesce("segments", F.array()))
        zero = F.lit(0).cast("long")
        table.put(full.select("file_id", F.lit(key).alias("key"), "idx", "a", "b", "segments", zero.alias("holes"), F.lit(0.0).alias("seconds"), zero.alias("recovered")))

    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return windows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if own is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, own)
