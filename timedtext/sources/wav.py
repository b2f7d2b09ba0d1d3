"""Uncompressed sound as tables: WAV files of 16-bit mono samples, read in blocks by several tasks, as a batch or a stream.

The driver reads headers alone. A file's samples are at known places, so each task reads its own range of blocks and
nothing before it. Other codings need a decoder, which is not part of this library: such a file is an error that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import open_folder

FORMAT, RATE = "wav_blocks", 16_000
SCHEMA = "file_id string, block_no bigint, t0 double, samples array<float>, total double, last boolean"
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Sound:
    path: str
    name: str
    at: int  # of the first sample in the file
    samples: int
    rate: int


@dataclass
class Blocks(InputPartition):
    sound: Sound
    first: int
    stop: int


def header_of(file, path: str) -> tuple[int, int, int]:
    """(place of the first sample, how many, rate) of an open WAV file."""
    size = file.size()
    start = file.read(12)
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError(f"{path} is not a WAV file")
    rate, place = None, 12
    while place + 8 <= size:
        file.seek(place)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if (coding, channels, bits) != (1, 1, 16):
                raise ValueError(f"{path} needs a decoder: coding {coding}, {channels} channels, {bits} bits")
        elif kind == b"data":
            if rate is None:
                break
            return place + 8, min(length, size - place - 8) // 2, rate
        place += 8 + length + length % 2
    raise ValueError(f"{path} has no samples")


def sounds_in(path: str) -> list[Sound]:
    """The WAV files of a folder, older ones first."""
    from pyarrow import fs

    files, base = open_folder(path)
    infos = [i for i in files.get_file_info(fs.FileSelector(base)) if i.is_file and i.base_name.lower().endswith(".wav")]
    out = []
    for info in sorted(infos, key=lambda i: (i.mtime_ns or 0, i.base_name)):
        with files.open_input_file(info.path) as file:
            out.append(Sound(info.path, info.base_name, *header_of(file, info.path)))
    return out


class _Reader:
    def __init__(self, options):
        self.path, self.seconds = options["path"], float(options.get("block_s", "60"))
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def block(self, sound: Sound) -> int:
        return max(1, int(self.seconds * sound.rate))

    def count(self, sound: Sound) -> int:
        return -(-sound.samples // self.block(sound))

    def split(self, sound: Sound, first: int, stop: int) -> list[Blocks]:
        step = max(1, self.part_bytes // (2 * self.block(sound)))
        return [Blocks(sound, k, min(k + step, stop)) for k in range(first, stop, step)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        import numpy as np

        sound, block = partition.sound, self.block(partition.sound)
        files, _ = open_folder(self.path)
        with files.open_input_file(sound.path) as file:
            for k in range(partition.first, partition.stop):
                file.seek(sound.at + 2 * k * block)
                n = min(block, sound.samples - k * block)
                samples = np.frombuffer(file.read(2 * n), "<i2").astype(np.float32) / np.float32(32768)
                yield sound.name, k, k * block / sound.rate, samples.tolist(), sound.samples / sound.rate, k == self.count(sound) - 1


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Blocks]:
        return [p for s in sounds_in(self.path) for p in self.split(s, 0, self.count(s))]


class StreamReader(_Reader, DataSourceStreamReader):
    """An offset counts the blocks of all files, older files first; files may be added, not changed."""

    def initialOffset(self) -> dict:
        return {"blocks": 0}

    def latestOffset(self) -> dict:
        return {"blocks": sum(self.count(s) for s in sounds_in(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        out, before = [], 0
        for s in sounds_in(self.path):
            n = self.count(s)
            out += self.split(s, max(0, start["blocks"] - before), min(n, end["blocks"] - before))
            before += n
        return out

    def commit(self, end: dict) -> None:
        pass


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def _configured(reader, block_s: float, part_bytes: int):
    return reader.format(FORMAT).option("block_s", str(block_s)).option("part_bytes", str(part_bytes))


def read_wav(spark: SparkSession, path: str, block_s: float = 60.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Blocks of exactly ``block_s`` seconds of all WAV files in a folder, each file's last one shorter."""
    spark.dataSource.register(WavBlocks)
    return _configured(spark.read, block_s, part_bytes).load(path)


def stream_wav(spark: SparkSession, path: str, block_s: float = 60.0, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(WavBlocks)
    return _configured(spark.readStream, block_s, part_bytes).load(path)


def wav_of(samples: Column, rate: int = RATE) -> Column:
    """A WAV file as binary, of an array of 16-bit whole numbers."""
    little = lambda n, width: F.reverse(F.transform(F.sequence(F.lit(1), F.lit(2 * width), F.lit(2)), lambda i: F.substr(F.lpad(F.hex(n), 2 * width, "0"), i, F.lit(2))))
    as_hex = lambda n, width: F.array_join(little(n, width), "")
    data = F.array_join(F.transform(samples, lambda x: as_hex(F.pmod(x.cast("long"), F.lit(65536)), 2)), "")
    size = (F.size(samples) * 2).cast("long")
    fixed = lambda *numbers: struct.pack("<IHHIIHH", *numbers).hex()
    head = F.concat(F.lit(b"RIFF".hex()), as_hex(size + 36, 4), F.lit(b"WAVEfmt ".hex() + fixed(16, 1, 1, rate, 2 * rate, 2, 16) + b"data".hex()), as_hex(size, 4))
    return F.unhex(F.concat(head, data))
