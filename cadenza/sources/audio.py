"""A data source of wav files that reads ranges of bytes: a row is the energy of a window, no row holds a file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "cadenza_wav"
SCHEMA = "stem string, window long, start_ms long, energy double"
#: Length of a window, and bytes of samples that a task reads.
WINDOW_MS, RANGE = 20, 8 << 20


@dataclass(frozen=True)
class Layout:
    """Where the samples of a wav file are, and what they look like."""

    begin: int
    size: int
    channels: int
    rate: int
    width: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def layout(read, length: int) -> Layout:
    """The layout of a file from its chunk headers; ``read(offset, n)`` gives bytes. A data chunk that was cut off ends with the file."""
    if read(0, 4) != b"RIFF" or read(8, 4) != b"WAVE":
        raise ValueError("no wav file")
    at, form = 12, None
    while at + 8 <= length:
        name, size = read(at, 4), struct.unpack("<I", read(at + 4, 4))[0]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if tag not in (1, 0xFFFE) or bits not in (8, 16, 24, 32):
                raise ValueError(f"samples of format {tag} and {bits} bits")
            form = channels, rate, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            return Layout(at + 8, min(size, length - at - 8), *form)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def samples(raw: bytes, width: int) -> np.ndarray:
    """Samples between -1 and 1."""
    if width == 1:
        return (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
    else:
        x = np.frombuffer(raw, dtype=f"<i{width}")
    return x.astype(np.float64) / (1 << (8 * width - 1))


@dataclass
class Part(InputPartition):
    """A range of a file's sample bytes."""

    path: str
    first: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.window_ms, self.range = int(options.get("window_ms", WINDOW_MS)), int(options.get("range", RANGE))

    def partitions(self) -> list[Part]:
        """Ranges by the lengths in the folder's listing; no file is opened here."""
        store, root = fs.FileSystem.from_uri(self.path)
        files = sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".wav")), key=lambda f: f.path)
        return [Part(f.path, first) for f in files for first in range(0, max(f.size, 1), self.range)]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        """The windows whose first byte is in the range; a folder without files has one range that is nothing."""
        if part is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.path) as f:

            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            x = layout(read, f.size())
            step = max(1, x.rate * self.window_ms // 1000) * x.frame
            windows = -(-(x.size // x.frame * x.frame) // step)
            lo, hi = (min(-(-(part.first + i * self.range) // step), windows) for i in (0, 1))
            stem = part.path.rpartition("/")[2].removesuffix(".wav")
            for at in range(lo, hi, 4096):
                end = min(hi, at + 4096)
                raw = read(x.begin + at * step, min(end * step, x.size // x.frame * x.frame) - at * step)
                square = samples(raw, x.width) ** 2
                starts = np.arange(end - at) * (step // x.width)
                sizes = np.diff(np.append(starts, len(square)))
                energy = np.sqrt(np.add.reduceat(square, starts) / sizes)
                number = np.arange(at, end)
                yield pa.record_batch([pa.array([stem] * (end - at)), pa.array(number), pa.array(number * step // x.frame * 1000 // x.rate), pa.array(energy)], names=["stem", "window", "start_ms", "energy"])


class Wav(DataSource):
    """Windows of the wav files of a folder: options ``path``, ``window_ms`` and ``range``, the bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def energies(spark: SparkSession, folder: str, window_ms: int = WINDOW_MS, size: int = RANGE) -> DataFrame:
    """``stem, window, start_ms, energy`` of all windows of the wav files of ``folder``; the last window of a file may be shorter."""
    spark.dataSource.register(Wav)
    return spark.read.format(FORMAT).option("window_ms", window_ms).option("range", size).load(folder)
