"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and masks."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, wide
from .tokens import encoded, shared_encoder, tokenizer_path

#: Tokens in a sequence (a multiple of 8), sequences in a record batch, and documents in a batch of the index.
LENGTH, ROWS, INDEX_ROWS = 2048, 128, 1 << 16
#: A shard that has so many tokens ends with the document: half a gigabyte.
SHARD_TOKENS = 1 << 28


def token_schema(length: int = LENGTH) -> pa.Schema:
    """Ids in 16 bits, and the mask as bytes of 8 tokens each, the first in the lowest bit: both are read without a copy."""
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class IndexWriter:
    """Writes ``doc_id, start, n_tokens`` in batches, so that a shard's documents need not fit memory."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.out = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, INDEX)
        self.held: list[tuple[int | None, int, int]] = []
        self.docs = self.tokens = 0

    def add(self, doc_id: int | None, n: int) -> None:
        self.held.append((doc_id, self.tokens, n))
        self.docs += 1
        self.tokens += n
        if len(self.held) == INDEX_ROWS:
            self._write()

    def _write(self) -> None:
        self.file.write_batch(pa.record_batch([pa.array(c, type=pa.int64()) for c in zip(*self.held)], schema=INDEX))
        self.held = []

    def close(self) -> None:
        if self.held:
            self._write()
        self.file.close()
        self.out.close()


class ShardWriter:
    """Writes ids one after another as sequences of ``length``; the last is padded and masked."""

    def __init__(self, store: fs.FileSystem, path: str, length: int = LENGTH, rows: int = ROWS):
        if length % 8:
            raise ValueError("the length of a sequence must be a multiple of 8")
        self.length, self.batch = length, length * rows
        self.out = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, token_schema(length))
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(np.uint16))
        self.n += len(ids)
        if self.n >= self.batch:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.batch * self.batch
            for at in range(0, whole, self.batch):
                self._write(flat[at : at + self.batch], self.batch)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(np.arange(len(flat)) < used, bitorder="little")), self.length // 8)
        self.file.write_batch(pa.record_batch([ids, mask], schema=token_schema(self.length)))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()
        self.out.close()


class ShardReader:
    """Random access to the sequences of a shard, and to any run of its ids; local files are mapped, not copied."""

    def __init__(self, store: fs.FileSystem, path: str, rows: int = ROWS):
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file, self.rows = pa.ipc.open_file(source), rows
        self.length = self.file.schema.field("ids").type.list_size

    def column(self, i: int, name: str) -> np.ndarray:
        """A column of batch ``i``, flat, without a copy."""
        return self.file.get_batch(i).column(name).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bytes of sequence ``i``: views of the file (``unpacked`` gives a mask's bits)."""
        row, size = i % self.rows, self.length // 8
        return self.column(i // self.rows, "ids")[row * self.length : (row + 1) * self.length], self.column(i // self.rows, "mask")[row * size : (row + 1) * size]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = self.rows * self.length, []
        for i in range(start // size, (start + n - 1) // size + 1):
            flat = self.column(i, "ids")
            parts.append(flat[max(0, start - i * size) : start + n - i * size])
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def unpacked(mask: np.ndarray) -> np.ndarray:
    """A mask's bytes as one boolean per token."""
    return np.unpackbits(mask, bitorder="little").astype(bool)


def write(docs: DataFrame, uri: str | None = None, path: str | None = None, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns a row per shard, in ``part`` order.

    ``shard`` names a token file and ``index`` a file of its documents'
    ``doc_id, start, n_tokens``; ``start`` counts from the shard's first id, and
    ``first`` is the number of ids before the shard. Tasks write to the shared
    folder ``uri`` under a name of their own and rename when done, so a task that
    is run again leaves whole files. A task's documents go to shards of about
    ``shard_tokens`` ids. Each shard starts a new sequence; the last
    sequence of a shard is padded, mask false. Ids are kept in 16 bits; a
    vocabulary beyond that is an error. Null texts are empty: one end token.
    A text of any length is encoded whole and may span sequences; it stays in one shard.
    Rows with equal ids follow each other by text; null ids come first. Files hold
    ``doc_id`` and ``text`` only, whatever else ``docs`` has; an empty table gives
    no shard.
    """
    spark = docs.sparkSession
    uri = uri or new_path(spark, "token-files")
    tokenizer = path or tokenizer_path()
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        task, encoder = TaskContext.get(), shared_encoder(tokenizer)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        made, writer, index = 0, None, None

        def name() -> str:
            return posixpath.join(root, f"{task.partitionId():06d}-{made:04d}")

        def finish() -> pa.RecordBatch:
            nonlocal made, writer, index
            writer.close()
            index.close()
            own, mine = name(), f"{name()}-{task.taskAttemptId()}"
            store.move(f"{mine}.tmp", f"{own}.arrow")
            store.move(f"{mine}.idx.tmp", f"{own}.idx.arrow")
            row = (task.partitionId() << 20 | made, f"{own}.arrow", f"{own}.idx.arrow", index.docs, index.tokens)
            made, writer = made + 1, None
            return pa.record_batch([pa.array([x]) for x in row], names=["part", "shard", "index", "n_docs", "n_tokens"])

        for b in batches:
            for doc_id, ids in encoded(encoder, b):
                if not writer:
                    mine = f"{name()}-{task.taskAttemptId()}"
                    writer, index = ShardWriter(store, f"{mine}.tmp", length), IndexWriter(store, f"{mine}.idx.tmp")
                writer.add(ids)
                index.add(doc_id, len(ids))
                if index.tokens >= shard_tokens:
                    yield finish()
        if writer:
            yield finish()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    rows = rows.repartitionByRange(wide(spark), "doc_id").sortWithinPartitions("doc_id", "t")
    shards = materialize(rows.mapInArrow(run, "part long, shard string, index string, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"), F.lit(uri).alias("uri"))


def read(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, shard, index, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                store, _ = fs.FileSystem.from_uri(uri)
                tokens = ShardReader(store, shard)
                with store.open_input_file(index) as source:
                    found = pa.ipc.open_file(source)
                    for i in range(found.num_record_batches):
                        docs = found.get_batch(i)
                        starts, counts = (docs.column(k).to_numpy() for k in (1, 2))
                        crcs = [crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.record_batch([docs.column(0), pa.array(starts + first), pa.array(counts), pa.array(crcs, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = shards.select("uri", "shard", "index", "first").repartition(wide(shards.sparkSession))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
