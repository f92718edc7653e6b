"""Cost-balanced packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import MOST_WORDS, encoded, shared_encoder, tokenizer_path

#: A piece: document, first token in it, tokens, sequence, first token there.
Piece = tuple[int, int, int, int, int]


def capacities(total: int, most: int) -> list[int]:
    """Full sequences, then the powers of two that the rest is the sum of: no padding is needed."""
    rest = total % most
    return [most] * (total // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_block(lengths: list[int], most: int = 4096, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[Piece]:
    """Place documents of the given lengths; every sequence ends up full.

    A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention
    stays inside a document. Full-length pieces of long documents come first,
    alone. The rest go in descending order to the lowest-cost sequence that has
    room for all of it; those that fit nowhere whole are cut, again into the
    lowest-cost sequences with room. Ties go to the earlier document and sequence.
    """
    out: list[Piece] = []
    tails = []
    for i, n in enumerate(lengths):
        for at in range(0, n - most + 1, most):
            out.append((i, at, most, len(out), 0))
        if n % most:
            tails.append((n % most, i))
    first = len(out)
    room = np.array(capacities(sum(n for n, _ in tails), most), dtype=np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    cut = []

    def put(i: int, at: int, n: int, s: int) -> None:
        out.append((i, at, n, first + s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] = cost[s] + linear * n + quadratic * n * n if room[s] else np.inf

    for n, i in sorted(tails, key=lambda t: (-t[0], t[1])):
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            put(i, lengths[i] - n, n, s)
        else:
            cut.append((n, i))
    for n, i in cut:
        at, end = lengths[i] - n, lengths[i]
        while at < end:
            s = int(np.argmin(cost))
            put(i, at, step := min(end - at, int(room[s])), s)
            at += step
    return out


def pack(docs: DataFrame, path: str | None = None, most: int = 4096, linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 22, with_ids: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Documents are encoded and packed where they lie, in blocks of about
    ``block_tokens`` tokens within a partition, so nothing is shuffled and a task
    holds one block. Every sequence is full or a power of two long, so padding is
    nil. A null or empty text is one end token; a long text is cut into several
    pieces; rows with equal or null ids are packed one by one; an empty table
    gives no rows. ``with_ids`` adds the ids themselves. ``most_words`` bounds a worker's cache of
    encoded words, not the result. Columns besides
    ``doc_id`` and ``text`` are ignored.
    """
    path = path or tokenizer_path()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = shared_encoder(path, most_words=most_words), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            pieces = pack_block([len(x) for _, x in held], most, linear, quadratic)
            cols = [[] for _ in fields]
            for i, at, n, s, offset in pieces:
                ids = held[i][1][at : at + n]
                row = [held[i][0], at, n, crc32(ids.astype("<u4").tobytes()), len(held[i][1]), number + s, offset]
                for c, v in zip(cols, [*row, ids.astype(np.int32)] if with_ids else row):
                    c.append(v)
            number += 1 + max((p[3] for p in pieces), default=-1)
            return pa.record_batch([pa.array(c, type=t) for c, (_, t) in zip(cols, fields)], schema=schema)

        for b in batches:
            for doc_id, ids in encoded(encoder, b):
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
