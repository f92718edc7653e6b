"""Katz backoff language model over words: Good-Turing discounts, exact backoff weights, any order.

Counts of words and of longer n-grams, and the backoff weights of contexts, are
tables dealt to partitions; a text is scored token by token, from the longest n-gram's
count down to the word's. N-grams of few counts may be left to the backoff; the
query keeps them all.

Documents are first coded in batches, files of words and a stream of word numbers. For each order a batch sends each of its distinct n-grams once to the partition
that owns it, with the probability that the order below gives it, and gets the counts
back in the same order, with what the owner knows of the contexts: so a context's weight
needs no join of n-grams. Contexts that are too frequent for one partition are dealt to
several, whose sums are added up. What is exchanged grows with distinct n-grams per batch
and not with tokens, and words are exchanged once; from then on they have numbers.
"""

from __future__ import annotations

import posixpath
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, compressor, decompressor, discard, materialize, new_path, partition_keys, remove, wide

#: The context before a text and the token after it; no word is empty or has a space.
START, END = b"", b" "
#: The number of START; words have smaller ones.
START_ID = np.uint64((1 << 64) - 1)
#: The number of words that a stored model does not know, as a long.
UNKNOWN = -2
#: Bytes of text in a batch.
BATCH = 12 << 20
#: Counts up to this are discounted; pairs need this count to be kept, unless the caller says otherwise.
LOW, KEPT = 5, 2
#: A context with this share of a partition's tokens has its continuations dealt to more partitions.
SHARE = 1 / 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether the CRC-32 of the id's decimal text falls into the fold that is not learned from; a null id has no text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


KINDS = tuple(map(np.dtype, ("bool", "int32", "uint32", "int64", "uint64", "float64")))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; their bytes are dealt to planes, of which the higher ones are mostly zero."""
    head = np.array([len(arrays), *(x for a in arrays for x in (KINDS.index(a.dtype), len(a)))], dtype=np.int64)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return compressor(1).compress(b"".join([head.tobytes(), *planes]))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``squeeze``."""
    raw = decompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    out, at = [], 8 + 16 * n
    for kind, size in zip(head[::2], head[1::2]):
        width = KINDS[kind].itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(KINDS[kind]))
        at += size * width
    return out


def delta(x: np.ndarray) -> np.ndarray:
    """Differences modulo 2^64, which are small where numbers ascend; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=np.uint64(0))


def squeeze_words(words: list[bytes]) -> bytes:
    return compressor(3).compress(b"\n".join(words))


def expand_words(blob: bytes) -> list[bytes]:
    return decompressor().decompress(blob).split(b"\n")


def owners(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Which of ``n`` partitions each row of word numbers belongs to."""
    out = np.full(len(columns[0]), 7, dtype=np.uint64)
    for c in columns:
        out = (out ^ c) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return (out % np.uint64(n)).astype(np.int64)


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their columns, and where in it a row differs from the one before."""
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, new


CODED = "doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, learned binary, ids binary"


def code(docs: DataFrame, uri: str) -> DataFrame:
    """``(batch, path)`` of files in the shared folder ``uri``, a batch of documents each.

    A file has ids, fold, tokens per document, words, frequent ones first, their counts outside the fold, and the
    tokens as word numbers. Names have the task's attempt, so one that runs again writes other files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        name, made = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}", 0

        def fresh() -> tuple:
            return defaultdict(count().__next__, {}), [], []

        place, docs, streams = fresh()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate(streams)
            order = np.argsort(-np.bincount(ids, minlength=len(place)), kind="stable")  # frequent words get small numbers
            known = list(place)
            words = [known[i] for i in order.tolist()]
            rank = np.empty(len(words), dtype=np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            ids = rank[ids]
            held = np.array([h for _, h in docs])
            sizes = np.array([len(s) for s in streams], dtype=np.int32)
            learned = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int32)
            row = _batch(CODED, doc_ids=[[d for d, _ in docs]], held=[held.tolist()], sizes=[sizes], words=[squeeze_words(words)], learned=[squeeze(learned)], ids=[squeeze(ids)])
            path = posixpath.join(root, f"{name}-{made}.arrow")
            with store.open_output_stream(path) as out, pa.ipc.new_file(out, row.schema) as file:
                file.write_batch(row)
            made += 1
            return _batch("batch string, path string", batch=[f"{name}-{made - 1}"], path=[path])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not docs:
                    place[START], place[END]  # noqa: B018  both get a number
                words = text.translate(LOWER).split()
                words.append(END)
                streams.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
                docs.append((doc_id, held_out(doc_id)))
                size += len(text)
                if size >= BATCH:
                    yield flush()
                    place, docs, streams = fresh()
                    size = 0
        if docs:
            yield flush()

    fs.FileSystem.from_uri(uri)[0].create_dir(fs.FileSystem.from_uri(uri)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "batch string, path string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {k: b.column(k)[i].as_py() for k in b.schema.names}


def _batch(schema: str, **given) -> pa.RecordBatch:
    """Rows of a DDL ``schema``; columns that are not given are null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    fields = [f.split() for f in schema.split(", ")]
    rows = len(next(iter(given.values())))
    return pa.record_batch([pa.array(given[k], kinds[t]) if k in given else pa.nulls(rows, kinds[t]) for k, t in fields], names=[k for k, _ in fields])


def _blob_rows(b: pa.RecordBatch) -> Iterator[tuple[int, str, bytes]]:
    for p, batch, blob in zip(*(b.column(i) for i in range(3))):
        yield p.as_py(), batch.as_py(), blob.as_py()


def _sent(batch: str, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return _batch(SENT, p=[k for k, _ in blobs], batch=[batch] * len(blobs), blob=[x for _, x in blobs])


SENT = "p int, batch string, blob binary"
WORDS = "kind string, batch string, p int, blob binary, word string, id long, c long"


def word_owners(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % n


def count_words(coded: DataFrame, uri: str, keys: list[int]) -> DataFrame:
    """Number and count the words. Two kinds of rows: ``word`` with its ``id`` and its count ``c`` among the tokens that
    are learned from; ``answer``, ids and counts of the words that a batch sent, in order."""
    n = len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            r |= load(uri, r["path"])
            words, (learned,) = expand_words(r["words"]), unpack(r["learned"])
            order, cut = _by_owner(word_owners(words, n), n)
            out = []
            for k in range(n):
                at = order[cut[k] : cut[k + 1]]
                if len(at):
                    out.append((keys[k], compressor(3).compress(np.int64(len(at)).tobytes() + learned[at].tobytes() + b"\n".join([words[i] for i in at.tolist()]))))
            yield _sent(r["batch"], out)

    def settle(p: int, blobs: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = defaultdict(count().__next__)
        asked, counts = [], []
        for _, blob in blobs:
            raw = decompressor().decompress(blob)
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            counts.append(np.frombuffer(raw, np.int32, m, 8))
            asked.append(np.fromiter(map(place.__getitem__, raw[8 + 4 * m :].split(b"\n")), dtype=np.int64, count=m))
        total = np.bincount(np.concatenate(asked), weights=np.concatenate(counts), minlength=len(place)).astype(np.int64)
        ids = np.arange(len(place)) * n + keys.index(p)
        for (batch, _), at in zip(blobs, asked):
            yield _batch(WORDS, kind=["answer"], batch=[batch], p=[p], blob=[squeeze(ids[at], total[at])])
        words = [w.decode() for w in place]
        for lo in range(0, len(words), 100_000):
            part = slice(lo, lo + 100_000)
            yield _batch(WORDS, kind=["word"] * len(words[part]), word=words[part], id=ids[part], c=total[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settled(batches, settle)

    return coded.mapInArrow(send, SENT).repartition(n, "p").sortWithinPartitions("p").mapInArrow(run, WORDS)


def _settled(batches: Iterator[pa.RecordBatch], settle: Callable[[int, list[tuple[str, bytes]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Give ``settle`` the blobs of each partition number."""
    now, held = None, []
    for b in batches:
        for p, batch, blob in _blob_rows(b):
            if p != now and held:
                yield from settle(now, held)
                held = []
            now = p
            held.append((batch, blob))
    if held:
        yield from settle(now, held)


def _by_owner(p: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Rows in order of their partitions, and where each begins."""
    small = p.astype(np.uint16) if n <= 1 << 16 else p
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(n + 1)).tolist()


def load(uri: str, path: str) -> dict:
    """The row of a batch's file."""
    with fs.FileSystem.from_uri(uri)[0].open_input_file(path) as source:
        return pa.ipc.open_file(source).get_batch(0).to_pylist()[0]


def good_turing(n: list[int], dropped: int = 0) -> list[float]:
    """Factors of counts 1 to LOW from the numbers ``n`` of events of counts 1 to LOW + 1.

    Katz's discount (r*/r - A) / (1 - A) with A = (LOW + 1) n[LOW + 1] / n[1]. Where
    small data make it useless, r*/r or 1, whichever lies between 0 and 1. Counts
    up to ``dropped`` get 0.
    """
    out = []
    a = (LOW + 1) * n[LOW] / n[0] if n[0] else 1.0
    for r in range(1, LOW + 1):
        ratio = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 1.0
        d = (ratio - a) / (1 - a) if a < 1 else ratio
        if not 0 < d < 1:
            d = ratio if 0 < ratio < 1 else 1.0
        out.append(0.0 if r <= dropped else d)
    return out


@dataclass(frozen=True)
class Model:
    """Totals and discounts of words; counts and weights are in tables.

    ``n`` tokens and ``v`` distinct ones are learned from, ``docs`` documents;
    ``mass`` is the sum of their discounted counts, ``unseen`` the probability of
    the one event that no learned word is.
    """

    n: int
    v: int
    docs: int
    single: tuple[float, ...]
    unseen: float
    mass: float

    @property
    def rate(self) -> float:
        """Probability of a word for each unit of its discounted count."""
        return (1 - self.unseen) / self.mass if self.mass else 0.0

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.rate * discount(c, self.single), self.unseen)


def discount(c: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
    """Discounted counts."""
    return np.array([0.0, *factors, 1.0])[np.minimum(c, LOW + 1)] * c


def totals(single: DataFrame) -> Model:
    """The totals of words ``word, c``."""
    cols = [F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, LOW + 2)), F.coalesce(F.sum(F.when(F.col("word") == END.decode(), F.col("c"))), F.lit(0)).alias("docs")]
    row = single.agg(*cols).first()
    small = [row[f"n{r}"] for r in range(1, LOW + 2)]
    factors = good_turing(small)
    saved = sum((1 - d) * r * small[r - 1] for r, d in enumerate(factors, 1))
    unseen = max(saved / row["n"], 1 / (row["n"] + 1)) if row["n"] else 1.0
    return Model(row["n"], row["v"], row["docs"], tuple(factors), unseen, row["n"] - saved)


# --- the orders of a batch ------------------------------------------------------------------------


class Batch:
    """A batch's tokens, and for the last order that is done the n-gram that ends at each of them, with counts and probabilities."""

    def __init__(self, r: dict, parts: list[tuple[int, bytes]], model: Model, keys: list[int]):
        self.row, self.model, self.keys, self.order = r, model, keys, 1
        self.place = {k: i for i, k in enumerate(keys)}
        self.sizes = np.array(r["sizes"], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        (self.ids,) = unpack(r["ids"])
        self.learned = np.repeat(~np.array(r["held"], dtype=bool), self.sizes)
        by, _ = _by_owner(word_owners(expand_words(r["words"]), len(keys)), len(keys))
        numbers, counts = (np.concatenate(x) for x in zip(*(unpack(blob) for blob in self._in_order(parts))))
        order = np.argsort(numbers)  # words are renamed in order of their numbers, which ascend in what is sent
        self.words, self.counts = numbers[order].astype(np.uint64), counts[order]
        rank = np.empty(len(by), dtype=np.int32)
        rank[by[order]] = np.arange(len(by), dtype=np.int32)
        self.ids = rank[self.ids]
        self.known = self.counts > 0
        self.base = np.log10((self.counts + 1) / (model.n + model.v + 1))
        self.gram, self.probs = self.ids, model.word(self.counts)
        self.deal()

    def _in_order(self, parts: list[tuple[int, bytes]]) -> list[bytes]:
        return [blob for _, blob in sorted(parts, key=lambda x: self.place[x[0]])]

    def _columns(self, at: np.ndarray, first: int, last: int) -> list[np.ndarray]:
        """Numbers of the words ``first`` to ``last`` places before the tokens ``at``; START before a text."""
        inside = at - self.starts[np.searchsorted(self.starts, at, side="right") - 1]
        return [np.where(inside >= back, self.words[self.ids[np.maximum(at - back, 0)]], START_ID) for back in range(first, last - 1, -1)]

    def deal(self) -> None:
        """The n-grams of the next order: where one ends, its ids, its partition, and the runs of n-grams with one context there.

        A partition gets n-grams by context, and by word too as far as the context's
        count asks for more than one partition.
        """
        n, k = len(self.keys), self.order
        context = np.empty(len(self.gram), dtype=np.int64)  # the n-gram before each token, from 1; 0 is the start of a text
        context[1:] = self.gram[:-1]
        context[1:] += 1
        context[self.starts] = 0
        both, end, number = np.unique(context << 32 | self.ids, return_index=True, return_inverse=True)
        before = both >> 32
        columns = self._columns(end, k, 0)
        size = np.where(before > 0, self.counts[np.maximum(before - 1, 0)], self.model.docs)
        spread = 1 + np.minimum(n - 1, (size * (n / SHARE) / max(self.model.n, 1)).astype(np.int64))
        p = (owners(columns[:-1], n) + owners(columns[-1:], 1 << 30) % spread) % n
        by, self.cut = _by_owner(p, n)
        self.end, self.split, p, before = end[by], spread[by] > 1, p[by], before[by]
        self.columns = [c[by] for c in columns]
        self.new = np.r_[True, (p[1:] != p[:-1]) | (before[1:] != before[:-1])]
        self.lower, self.number = self.gram[self.end], np.empty(len(by), dtype=np.int64)
        self.number[by] = np.arange(len(by))
        self.number = self.number[number]  # each token's n-gram

    def sent(self) -> list[tuple[int, bytes]]:
        """A blob for each partition that owns n-grams of the next order; a word's count stands for its probability."""
        counts = np.bincount(self.number[self.learned], minlength=len(self.end)).astype(np.int32)
        lower = np.where(counts > 0, self.counts[self.lower] if self.order == 1 else self.probs[self.lower], 0)
        out = []
        for k, (lo, hi) in enumerate(zip(self.cut, self.cut[1:])):
            if lo < hi:
                new = np.flatnonzero(self.new[lo:hi])
                repeat = np.diff(np.r_[new, hi - lo]).astype(np.int32)
                heads = [delta(c[lo:hi][new]) for c in self.columns[:-1]]
                out.append((self.keys[k], squeeze(*heads, repeat, self.split[lo:hi][new], self.columns[-1][lo:hi], counts[lo:hi], lower[lo:hi])))
        return out

    def climb(self, parts: list[tuple[int, bytes]], table: tuple[list[np.ndarray], np.ndarray], factors: tuple[float, ...]) -> None:
        """Go to the next order, by the answers to what was sent and the ``table`` of split contexts."""
        got = [unpack(blob) for blob in self._in_order(parts)]
        counts, *stats = (np.concatenate(x) for x in zip(*got))
        del got
        ids, known = table
        at = np.flatnonzero(self.new & self.split)
        if len(at) and len(known[0]):
            by, new = distinct([np.concatenate([c, d[at]]) for c, d in zip(ids, self.columns)])
            head = np.empty(len(by), dtype=np.int64)  # the sort is stable: a row of the table comes before the contexts that are it
            head[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            head = head[len(ids[0]) :]
            found = head < len(ids[0])
            for x, value in zip(stats, known):
                x[(np.cumsum(self.new)[at] - 1)[found]] = value[head[found]]
        rate, backoff = weigh(dict(zip(STATS, stats)), factors)
        own = np.cumsum(self.new) - 1
        self.probs = np.where(counts > 0, rate[own] * discount(counts, factors), backoff[own] * self.probs[self.lower])
        self.counts, self.gram, self.order = counts, self.number, self.order + 1


#: What is known of a context: its occurrences, its kept n-grams of counts 1 to LOW, the counts of the more frequent ones,
#: and what the order below gives to them.
STATS = ("c", *(f"n{r}" for r in range(1, LOW + 1)), "more", "alone")


def weigh(x: dict[str, np.ndarray], factors: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What a unit of a discounted count is worth in a context, and the backoff weight.

    An n-gram's probability is ``scale * d * c / c(context)``; what all kept n-grams
    of a context leave, at least 1 / (c(context) + 1), goes to ``backoff`` times the
    probability under the shorter context, which sums to exactly the rest.
    """
    c = np.maximum(x["c"], 1)
    share = (sum(r * d * x[f"n{r}"] for r, d in enumerate(factors, 1)) + x["more"]) / c
    left = np.where(share > 0, np.maximum(1 - share, 1 / (c + 1)), 1.0)
    return np.where(share > 0, (1 - left) / np.where(share > 0, share, 1), 1.0) / c, left / (1 - x["alone"])


def parts_of(found: DataFrame, order: int) -> DataFrame:
    """STATS of the split contexts: the sums of their parts."""
    return found.where("kind = 'part'").groupBy(*(f"g{i}" for i in range(order - 1))).agg(*(F.sum(c).alias(c) for c in STATS))


def weights(found: DataFrame, order: int, factors: tuple[float, ...]) -> DataFrame:
    """The table of contexts: ids ``g0`` on, occurrences ``c``, ``unit`` and ``backoff`` as ``weigh`` gives them."""
    ids = [f"g{i}" for i in range(order - 1)]
    rows = found.where("kind = 'context'").select(*ids, *STATS).unionByName(parts_of(found, order))
    share = sum((F.col(f"n{r}") * F.lit(r * d) for r, d in enumerate(factors, 1)), F.col("more")) / F.col("c")
    left = F.when(F.col("share") > 0, F.greatest(1 - F.col("share"), 1.0 / (F.col("c") + 1))).otherwise(1.0)
    rows = rows.withColumn("share", share).withColumn("left", left)
    unit = F.when(F.col("share") > 0, (1 - F.col("left")) / F.col("share")).otherwise(1.0) / F.col("c")
    return rows.select(*ids, "c", unit.alias("unit"), (F.col("left") / (1 - F.col("alone"))).alias("backoff"))


def found_schema(order: int) -> str:
    ids = "".join(f"g{i} long, " for i in range(order))
    return f"kind string, batch string, p int, blob binary, {ids}count long, " + ", ".join(f"{k} double" for k in STATS)


def count_grams(pass_over: Callable, order: int, model: Model, keys: list[int], kept: int) -> DataFrame:
    """Count the n-grams of an order. Five kinds of rows:

    ``gram``: ids and ``count`` of each n-gram of count ``kept`` or more; ``context``: STATS of a context;
    ``part``: a partition's part of a split one; ``answer``: STATS of contexts and counts of n-grams that a
    batch sent, in order; ``histogram``: how many n-grams a partition has of count ``p``, 1 to LOW + 1.
    """
    n, schema = len(keys), found_schema(order)

    def opened(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of n-grams: columns of ids, counts and lower probabilities; of runs: first n-gram and whether it is of a split context."""
        *heads, repeat, split, last, counts, lower = unpack(blob)
        lower = np.where(counts > 0, model.word(lower), 0.0) if order == 2 else lower
        return [*(np.repeat(np.cumsum(c, dtype=np.uint64), repeat) for c in heads), last, counts, lower], [np.cumsum(repeat) - repeat, split]

    def settle(p: int, blobs: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        rows, runs = zip(*(opened(blob) for _, blob in blobs))
        *columns, counts, lower = (np.concatenate(c) for c in zip(*rows))
        sizes = [len(x[0]) for x in rows]
        del rows
        by, new = distinct(columns)
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[by].astype(np.int64), first)
        del counts
        lower = np.maximum.reduceat(lower[by], first)
        columns = [c[by[first]] for c in columns]
        back = np.empty(len(by), dtype=np.int64)  # of each n-gram that was sent, its place among the distinct ones
        back[by] = np.cumsum(new) - 1
        yield _batch(schema, kind=["histogram"] * (LOW + 1), p=range(1, LOW + 2), count=np.bincount(np.minimum(total, LOW + 2), minlength=LOW + 3)[1 : LOW + 2])
        keep = (total >= kept) & (total > 0)
        starts = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])]
        context, contexts = np.cumsum(starts) - 1, np.flatnonzero(starts)
        sums = lambda x: np.add.reduceat(x, contexts).astype(np.float64)
        stats = {"c": sums(total)} | {f"n{r}": sums(((total == r) & keep).astype(np.int64)) for r in range(1, LOW + 1)}
        stats |= {"more": sums(np.where((total > LOW) & keep, total, 0)), "alone": sums(np.where(keep, lower, 0.0))}
        counts = np.where(keep, total, 0)
        split, at = np.zeros(len(contexts), dtype=bool), 0
        for (batch, _), (heads, flags), size in zip(blobs, runs, sizes):
            mine = back[at : at + size]
            of = context[mine[heads]]
            split[of] = flags
            yield _batch(schema, kind=["answer"], batch=[batch], p=[p], blob=[squeeze(counts[mine], *(stats[k][of] for k in STATS))])
            at += size
        heads = [c[contexts].view(np.int64) for c in columns[:-1]]
        for kind in (False, True):
            some = np.flatnonzero((split == kind) & (stats["c"] > 0))
            for part in np.array_split(some, 1 + len(some) // 100_000):
                yield _batch(schema, kind=["part" if kind else "context"] * len(part), **{f"g{i}": c[part] for i, c in enumerate(heads)}, **{k: v[part] for k, v in stats.items()})
        some = np.flatnonzero(keep)
        for part in np.array_split(some, 1 + len(some) // 100_000):
            yield _batch(schema, kind=["gram"] * len(part), count=total[part], **{f"g{i}": c[part].view(np.int64) for i, c in enumerate(columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settled(batches, settle)

    sent = pass_over(lambda b: _sent(b.row["batch"], b.sent()), SENT)
    return sent.repartition(n, "p").sortWithinPartitions("p").mapInArrow(run, schema)


@lru_cache(maxsize=8)
def split_contexts(path: str, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids and STATS of the split contexts of an order, from their small table.

    A context is split if it has a share of all tokens of at least ``SHARE`` over the
    number of partitions, so there are at most ``1 / SHARE`` for each partition.
    """
    store, root = fs.FileSystem.from_uri(path)
    x = pq.read_table(root, filesystem=store)
    ids = [x[f"g{i}"].to_numpy().view(np.uint64) for i in range(width)]
    return ids, np.array([x[k].to_numpy() for k in STATS])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def result(b: Batch) -> pa.RecordBatch:
    """The scores of a batch's documents, once all orders are done."""
    total = lambda x: np.add.reduceat(x, b.starts)
    return _batch(RESULT, doc_id=b.row["doc_ids"], held_out=b.row["held"], n_tokens=b.sizes, n_known=total(b.known[b.ids].astype(np.int64)), train_tokens=np.full(len(b.sizes), b.model.n), base_score=total(b.base[b.ids]), score=total(np.log10(b.probs)[b.gram]))


@dataclass
class Learned:
    """What a run over the training texts has made: batches, rows of each order, their factors and weights, and the pass that scores the batches."""

    coded: DataFrame
    uri: str
    found: list[DataFrame]
    factors: list[tuple[float, ...]]
    split: list[DataFrame]
    weights: list[DataFrame]
    model: Model
    pass_over: Callable[[Callable[[Batch], pa.RecordBatch], str], DataFrame]

    def discard(self) -> None:
        discard(self.coded, *self.found, *self.split, *self.weights)
        remove(self.coded.sparkSession, self.uri)


def learn(docs: DataFrame, kept: int, order: int) -> Learned:
    """Count the n-grams of all orders over the documents outside the fold, and weigh their contexts."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    keys, uri = partition_keys(spark, wide(spark)), new_path(spark, "katz-files")
    coded = materialize(code(docs, uri), "katz-batches")
    found = [materialize(count_words(coded, uri, keys), "katz-words")]
    model = totals(found[0].where("kind = 'word'").select("word", "c"))
    factors, split, weighed = [], [], []

    def pass_over(make: Callable[[Batch], pa.RecordBatch], schema: str) -> DataFrame:
        """Meet each batch with the answers of all orders so far, climb them, and ``make`` rows of ``schema``."""
        by_order, tables, last = tuple(factors), tuple(t._cadenza_path for t in split), len(found)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}
            for r in _rows(batches):
                if r["batch"] != now:
                    now, held = r["batch"], defaultdict(list)
                if r["path"] is None:
                    held[r["kind"]].append((r["p"], r["blob"]))
                    continue
                b = Batch(load(uri, r["path"]) | {"batch": now}, held["1"], model, keys)  # the path sorts after the answers
                for k in range(2, last + 1):
                    b.climb(held[str(k)], split_contexts(tables[k - 2], k - 1), by_order[k - 2])
                    if k < last or schema != RESULT:
                        b.deal()
                held = {}
                yield make(b)

        rows = coded.select("batch", F.lit("~").alias("kind"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("binary").alias("blob"), "path")
        for k, x in enumerate(found, 1):
            rows = rows.unionAll(x.where("kind = 'answer'").select("batch", F.lit(str(k)), "p", "blob", F.lit(None).cast("string")))
        return rows.repartition(wide(spark), "batch").sortWithinPartitions("batch", "kind").mapInArrow(meet, schema)

    for k in range(2, order + 1):
        now = materialize(count_grams(pass_over, k, model, keys, kept), f"katz-grams-{k}")
        hist = {r.p: r.c for r in now.where("kind = 'histogram'").groupBy("p").agg(F.sum("count").alias("c")).collect()}
        factors.append(tuple(good_turing([hist.get(r, 0) for r in range(1, LOW + 2)], kept - 1)))
        split.append(materialize(parts_of(now, k), f"katz-split-{k}"))
        weighed.append(materialize(weights(now, k, factors[-1]), f"katz-weights-{k}"))
        found.append(now)
    return Learned(coded, uri, found, factors, split, weighed, model, pass_over)


def score(docs: DataFrame, kept: int = KEPT, order: int = 2) -> DataFrame:
    """Learn from all documents outside the fold, and score every row of ``docs``.

    Texts are lower-cased (A-Z) and split at ASCII white space, and one end token
    is added. ``base_score`` is the add-one score of the contract, ``score`` the
    model's log10 probability of the text, by n-grams of up to ``order`` words. A null or
    empty text is the end token alone; a text of any length is scored whole, in one
    batch. Rows with equal or null ids count and are scored one by one, a null id
    as the empty id text. If nothing is learned every token is the unseen one. An empty table gives no
    rows. Columns besides ``doc_id`` and ``text`` are ignored. N-grams of two words or more of a count under
    ``kept`` are left to the backoff; 1 keeps all.
    """
    made = learn(docs, kept, order)
    out = materialize(made.pass_over(result, RESULT), "katz-scores")
    made.discard()
    return out


# --- stored models --------------------------------------------------------------------------------


def ids_of(order: int) -> list[str]:
    return [f"g{i}" for i in range(order)]


def dealt(rows: DataFrame, columns: list[str], path: str, buckets: int) -> None:
    """Write ``rows`` in folders by a hash of ``columns``."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", *columns).write.partitionBy("bucket").parquet(path)


def fit(docs: DataFrame, path: str, kept: int = KEPT, order: int = 2, buckets: int = 16) -> str:
    """Learn a model from the documents outside the fold and store it at ``path``, which is returned.

    ``words`` (``word, id, c``), ``grams-k`` (ids and ``count``) and ``weights-k`` (ids of a context, ``unit`` and ``backoff``)
    are tables in buckets by word or by context; ``model`` is one row of totals and discounts.
    """
    made = learn(docs, kept, order)
    spark = docs.sparkSession
    dealt(made.found[0].where("kind = 'word' and c > 0").select("word", "id", "c"), ["word"], f"{path}/words", buckets)
    for k in range(2, order + 1):
        dealt(made.found[k - 1].where("kind = 'gram'").select(*ids_of(k), "count"), ids_of(k - 1), f"{path}/grams-{k}", buckets)
        dealt(made.weights[k - 2].select(*ids_of(k - 1), "unit", "backoff"), ids_of(k - 1), f"{path}/weights-{k}", buckets)
    m = made.model
    row = (m.n, m.v, m.docs, list(m.single), m.unseen, m.mass, [list(f) for f in made.factors])
    spark.createDataFrame([row], "n long, v long, docs long, single array<double>, unseen double, mass double, factors array<array<double>>").write.parquet(f"{path}/model")
    made.discard()
    return path


def discounted(c: Column, factors: tuple[float, ...] | list[float]) -> Column:
    return c * F.when(c <= LOW, F.get(F.array(*map(F.lit, factors)), (c - 1).cast("int"))).otherwise(1.0)


def score_with(path: str, docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` by the model stored at ``path``: the columns of ``score``, the same for the texts it was learned with.

    Tokens join the words, then, from two words up to the model's order, the weights of their context and the
    count of their n-gram: a kept n-gram has its discounted share, any other what its context leaves times the
    probability under the shorter one. Words that the model does not know make contexts that it does not know.
    """
    spark = docs.sparkSession
    row = spark.read.parquet(f"{path}/model").first()
    model = Model(row.n, row.v, row.docs, tuple(row.single), row.unseen, row.mass)
    table = lambda name, schema: spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}").drop("bucket")
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.concat(F.regexp_extract_all(low, F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.array(F.lit(END.decode())))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("w"))
    tokens = texts.select("row", "doc_id", F.posexplode("w").alias("pos", "word")).join(table("words", "word string, id long, c long"), "word", "left")
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.n + model.v + 1)))
    known = F.when(F.col("c") > 0, F.lit(model.rate) * discounted(F.col("c"), model.single)).otherwise(F.lit(model.unseen))
    order = Window.partitionBy("row").orderBy("pos")
    number = F.coalesce("id", F.lit(UNKNOWN))
    most = len(row.factors) + 1
    before = {f"b{j}": F.lag(number, j, int(START_ID.view(np.int64))).over(order) for j in range(1, most)}
    tokens = tokens.select("row", "doc_id", number.alias("b0"), *(c.alias(n) for n, c in before.items()), (F.col("c") > 0).alias("known"), base.alias("base"), known.alias("p"))
    for k, factors in enumerate(row.factors, 2):
        names = [F.col(f"g{i}").alias(f"b{k - 1 - i}") for i in range(k)]
        kinds = ", ".join(f"g{i} long" for i in range(k))
        context = [f"b{j}" for j in range(k - 1, 0, -1)]
        w = table(f"weights-{k}", ", ".join(f"g{i} long" for i in range(k - 1)) + ", unit double, backoff double").select(*names[: k - 1], "unit", "backoff")
        grams = table(f"grams-{k}", f"{kinds}, count long").select(*names, "count")
        tokens = tokens.join(w, context, "left").join(grams, [*context, "b0"], "left")
        p = F.when(F.col("count") > 0, F.col("unit") * discounted(F.col("count"), factors)).otherwise(F.coalesce("backoff", F.lit(1.0)) * F.col("p"))
        tokens = tokens.withColumn("p", p).drop("unit", "backoff", "count")
    sums = tokens.groupBy("row", "doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum(F.log10("p")).alias("score"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).alias("train_tokens"), "base_score", "score")
