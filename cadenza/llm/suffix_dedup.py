"""Exact removal of repeated 100-byte strings by distributed sorting of suffixes.

All suffixes of a corpus are too many to exchange, so suffixes are sorted where it
matters. Every 100-byte window names the k-gram in it with the least hash as its
anchor, so equal windows have equal anchors at equal places. Windows whose anchor
k-gram occurs once in the corpus are unique. For the other anchors, the suffixes
that start there are sorted, each with the text before it that its windows cover
(first round). An anchor whose text equals an earlier one's repeats as a whole, and
one that is alone with its k-gram is unique. The others, at the edges of repeats,
stand together in the order, a k-gram at a time; which of their windows repeat is
found by sorting these windows themselves, as 100-byte suffix prefixes: where they meet
if they fit a run, else, as at the edges of a passage that very many documents share,
by exchanging them too (second round).

Both rounds are the same merge sort: tasks sort runs, front-code them, and deal
them out by a leading hash of the string, so that ranges are even and equal strings
meet; loser trees that know common prefixes merge the runs. A run holds one record
per distinct string, so a string that occurs in very many documents gives each
merging task at most one record per run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressor, decompressor, discard, materialize, partition_keys, wide
from .prefix_sort import LoserTree, decode, encode, shared_prefixes

#: Bytes of a repeated string, and of the k-gram that anchors it.
WINDOW, K = 100, 40
#: Bytes of text hashed at once, of text whose anchors are sent at once, and records of a run.
PIECE, BATCH, RUN = 1 << 20, 1 << 23, 100_000
MULTIPLIER = 0x9E3779B97F4A7C15
NULL_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    out = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        x = np.full(PIECE + WINDOW, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(text: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-gram, by differences of one running sum."""
    up, down = _powers()
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(text) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, bounds: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the parts ``bounds[i]:bounds[i + 1]`` of a piece.

    Returns arrays: anchor position, first and last window start, k-gram hash. The
    anchor of a window is its leftmost k-gram of least hash, by 40 bits.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(text) < window:
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8), k)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, need = 1, window - k + 1
    while 2 * span <= need:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < need:
        m = np.minimum(m[: len(m) - (need - span)], m[need - span :])
    at = (m & low).astype(np.int64)
    ok = np.zeros(len(at) + 1, dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ok[a : max(a, b - window + 1)] = True
    starts = np.flatnonzero(ok[:-1])
    if not len(starts):
        return none, none, none, none.view(np.uint64)
    own = at[starts]
    new = np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = starts[new]
    last = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    return own[new], first, last, h[own[new]]


def pieces(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes, np.ndarray]]:
    """Join documents, or cut long ones with an overlap, into pieces: (document, tie, first byte) of each part, text, bounds."""
    parts, texts, size = [], [], 0
    for d, r, text in docs:
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE - WINDOW):
            part = text[at : at + PIECE - 1]
            if size + len(part) > PIECE and parts:
                yield parts, b"".join(texts), np.cumsum([0, *map(len, texts)])
                parts, texts, size = [], [], 0
            parts.append((d, r, at))
            texts.append(part)
            size += len(part)
    if parts:
        yield parts, b"".join(texts), np.cumsum([0, *map(len, texts)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            yield d, r, t.as_py()


def _pack(*columns: np.ndarray) -> bytes:
    n = np.array([len(columns), len(columns[0])], dtype=np.int64)
    return compressor(1).compress(b"".join([n.tobytes(), *(np.ascontiguousarray(c).view(np.int64).tobytes() for c in columns)]))


def _unpack(blob: bytes) -> np.ndarray:
    x = np.frombuffer(decompressor().decompress(blob), dtype=np.int64)
    return x[2:].reshape(x[0], x[1])


def _blobs(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], names=["target", "kind", "blob"])


BLOBS = "target int, kind int, blob binary"


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Blobs of each target from rows that come sorted by it."""
    now, held = None, []
    for b in batches:
        for t, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if t != now and held:
                yield now, held
                held = []
            now = t
            held.append((kind, blob.as_py()))
    if held:
        yield now, held


def _dealt(blobs: DataFrame, n: int) -> DataFrame:
    return blobs.repartition(n, "target").sortWithinPartitions("target")


# --- which anchors occur twice --------------------------------------------------------------------


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``(d, r, codes)``: for each document, anchors whose k-gram hash occurs elsewhere too.

    ``docs`` has ``d, r, t``. A code is anchor position, and distances to the first and the last
    window start, 7 bits each. A task sends each distinct hash once per batch of text.
    """
    n = wide(docs.sparkSession)
    keys = partition_keys(docs.sparkSession, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, turn = 0, TaskContext.get().partitionId()  # so that tasks do not all begin with the same target

        def flush() -> pa.RecordBatch:
            nonlocal turn
            h, d, r, code = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h, kind="stable")
            h, d, r, code = h[order], d[order], r[order], code[order]
            first = np.r_[True, h[1:] != h[:-1]]
            single = first & np.r_[first[1:], True]
            known, reps = ~single, np.flatnonzero(first)
            spread = h[reps] * np.uint64(MULTIPLIER)  # anchors have small hashes
            target = (spread >> np.uint64(32)).astype(np.int64) * n >> 32
            order = np.argsort(target, kind="stable")
            reps, cut = reps[order], np.searchsorted(target[order], np.arange(n + 1))
            out = []
            for t in range(n):
                i = reps[cut[t] : cut[t + 1]]
                if len(i):
                    one = single[i]
                    out.append((keys[t], 0, _pack(h[i].view(np.int64), np.where(one, d[i], 0), np.where(one, r[i], 0), np.where(one, code[i], -1))))
            if known.any():
                out.append((keys[turn % n], 1, _pack(d[known], r[known], code[known])))
                turn += 1
            return _blobs(out)

        for parts, text, bounds in pieces(_rows(batches)):
            a, first, last, h = anchors(text, bounds)
            own = np.searchsorted(bounds, a, side="right") - 1
            ids = np.array([p[:2] for p in parts], dtype=np.int64)
            shift = np.array([p[2] for p in parts], dtype=np.int64) - bounds[:-1]
            held.append((h, ids[own, 0], ids[own, 1], (a + shift[own] << 14) | (a - first << 7) | (a - last)))
            size += len(text)
            if size >= BATCH:
                yield flush()
                held, size = [], 0
        if held and sum(len(x[0]) for x in held):
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_target(batches):
            found = [_unpack(b) for kind, b in blobs if kind == 1]
            sent = [_unpack(b) for kind, b in blobs if kind == 0]
            if sent:
                x = np.concatenate(sent, axis=1)
                x = x[:, np.argsort(x[0], kind="stable")]
                same = x[0, 1:] == x[0, :-1]
                twice = np.r_[False, same] | np.r_[same, False]
                found.append(x[1:, twice & (x[3] >= 0)])
            for d, r, code in found:
                yield pa.record_batch([pa.array(d), pa.array(r), pa.array(code)], names=["d", "r", "code"])

    sent = docs.select("d", "r", "t").mapInArrow(send, BLOBS)
    found = _dealt(sent, n).mapInArrow(match, "d long, r long, code long")
    return found.groupBy("d", "r").agg(F.collect_list("code").alias("codes"))


# --- merge sort of strings ------------------------------------------------------------------------

#: A string to sort: string, document, tie, position.
Record = tuple[bytes, int, int, int]
SPANS = 1  # kind of a blob of (d, r, start, end) to remove
EDGES = 2  # kind of a blob of (d, r, start) with texts whose windows are still open


class Run:
    """Collects records, then sorts, front-codes and deals them out as one run, to ``keys`` in order of the strings."""

    def __init__(self, keys: list[int], group: int, spans: Callable[[Record], tuple[int, int]], edge: Callable[[Record], tuple[int, bytes]] | None, turn: int = 0):
        self.keys, self.group, self.spans, self.edge, self.turn = keys, group, spans, edge, turn
        self.held: list[Record] = []

    def add(self, x: Record) -> bool:
        self.held.append(x)
        return len(self.held) >= RUN

    def flush(self) -> pa.RecordBatch:
        """Equal strings keep their first record, the others are spans to remove. Where ``group`` leading
        bytes mean that windows may be shared, a group with more than RUN windows sends its first string only,
        marked, and the windows of all of them are open. ``turn`` says to whom spans and edges go; tasks
        begin with different ones."""
        rows, self.held = self.held, []
        rows.sort()
        shared = shared_prefixes([x[0] for x in rows])
        sizes = np.fromiter((len(x[0]) for x in rows), dtype=np.int64, count=len(rows))
        same = (shared == sizes) & np.r_[False, sizes[1:] == sizes[:-1]]
        spans = [(x[1], x[2], *self.spans(x)) for i, (x, s) in enumerate(zip(rows, same.tolist())) if s and x != rows[i - 1]]
        kept = np.flatnonzero(~same)
        rows, shared = [rows[i] for i in kept], shared[kept]
        marks = np.zeros(len(rows), dtype=np.int64)
        edges: list[Record] = []
        if self.edge:
            head = np.r_[True, shared[1:] < self.group]
            number = np.cumsum(head) - 1
            many = np.bincount(number, weights=[n_windows(x[0]) for x in rows])[number] > RUN
            edges = [rows[i] for i in np.flatnonzero(many)]
            travels = np.flatnonzero(head | ~many)
            rows, shared, marks = [rows[i] for i in travels], shared[travels], many[travels].astype(np.int64)
        along = np.array([(x[1], x[2], x[3]) for x in rows], dtype=np.int64).reshape(-1, 3)
        along = np.c_[along, marks]
        target = np.array([int.from_bytes(x[0][:4], "big") for x in rows], dtype=np.int64) * len(self.keys) >> 32
        cut = np.searchsorted(target, np.arange(len(self.keys) + 1)).tolist()
        out = []
        for t, key in enumerate(self.keys):
            lo, hi = cut[t], cut[t + 1]
            if lo < hi:
                out.append((key, 0, encode([x[0] for x in rows[lo:hi]], shared[lo:hi], along[lo:hi])))
        if spans:
            out.append((self.keys[self.turn % len(self.keys)], SPANS, _pack(*np.array(spans, dtype=np.int64).T)))
        if edges:
            out.append((self.keys[(self.turn + 1) % len(self.keys)], EDGES, edge_blob([(x[1], x[2], *self.edge(x)) for x in edges])))
        self.turn += 2
        return _blobs(out)


def edge_blob(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Documents, ties and starts with texts, as one blob."""
    sizes = np.fromiter((len(x[3]) for x in rows), dtype=np.int64, count=len(rows))
    fixed = np.array([x[:3] for x in rows], dtype=np.int64).T
    return compressor(1).compress(b"".join([np.int64(len(rows)).tobytes(), fixed.tobytes(), sizes.tobytes(), *(x[3] for x in rows)]))


def edge_rows(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    raw = decompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    d, r, start, size = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n).tolist()
    at = 8 + 32 * n
    for x in zip(d, r, start, size):
        yield x[0], x[1], x[2], raw[at : at + x[3]]
        at += x[3]


def _span_batch(x: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(x.shape[1], SPANS, dtype=np.int32)), *(pa.array(c) for c in x), pa.nulls(x.shape[1], pa.binary())], names=["kind", "d", "r", "start", "end", "blob"])


def _edge_batch(blob: bytes) -> pa.RecordBatch:
    zero = pa.array([0], pa.int64())
    return pa.record_batch([pa.array([EDGES], pa.int32()), zero, zero, zero, zero, pa.array([blob], pa.binary())], names=["kind", "d", "r", "start", "end", "blob"])


FOUND = "kind int, d long, r long, start long, end long, blob binary"


def merge(blobs: list[tuple[int, bytes]], group: int, spans: Callable[[Record], tuple[int, int]], edge: Callable[[Record], tuple[int, bytes]] | None) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a target; what they say passes through."""
    for kind, blob in blobs:
        if kind == SPANS:
            yield _span_batch(_unpack(blob))
        elif kind == EDGES:
            yield _edge_batch(blob)
    gone: list[tuple[int, int, int, int]] = []
    edges: list[tuple[int, int, int, bytes]] = []
    held: list[Record] = []  # the strings of a group, as long as their windows fit a run
    total = size = 0
    before = None

    def settle() -> None:
        """Sort the windows of a group: those that equal the one before are spans to remove."""
        nonlocal held, total
        if len(held) > 1:
            windows = []
            for x in held:
                start, text = edge(x)
                windows += [(text[i : i + WINDOW], x[1], x[2], start + i) for i in range(len(text) - WINDOW + 1)]
            windows.sort()
            again = sorted((y[1:] for x, y in zip(windows, windows[1:]) if x[0] == y[0]))
            first = last = None
            for d, r, start in again:
                if first and last == (d, r, start - 1):
                    last = (d, r, start)
                    continue
                if first:
                    gone.append((*first, last[2] + WINDOW))
                first = last = (d, r, start)
            if first:
                gone.append((*first, last[2] + WINDOW))
        held, total = [], 0

    for shared, key, (d, r, pos, mark) in LoserTree([decode(b) for kind, b in blobs if kind == 0]):
        x = (key, d, r, pos)
        if edge and shared < group:
            settle()
        again = shared == len(key) == size
        if again and x != before:
            gone.append((d, r, *spans(x)))
        if edge:
            if not mark and not again:  # the windows of marked ones are open already
                held.append(x)
                total += n_windows(key)
            if mark or total > RUN:
                total = RUN + 1  # the group stays open
                edges += [(y[1], y[2], *edge(y)) for y in held]
                held = []
        size, before = len(key), x
        if len(gone) >= 100_000:
            yield _span_batch(np.array(gone, dtype=np.int64).T)
            gone = []
        if len(edges) >= 20_000:
            yield _edge_batch(edge_blob(edges))
            edges = []
    settle()
    if gone:
        yield _span_batch(np.array(gone, dtype=np.int64).T)
    if edges:
        yield _edge_batch(edge_blob(edges))


def n_windows(key: bytes) -> int:
    """How many windows an anchor's key stands for."""
    return key[8 + K] - key[9 + K] + 1


def anchor_key(text: bytes, code: int) -> bytes:
    """k-gram hash, k-gram, the two distances, and the text to the right and, reversed, to the left."""
    at, far, near = code >> 14, code >> 7 & 127, code & 127
    gram = text[at : at + K]
    return xxhash.xxh64_digest(gram) + gram + bytes((far, near)) + text[at + K : at + WINDOW - near] + text[at - far : at][::-1]


def anchor_span(x: Record) -> tuple[int, int]:
    far, near = x[0][8 + K], x[0][9 + K]
    return x[3] - far, x[3] - near + WINDOW


def anchor_text(x: Record) -> tuple[int, bytes]:
    """First window start, and the text of all windows of the anchor."""
    key, far, near = x[0], x[0][8 + K], x[0][9 + K]
    right = 10 + K + WINDOW - near - K
    return x[3] - far, key[right:][::-1] + key[8 : 8 + K] + key[10 + K : right]


def window_span(x: Record) -> tuple[int, int]:
    return x[3], x[3] + WINDOW


def removals(docs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(d, r, start, end)``: byte spans that repeat; and the tables behind them."""
    spark = docs.sparkSession
    n = wide(spark)
    keys = partition_keys(spark, n)

    def anchor_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run(keys, 8 + K, anchor_span, anchor_text, 2 * TaskContext.get().partitionId())
        for b in batches:
            for d, r, t, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                t = t.as_py()
                for code in codes.values.to_numpy().tolist():
                    if run.add((anchor_key(t, code), d, r, code >> 14)):
                        yield run.flush()
        if run.held:
            yield run.flush()

    def window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run(keys, 0, window_span, None, TaskContext.get().partitionId())
        for b in batches:
            for blob in b.column(0):
                for d, r, start, text in edge_rows(blob.as_py()):
                    for i in range(len(text) - WINDOW + 1):
                        w = text[i : i + WINDOW]
                        if run.add((xxhash.xxh64_digest(w) + w, d, r, start + i)):
                            yield run.flush()
        if run.held:
            yield run.flush()

    def merge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_target(batches):
            yield from merge(blobs, 8 + K, anchor_span, anchor_text)

    def merge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_target(batches):
            yield from merge(blobs, 0, window_span, None)

    joined = docs.join(candidates, ["d", "r"]).select("d", "r", "t", "codes")
    one = materialize(_dealt(joined.mapInArrow(anchor_runs, BLOBS), n).mapInArrow(merge_anchors, FOUND), "suffix-anchors")
    edges = one.where(F.col("kind") == EDGES).select("blob").repartition(n)
    two = materialize(_dealt(edges.mapInArrow(window_runs, BLOBS), n).mapInArrow(merge_windows, FOUND), "suffix-windows")
    spans = one.unionAll(two).where(F.col("kind") == SPANS).select("d", "r", "start", "end")
    return spans, [one, two]


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def whole_characters(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """``text`` without the spans, which give up characters that they hold in part."""
    out, at = [], 0
    for s, e in zip(starts, ends):
        while s < e and s < len(text) and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        out.append(text[at:s])
        at = max(at, e)
    return b"".join([*out, text[at:]])


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    A byte goes if a 100-byte string covers it that also starts earlier: in a
    document of smaller ``doc_id``, or earlier in the same one. Strings are taken
    from the input, may overlap, and do not cross documents; null texts are
    empty, texts under 100 bytes stay whole. A null ``doc_id`` counts as smallest.
    Rows that share an id are ordered by a hash of their text; rows that share id
    and text are one document and get the same figures. An empty table gives no
    rows. ``with_text`` adds the rest of the text as ``text`` (characters that are
    removed in part stay) and all columns of ``docs``, which win over clashing
    names of figures.
    """
    spark = docs.sparkSession
    base = docs.withColumns({"_dedup_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_dedup_bytes": F.coalesce("text", F.lit("")).cast("binary")})
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    base = base.withColumn("_dedup_tie", F.xxhash64("_dedup_bytes") if twice else F.lit(0).cast("long"))
    slim = base.select(F.col("_dedup_id").alias("d"), F.col("_dedup_tie").alias("r"), F.col("_dedup_bytes").alias("t"))
    slim = slim.dropDuplicates(["d", "r"]) if twice else slim
    candidates = materialize(repeated_anchors(slim), "suffix-candidates")
    spans, working = removals(slim, candidates)
    lists = materialize(spans.groupBy("d", "r").agg(F.collect_list(F.struct("start", "end")).alias("_dedup_spans")), "suffix-spans")
    discard(candidates, *working)
    rows = base.join(lists, (base["_dedup_id"] == lists["d"]) & (base["_dedup_tie"] == lists["r"]), "left")
    figures = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kept = [c for c in docs.columns if c != "text"] if with_text else ["doc_id"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for t, spans in zip(b.column(0), b.column(1)):
                t = t.as_py()
                s = e = np.zeros(0, dtype=np.int64)
                if spans.is_valid:
                    s, e = union_spans(*(spans.values.field(i).to_numpy() for i in (0, 1)))
                s, e = s.tolist(), e.tolist()
                rest = b"".join(t[a:z] for a, z in zip([0, *e], [*s, len(t)]))
                for c, v in zip(out, (len(t), len(t) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), whole_characters(t, s, e).decode() if with_text else None)):
                    c.append(v)
            made = [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made[: 5 if with_text else 4]], names=[*(f"k{i}" for i in range(len(kept))), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text])

    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    rows = rows.select(F.col("_dedup_bytes").alias("t"), "_dedup_spans", *(docs[c].alias(f"k{i}") for i, c in enumerate(kept)))
    done = rows.mapInArrow(finish, f"{fields}, {figures}" + ", text string" * with_text)
    if not with_text:
        return done.select(F.col("k0").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    own = {c: F.col(f"k{i}").alias(c) for i, c in enumerate(kept)} | {"text": F.col("text")}
    return done.select(*(own[c] for c in docs.columns), *(c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256") if c not in docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, j, substr(h, 2000 * j + 1, 2198) AS part FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS j FROM d)),
w AS (SELECT doc_id, 1000 * j + k AS i, substr(part, 2 * k + 1, 200) AS s FROM (SELECT *, unnest(range(0, least(1000, n - 99 - 1000 * j))) AS k FROM c)),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
t AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM p WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT e.doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last,
             string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
