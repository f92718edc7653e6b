"""Near copies by five-word Jaccard: SimHash links, MinHash buckets for what they miss, exact check inside loose components.

SimHash at few bits finds copies with few edits. Texts at a Jaccard index of 0.8 differ in
about 10 of 64 bits, a distance at which pigeonhole blocks are too short to tell texts apart;
so candidates come from MinHash buckets too. Every link is then checked by the true index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import at_places, discard, materialize, wide
from .graph import components

#: Rows a band and bands: a pair at Jaccard 0.8 shares no bucket with probability (1 - 0.8 ** 6) ** 50 = 2.6e-7.
BAND, BANDS = 6, 50
#: Shingles that go through all permutations at once, and bytes of shingles of a loose component in one part.
BLOCK, PART = 4096, 16 << 20

_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 1 << 31, (BAND * BANDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _RNG.integers(0, 1 << 32, (BAND * BANDS, 1), dtype=np.uint32)


#: Words of a shingle.
WORDS = 5
#: The one shingle of a text without a word.
NO_WORD = np.array([xxhash.xxh64_intdigest(b"", 42)], dtype="<u8")


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a text without a word has one of its own."""
    h = simhash.shingle_hashes(text, WORDS)
    return np.unique(h) if len(h) else NO_WORD


def buckets(x: np.ndarray) -> list[int]:
    """One bucket for each band of the MinHash signature of a shingle set."""
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    least = np.full(BAND * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), BLOCK):
        np.minimum(least, (low[at : at + BLOCK] * FACTORS + ADDENDS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND))]


def spanning(nodes: list[int], sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """Links that span the components of shingle sets at a Jaccard index of ``percent`` or more; hits leave the open list."""
    size = np.array([len(s) for s in sets])
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(names), dtype=bool)
    links: list[tuple[int, int]] = []
    rest = np.argsort(size, kind="stable")
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            fits = np.flatnonzero((100 * size[rest] >= percent * size[at]) & (100 * size[at] >= percent * size[rest]))
            if not len(fits):
                continue
            mark[code[start[at] : start[at + 1]]] = True
            shared = np.array([np.count_nonzero(mark[code[start[i] : start[i + 1]]]) for i in rest[fits]])
            mark[code[start[at] : start[at + 1]]] = False
            hit = 100 * shared >= percent * (size[at] + size[rest[fits]] - shared)
            found = rest[fits[hit]]
            links += [(nodes[at], nodes[i]) for i in found]
            front += list(found)
            rest = np.delete(rest, fits[hit])
    return links


def signed(rows: DataFrame) -> DataFrame:
    """``(row, node, n, fp, buckets)``: equal shingle sets are one node; ``fp`` is the SimHash of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in b.column(1):
                h = simhash.shingle_hashes(t.as_py(), WORDS)
                x = np.unique(h) if len(h) else NO_WORD
                nodes.append(xxhash.xxh64_intdigest(x.tobytes(), 7))
                sizes.append(len(x))
                prints.append(simhash.majority(h))
                keys += buckets(x)
            long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), long(keys))
            yield pa.record_batch([b.column(0), long(nodes), pa.array(sizes, pa.int64()), long(prints), lists], names=["row", "node", "n", "fp", "buckets"])

    return rows.mapInArrow(run, "row long, node long, n long, fp long, buckets array<long>")


def simhash_links(own: DataFrame) -> DataFrame:
    """``(u, v)`` of nodes whose fingerprints are equal or linked, by the SimHash operator's blocks."""
    prints = materialize(own.groupBy("fp").agg(F.min("node").alias("first")), "five-word-fingerprints")
    same = own.select("node", "fp").join(prints, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    pairs = simhash.links(prints.select("fp"))
    for side in ("u", "v"):
        pairs = pairs.join(prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), side)
    return same.unionAll(pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def verified(members: DataFrame, part: int = PART) -> DataFrame:
    """``(u, v)`` links that span the true components inside the loose ones of ``members`` (root, node, n, t).

    Texts of a loose component meet in one task. A component of more than ``part``
    bytes of shingles is dealt to parts, and every two parts meet.
    """
    big = materialize(members.groupBy("root").agg(F.ceil(F.sum("n") * 8 / part).cast("int").alias("parts")).where("parts > 1"), "big-components")
    if big.isEmpty():
        dealt = members.select("root", F.lit(0).alias("a"), F.lit(0).alias("b"), "node", "t")
    else:
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
        salted = members.join(big, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
        others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
        salted = salted.withColumn("o", F.explode(others))
        dealt = salted.select("root", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def made() -> pa.RecordBatch:
            x = np.array(spanning(nodes, sets) if len(nodes) > 1 else [], dtype=np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])

        for batch in batches:
            for *now, node, t in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if now != key:
                    yield made()
                    key, nodes, sets = now, [], []
                nodes.append(node)
                sets.append(shingles(t.as_py()))
        yield made()

    grouped = dealt.repartition(wide(members.sparkSession), "root", "a", "b").sortWithinPartitions("root", "a", "b")
    return grouped.mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, part: int = PART) -> DataFrame:
    """One row of ``docs`` for each component of texts whose five-word Jaccard index is 0.8 or more.

    Of a component the row of smallest ``doc_id`` stays, then of smallest hash of
    its text, then any one; a row without an id stays only if no member has one.
    Null and blank texts are one shingle, the empty one. Texts of any length are read
    whole. An empty table stays empty; other columns are kept as they are.
    """
    rows = materialize(docs.withColumn("_near_row", F.monotonically_increasing_id()), "rows")
    text = F.coalesce("text", F.lit("")).cast("binary").alias("t")
    own = materialize(signed(rows.select(F.col("_near_row").alias("row"), text)), "signatures")
    hits = own.select("node", F.explode("buckets").alias("bucket"))
    shared = hits.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("x")).where("v < x").select("bucket", "v")
    loose = components(simhash_links(own).unionAll(hits.join(shared, "bucket").select(F.col("node").alias("u"), "v")))
    chosen = own.groupBy("node").agg(F.min("row").alias("_near_row"), F.first("n").alias("n")).join(loose, "node")
    members = at_places(rows.select("_near_row", text), "_near_row", chosen.select("_near_row", "root", "node", "n"))
    members = materialize(members.select("root", "node", "n", "t"), "loose-components")
    roots = components(verified(members, part))
    label = own.select(F.col("row").alias("_near_row"), "node").join(roots, "node", "left").select("_near_row", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_near_row")
    first = rows.select("_near_row", order.alias("o")).join(label, "_near_row").groupBy("root").agg(F.min("o")["_near_row"].alias("_near_row"))
    first = materialize(first.select("_near_row"), "first-rows")
    discard(members, own)
    return at_places(rows, "_near_row", first).select(docs.columns)
