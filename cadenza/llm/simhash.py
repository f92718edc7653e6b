"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, materialize, wide
from .graph import components

#: Shingles whose bits are counted at once, and fingerprints that one task compares at once.
SHINGLE_BLOCK, COMPARE_BLOCK = 1 << 15, 2048


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; fewer words are one shingle, none give none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams), dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), SHINGLE_BLOCK):
        ones += np.unpackbits(h[at : at + SHINGLE_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` with one row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def split_bits(mask: int, parts: int) -> list[int]:
    """Masks of ``parts`` runs of about equally many bits that make up ``mask``."""
    places = [i for i in range(64) if mask >> i & 1]
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in places[lo:hi]) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]


def near(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of ``x`` (distinct uint64) under a Hamming distance of at most ``bits``.

    A long list is split once more by the bits that vary in it: of ``bits`` + 1 runs of them
    a close pair shares one. In a short one a node's hits leave the list of open
    nodes, so a tight group of m costs about m comparisons and gives m - 1 links.
    """
    if len(x) <= COMPARE_BLOCK:
        return spanning(x, bits)
    links: list[tuple[int, int]] = []
    for mask in split_bits(int(np.bitwise_or.reduce(x) & ~np.bitwise_and.reduce(x)), bits + 1):
        key = x & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                links += near(x[part], bits) if len(part) <= len(x) // 2 else spanning(x[part], bits)
    return links


def spanning(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """The same by comparing each node with the open ones."""
    links: list[tuple[int, int]] = []
    rest = x
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = np.bitwise_count(rest ^ at) <= bits
            if hit.any():
                found = rest[hit]
                links += [(int(at), int(y)) for y in found]
                front += list(found)
                rest = rest[~hit]
    return links


def signed(x: int) -> int:
    """A 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def bucketed(rows: DataFrame) -> DataFrame:
    """``(fp, mask, bucket)``: a bucket for the bits of each fingerprint that its ``mask`` selects."""
    return rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))


def links(fps: DataFrame, bits: int = 3, blocks: int = 5, salt_rows: int = 200_000) -> DataFrame:
    """``(u, v)``: links that span all components of the distinct fingerprints ``fp``.

    Fingerprints are split into ``blocks`` runs; a pair at ``bits`` or fewer
    differing bits agrees on ``blocks - bits`` of them, so one row goes out for
    each choice of that many runs. Rows that meet on a choice are compared by
    Hamming distance. A bucket of more than ``salt_rows`` rows is split by the same
    argument, as often as it takes: its other bits make ``bits + 1`` runs, of which a
    close pair shares one. So no task holds more than that, and a bucket of any size
    costs ``bits + 1`` rows for each of its rows, not all pairs of its parts.
    """
    spark = fps.sparkSession
    runs = split_bits((1 << 64) - 1, blocks)
    first = [signed(sum(pick)) for pick in combinations(runs, blocks - bits)]
    now = bucketed(fps.select("fp", F.explode(F.array(*map(F.lit, first))).alias("mask")))
    done: list[DataFrame] = []
    while True:
        big = materialize(now.groupBy("bucket", "mask").count().where(F.col("count") > salt_rows).select("bucket", "mask"), "big-buckets")
        deeper = [(r.mask, signed((r.mask | run) % (1 << 64))) for r in big.select("mask").distinct().collect() for run in split_bits(~r.mask % (1 << 64), bits + 1)]
        if not deeper:
            discard(big)
            done.append(now)
            break
        done.append(now.join(big, ["bucket", "mask"], "left_anti"))
        finer = spark.createDataFrame(deeper, "mask long, finer long")
        rows = now.join(big, ["bucket", "mask"], "left_semi").join(F.broadcast(finer), "mask")
        now = materialize(bucketed(rows.select("fp", F.col("finer").alias("mask")).distinct()), "finer-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            fp = np.concatenate(held)
            return made(near(np.unique(fp), bits) if len(fp) > 1 else [])

        for batch in batches:
            bucket, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            new = np.flatnonzero(np.diff(bucket)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip(np.r_[0, new], np.r_[new, len(bucket)]):
                if held and now != bucket[lo]:
                    if sum(map(len, held)) > 1:
                        out += near(np.unique(np.concatenate(held)), bits)
                    held = []
                now = bucket[lo]
                held.append(fp[lo:hi])
            yield made(out)
        if held:
            yield flush()

    def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])

    dealt = reduce(DataFrame.unionAll, (x.select("bucket", "fp") for x in done))
    return dealt.repartition(wide(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 3, blocks: int = 5, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    A component is all that links of ``bits`` or fewer differing bits reach, and
    its id the smallest ``doc_id`` in it. Null and blank texts have fingerprint
    zero and link like any other; rows with a null ``doc_id`` take part and get
    the id of their component, null if no member has one; equal ids stay
    separate rows. An empty table gives no rows. Columns besides ``doc_id`` and
    ``text`` are ignored. Texts of any length are read whole, one at a time.
    """
    own = materialize(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits, blocks))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    out = materialize(own.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")
    discard(distinct, own, labels)
    return out


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of ``docs`` for each component: of smallest ``doc_id``, then of smallest hash of its text, then any one.

    A row without an id stays only if no member has one.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    label = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **params).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    first = rows.select("_row", order.alias("o")).join(label, "_row").groupBy("component_id").agg(F.min("o")["_row"].alias("_row"))
    return rows.join(first, "_row", "left_semi").select(docs.columns)
