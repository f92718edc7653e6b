"""An inverted index in blocks of ids: one row per term and block, with skip entries, and BM25 that passes over blocks by them.

A block is a range of ids that is the same for every term, so the skip entries of several terms add
up to a bound on what any document of a block can score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..working import stored
from . import lexical

#: Ids of a block, and of a range that is dealt to a task as one, as powers of two.
BLOCK_BITS, RANGE_BITS = 5, 8
#: Documents of a task, and of one if there are fewer tasks than cores; words that are made blocks at once, documents that are added to them, rows that are given out.
DEALT, LEAST, HELD, SLICE, OUT = 1 << 13, 1 << 10, 1 << 20, 512, 1 << 14
#: Term saturation and length normalisation of BM25.
K1, B = 1.2, 0.75
#: Documents in the blocks of highest bound that a query scores first, as a multiple of ``k``, to learn what the others must reach.
SEEDS = 2
#: Columns of blocks: skip entries, places of the ids in the block, lengths and counts of its documents, and for each document its first position and the steps to the next ones.
BLOCKS = "term string, block long, n_docs int, n_postings int, max_tf int, min_len int, slots array<tinyint>, lens array<int>, tfs array<int>, gaps array<int>, bucket int"


@dataclass
class Index:
    """``blocks`` (see ``BLOCKS``), ``lengths`` (``id, n_terms``), ``terms`` (``term, n_docs, n_postings``) and ``summary`` (one row: ``n_docs, n_terms``)."""

    blocks: DataFrame
    lengths: DataFrame
    terms: DataFrame
    summary: DataFrame


def words(docs: DataFrame, stops: frozenset[str]) -> DataFrame:
    """``id, w``: the words of each text in order, null where a stop word stands."""
    found = lexical.lexemes(F.coalesce("text", F.lit("")))
    rows = docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), found.alias("w"))
    return rows.withColumn("w", F.transform("w", lambda w: F.when(~w.isin(*sorted(stops)), w))) if stops else rows


def length(w: Column) -> Column:
    return F.size(F.array_compact(w)).cast("int")


def lengths(docs: DataFrame, stops: frozenset[str]) -> DataFrame:
    """``id, n_terms``: how many words of each document the index has."""
    if stops:
        return words(docs, stops).select("id", length(F.col("w")).alias("n_terms"))
    n = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(lexical.LEXEME))
    return docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), n.cast("int").alias("n_terms"))


def blocks(docs: DataFrame, stemmed: bool = True, stops: frozenset[str] | None = None) -> DataFrame:
    """The blocks of ``docs`` (``id, text``) with their ``bucket``, sorted by bucket, term and block within each partition.

    Texts are dealt by ranges of ids, whole blocks to a task, so their postings become rows of a term and a block where
    they are and no posting is shuffled or sorted as a row. A task has ``DEALT`` documents or so, whose blocks fit its sort.
    """
    stops = lexical.stop_words() if stops is None else stops
    n = docs.count()
    tasks = max(-(-n // DEALT), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)), 1)
    dealt = docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), "text").repartition(tasks, F.shiftright("id", RANGE_BITS)).sortWithinPartitions("id")
    return words(dealt, stops).mapInArrow(lambda batches: gathered(batches, stemmed), BLOCKS).sortWithinPartitions("bucket", "term", "block")


def gathered(batches: Iterator[pa.RecordBatch], stemmed: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in order of ids, from ``HELD`` words at a time; the last block of these waits for the next."""
    held: list[pa.RecordBatch] = []
    known: dict[str, str] = {}
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        held.append(batch)
        if sum(len(b.column(1).flatten()) for b in held) >= HELD:
            rows = pa.Table.from_batches(held).combine_chunks()
            blocks = rows["id"].to_numpy() >> BLOCK_BITS
            whole = int(np.searchsorted(blocks, blocks[-1]))
            yield from block_rows(rows.slice(0, whole), stemmed, known)
            held = rows.slice(whole).to_batches()
    if held:
        yield from block_rows(pa.Table.from_batches(held).combine_chunks(), stemmed, known)


def starts(*values: np.ndarray) -> np.ndarray:
    """Where a value differs from that of the place before."""
    return np.flatnonzero(np.concatenate([[True] * bool(len(values[0])), np.any([np.diff(v) != 0 for v in values], axis=0)]))


def block_rows(docs: pa.Table, stemmed: bool, known: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The blocks of whole documents ``id, w`` by bucket and term; ``known`` keeps the stems of words that were seen."""
    lists = pa.concat_arrays(docs["w"].chunks) if docs.num_rows else pa.array([], pa.list_(pa.string()))
    flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
    said = np.asarray(flat.is_valid())
    doc_of, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    pos = (np.arange(len(flat)) - first[doc_of] + 1)[said].astype(np.int32)
    doc_of = doc_of[said]
    if not len(pos):
        return
    id_of_doc, len_of_doc = docs["id"].to_numpy(), np.bincount(doc_of, minlength=len(sizes)).astype(np.int32)
    found = flat.filter(pa.array(said)).dictionary_encode()
    names, code = found.dictionary.to_pylist(), found.indices.to_numpy()
    if stemmed:
        for w in names:
            if w not in known:
                known[w] = stem(w)
        names = [known[w] for w in names]
    terms = sorted(((lexical.bucket_number(t), t.encode(), t) for t in set(names)))
    at = {t: i for i, (_, _, t) in enumerate(terms)}
    code = np.array([at[t] for t in names], dtype=np.int32)[code]
    ids = id_of_doc[doc_of]
    # documents and places are in order already, but for ids that two documents have
    order = np.argsort(code, kind="stable") if np.all(np.diff(id_of_doc) > 0) else np.lexsort((pos, ids, code))
    code, ids, pos, doc_of = code[order], ids[order], pos[order], doc_of[order]
    doc, block = starts(code, ids), starts(code, ids >> BLOCK_BITS)
    tf = np.diff(np.append(doc, len(ids))).astype(np.int32)
    lens, slots = len_of_doc[doc_of[doc]], (ids[doc] & ((1 << BLOCK_BITS) - 1)).astype(np.int8)
    gaps = np.diff(pos, prepend=0).astype(np.int32)
    gaps[doc] = pos[doc]
    docs_of, rows_of = np.append(np.searchsorted(doc, block), len(doc)).astype(np.int32), np.append(block, len(ids)).astype(np.int32)
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    columns = [
        pa.array([t for _, _, t in terms]).take(pa.array(code[block])), pa.array(ids[block] >> BLOCK_BITS), pa.array(np.diff(docs_of)), pa.array(np.diff(rows_of)), pa.array(np.maximum.reduceat(tf, docs_of[:-1])),
        pa.array(np.minimum.reduceat(lens, docs_of[:-1])), listed(docs_of, slots), listed(docs_of, lens), listed(docs_of, tf), listed(rows_of, gaps), pa.array(np.array([b for b, _, _ in terms], dtype=np.int32)[code[block]]),
    ]
    made = pa.record_batch(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])
    yield from (made.slice(i, OUT) for i in range(0, made.num_rows, OUT))


def postings(rows: DataFrame) -> DataFrame:
    """``id, term, pos`` of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, tfs, gaps = (b.column(i) for i in (2, 3, 4))
            n_docs, tf, total = slots.value_lengths().to_numpy(), tfs.flatten().to_numpy(), np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
            ids = (np.repeat(b.column(1).to_numpy(), n_docs) << BLOCK_BITS) | slots.flatten().to_numpy()
            first = np.cumsum(tf) - tf
            before = np.where(first > 0, total[first - 1], 0) if len(total) else first
            yield pa.record_batch([pa.array(np.repeat(ids, tf)), b.column(0).take(pa.array(np.repeat(np.repeat(np.arange(b.num_rows), n_docs), tf))), pa.array(total - np.repeat(before, tf))], names=["id", "term", "pos"])

    return rows.select("term", "block", "slots", "tfs", "gaps").mapInArrow(run, "id long, term string, pos long")


def id_of(slot: Column) -> Column:
    return F.shiftleft("block", BLOCK_BITS) + slot


def write(docs: DataFrame, path: str, stemmed: bool = True, stops: frozenset[str] | None = None) -> Index:
    """Write the index of ``docs`` to ``path``: blocks in buckets by term, sorted, document lengths and totals."""
    spark = docs.sparkSession
    stops = lexical.stop_words() if stops is None else stops
    blocks(docs, stemmed, stops).write.partitionBy("bucket").option("compression", "zstd").mode("overwrite").parquet(f"{path}/blocks")
    lengths(docs, stops).write.mode("overwrite").parquet(f"{path}/lengths")
    table(spark, path, "lengths").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).write.mode("overwrite").parquet(f"{path}/summary")
    return read(spark, path)


#: Stated, as a table in buckets without any row has no file to learn its columns from.
SCHEMAS = {
    "blocks": BLOCKS,
    "lengths": "id long, n_terms int",
    "summary": "n_docs long, n_terms long",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Index:
    blocks, lengths, summary = (table(spark, path, name) for name in SCHEMAS)
    return Index(blocks, lengths, counts(blocks), summary)


def counts(blocks: DataFrame) -> DataFrame:
    """``term, n_docs, n_postings``, and the ``bucket`` if there is one, from skip entries; a filter by term reaches the scan."""
    return blocks.groupBy(*(c for c in ("bucket", "term") if c in blocks.columns)).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_postings").alias("n_postings"))


def saturation(tf: Column, length: Column, average: float, k1: float = K1, b: float = B) -> Column:
    """The part of a BM25 score that a document makes; it grows with ``tf`` and falls with ``length``."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def weighted(terms: DataFrame, index: Index) -> DataFrame:
    """``qid, term, idf`` of the distinct terms of each query that the index has; a ``weight`` of a term multiplies it."""
    weight = F.max(F.col("weight") if "weight" in terms.columns else F.lit(1.0))
    asked = lexical.pinned_once(terms.groupBy("qid", "term").agg(weight.alias("weight")), "asked")
    n = index.summary.first().n_docs
    rare = F.log(1 + (n - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    found = lexical.chosen(index.terms, asked).select("term", rare.alias("idf")).join(lexical.hint(asked, asked), "term").select("qid", "term", (F.col("idf") * F.col("weight")).alias("idf"))
    return lexical.pinned_once(found, "terms")


def bounds(asked: DataFrame, index: Index, average: float, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, block, most, n``: what a document of a block can score at most, and how many match at least, from skip entries alone."""
    skips = lexical.chosen(index.blocks, asked).select("term", "block", "n_docs", "max_tf", "min_len")
    most = F.col("idf") * saturation(F.col("max_tf"), F.col("min_len"), average, k1, b)
    return skips.join(lexical.hint(asked, asked), "term").groupBy("qid", "block").agg((F.sum(most) + 1e-9).alias("most"), F.max("n_docs").alias("n"))


def scored(pairs: DataFrame, asked: DataFrame, index: Index, average: float, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, id, score`` of the documents in the blocks ``qid, block``; positions are not read."""
    rows = lexical.chosen(index.blocks, asked).select("term", "block", "slots", "lens", "tfs")
    # terms first: only a term's own blocks meet its queries, where the blocks of a query with all its terms are many times as many
    rows = rows.join(lexical.hint(asked, asked), "term").join(pairs, ["qid", "block"], "left_semi")
    opened = rows.select("qid", "idf", "block", F.inline(F.arrays_zip("slots", "lens", "tfs")))
    part = F.col("idf") * saturation(F.col("tfs"), F.col("lens"), average, k1, b)
    return opened.groupBy("qid", id_of(F.col("slots")).alias("id")).agg(F.sum(part).alias("score"))


def stages(terms: DataFrame, index: Index, k: int, k1: float = K1, b: float = B, seeds: int = SEEDS, digits: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of the first blocks, those of the blocks that can still matter, and these blocks.

    Every query scores its blocks of highest bound that hold ``seeds * k`` documents; its ``k``-th best score there is what
    another block must be able to reach to be opened at all.
    """
    asked, summary = weighted(terms, index), index.summary.first()
    average = max(summary.n_terms / max(summary.n_docs, 1), 1e-9)
    above = Window.partitionBy("qid").orderBy(F.desc("most"), "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = stored(bounds(asked, index, average, k1, b).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))), "bounds")
    best = lexical.pinned(ranked.where(F.col("above") < seeds * k).select("qid", "block"))
    first = stored(scored(lexical.hint(best, best), asked, index, average, k1, b).withColumn("score", F.round("score", digits)), "first")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    reach = lexical.pinned(first.withColumn("nth", nth).where(F.col("nth") == k).select("qid", F.col("score").alias("reach"), F.lit("").alias("term")))
    left = ranked.where(F.col("above") >= seeds * k).join(lexical.hint(reach.drop("term"), reach), "qid", "left").where(F.col("reach").isNull() | (F.col("most") + 10.0**-digits >= F.col("reach"))).select("qid", "block")
    return first, scored(left, asked, index, average, k1, b).withColumn("score", F.round("score", digits)), left


def bm25(terms: DataFrame, index: Index, k: int, **params) -> DataFrame:
    """``(qid, id, score, rank)``: the best ``k`` documents of each query (``qid, term``, any of the terms) by BM25, then id."""
    first, rest, _ = stages(terms, index, k, **params)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionAll, (first, rest)).withColumn("rank", rank).where(F.col("rank") <= k)
