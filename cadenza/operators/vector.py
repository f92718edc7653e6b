"""Exact cosine top-k, encoders, and an optional approximate index."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..working import new_path

#: Texts that an encoder is given at once.
BATCH = 32
#: Rows that meet a block of queries at once, and the id of a place that is free.
ROWS, NO_ID = 2048, np.iinfo(np.int64).max
#: Width of the stored vectors.
DIMENSIONS = 384


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length rows of an Arrow list column as float64, and which of them are vectors at all.

    Null and zero vectors, those with null elements and, if ``width`` is given, those of another width are not.
    """
    sizes = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), -1)
    width = max(sizes, default=0) if width is None else width
    ok = (sizes == width) & (width > 0)
    out = np.zeros((len(column), max(int(width), 0)))
    if ok.any():
        flat = column.filter(pa.array(ok)).flatten().cast(pa.float64())
        out[ok] = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    ok &= np.isfinite(norms) & (norms > 0)
    out[ok] /= norms[ok, None]
    out[~ok] = 0
    return out, ok


def query_blocks(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The stored queries, so many at a time."""
    store, root = fs.FileSystem.from_uri(path)
    for f in sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")):
        yield from pq.ParquetFile(f, filesystem=store).iter_batches(rows)


class Best:
    """The best ``k`` of each query of a block so far, by score to the twelfth digit, then id; vectors without a score last.

    These are two arrays of a query and a place each; rows are met ``ROWS`` at a time, so scores take no more than that times the block.
    """

    def __init__(self, block: pa.RecordBatch, k: int):
        self.qid, self.k = block.column(0), k
        own = block.column(1)
        self.own = np.where(np.asarray(own.is_valid()), own.fill_null(0).to_numpy(zero_copy_only=False), NO_ID) if len(own) else np.zeros(0, np.int64)
        self.q, self.ok = matrix(block.column(2))
        self.ids, self.scores = np.full((len(own), k), NO_ID, dtype=np.int64), np.full((len(own), k), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, ok: np.ndarray) -> None:
        """Meet rows in ascending order of ids."""
        for at in range(0, len(ids), ROWS) if len(self.own) else ():
            self._meet(*(v[at : at + ROWS] for v in (ids, x, ok)))

    def _meet(self, ids: np.ndarray, x: np.ndarray, ok: np.ndarray) -> None:
        same = x.shape[1] == self.q.shape[1]
        scores = np.round(self.q @ x.T, 12) if same else np.zeros((len(self.own), len(ids)))
        scores[~self.ok | (not same)] = -np.inf
        scores[:, ~ok] = -np.inf
        more = self.k + 1  # one may be the query's own
        least = np.partition(scores, -more, axis=1)[:, -more] if len(ids) > more else np.full(len(self.own), -np.inf)
        last, last_id = self.scores[:, -1:], self.ids[:, -1:]
        take = scores >= np.maximum(least[:, None], last)
        none = np.flatnonzero((least == -np.inf) & (last[:, 0] == -np.inf))
        if len(none):  # those without a score fill up in order of ids
            empty = scores[none] == -np.inf
            take[none] &= ~empty | ((np.cumsum(empty, axis=1) <= more) & (ids < last_id[none]))
        j, i = np.nonzero(take)
        j, i = (v[ids[i] != self.own[j]] for v in (j, i))
        if not len(j):
            return
        rows = np.unique(j)
        row = np.concatenate([np.repeat(rows, self.k), j])
        score, found = np.concatenate([self.scores[rows].ravel(), scores[j, i]]), np.concatenate([self.ids[rows].ravel(), ids[i]])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < self.k
        self.scores[row[kept], nth[kept]], self.ids[row[kept], nth[kept]] = score[kept], found[kept]

    def rows(self) -> pa.RecordBatch:
        j, nth = np.nonzero(self.ids != NO_ID)
        scores = self.scores[j, nth]
        return pa.record_batch([self.qid.take(pa.array(j)), pa.array(self.ids[j, nth]), pa.array(scores, mask=np.isinf(scores))], names=["qid", "id", "score"])


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, held: int = 64) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` nearest of each query by cosine, then id; null vectors last.

    ``queries`` (``qid, query``, and ``own``, an id that a query must not find, if there
    is such a column) are a stated set that meets all rows. They are written to the working folder
    once; every task reads them a block at a time and multiplies each batch of vectors with it, so
    neither side is collected, copied per row or shuffled. A task keeps its best ``k`` per query of up to
    ``held`` blocks from batch to batch, of more blocks it gives out each batch's. There are as many tasks as a few
    for a core, so what they give out grows with the queries, not with queries times vectors.
    """
    spark = queries.sparkSession
    own = F.col("own") if "own" in queries.columns else F.lit(None)
    path = new_path(spark, "queries")
    queries.select("qid", own.cast("long").alias("own"), F.col("query").cast("array<double>").alias("query")).write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Best] | None = None
        for b in batches:
            ids = b.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ok = matrix(b.column(1))
            if kept is None:
                first = [Best(q, k) for q in islice(query_blocks(path, block), held + 1)]
                kept = first if len(first) <= held else []
            for best in kept or (Best(q, k) for q in query_blocks(path, block)):
                best.add(ids[order], x[order], ok[order])
                if not kept:
                    yield best.rows()
        for best in kept or []:
            yield best.rows()

    kind = queries.schema["qid"].dataType.simpleString()
    dealt = vectors.select(F.col("id").cast("long"), "embedding").coalesce(2 * spark.sparkContext.defaultParallelism)
    scored = dealt.mapInArrow(run, f"qid {kind}, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hashed_words(texts: list[str], width: int = DIMENSIONS) -> np.ndarray:
    """A stand-in encoder for tests: signed feature hashing of words, unit length. It knows no meaning."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    for row, text in zip(out, texts):
        for w in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(w.encode())
            row[h % width] += 1.0 if h >> 31 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(chunks: DataFrame, text: str = "embed_text", load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_words, width: int = DIMENSIONS, batch: int = BATCH) -> DataFrame:
    """``chunks`` with a unit-length ``embedding``; ``load`` makes the encoder once per worker, and a wrong width is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for t in texts:
            found = [encode(t.iloc[i : i + batch].tolist()) for i in range(0, len(t), batch)]
            made = np.concatenate(found) if found else np.zeros((0, width), dtype=np.float32)
            if made.shape[1] != width:
                raise ValueError(f"the encoder gives {made.shape[1]} dimensions, not {width}")
            norms = np.linalg.norm(made, axis=1, keepdims=True)
            yield pd.Series(list((made / np.where(norms == 0, 1, norms)).astype(np.float32)))

    return chunks.withColumn("embedding", run(F.col(text)))


def approximate_index(vectors: DataFrame, tables: int = 4, width: float = 0.5, seed: int = 7):
    """Random-projection hashing of unit vectors; squared distance 2 - 2 cos orders like the cosine."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("embedding is not null").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)
