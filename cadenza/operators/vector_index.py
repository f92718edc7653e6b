"""Approximate cosine top-k: an inverted file of coarse cells that a query probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..working import new_path
from .vector import Best, matrix

#: Cells, vectors a cell that centroids are trained on, training rounds, and cells that a query probes.
CELLS, PER_CELL, ROUNDS, PROBES = 64, 64, 12, 40


def train(vectors: DataFrame, cells: int = CELLS, per_cell: int = PER_CELL, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids, by spherical k-means over ``cells * per_cell`` vectors: those of least hashed id, a bounded sample.

    Fewer distinct vectors give fewer centroids; none give one that is zero.
    """
    sample = vectors.where("embedding is not null").select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(cells * per_cell).select("embedding").toArrow()
    column = sample["embedding"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64()))
    x, ok = matrix(column)
    x = x[ok]
    if not len(x):
        return np.zeros((1, max(x.shape[1], 1)))
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(5).permutation(len(c))[:cells]]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` best cells of each row, best first; a row of another width goes to the first cells."""
    scores = x @ centroids.T if x.shape[1] == centroids.shape[1] else np.zeros((len(x), len(centroids)))
    n = min(n, len(centroids))
    part = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable"), axis=1)


def write(vectors: DataFrame, path: str, cells: int = CELLS, per_cell: int = PER_CELL) -> None:
    """Write every row of ``vectors`` (``id, embedding``) to the folder of its cell; null vectors go to the first.

    Rows are dealt by ranges of cell and id, so a cell that most vectors are in is many tasks' work.
    """
    spark = vectors.sparkSession
    centroids = train(vectors, cells, per_cell)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = matrix(b.column(1), centroids.shape[1])
            cell = np.where(ok, nearest(x, centroids)[:, 0], 0).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.record_batch([*b.columns, pa.array(cell)], names=["id", "embedding", "cell"])

    rows = vectors.select(F.col("id").cast("long"), "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    made = rows.mapInArrow(assign, f"id long, embedding {kind}, cell int")
    made.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist(), kind) for i, c in enumerate(centroids)], "cell int, centroid array<double>, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def search(queries: DataFrame, path: str, k: int, probes: int = PROBES, block: int = 1024) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` nearest of each query among the vectors of its ``probes`` nearest cells.

    ``queries`` are as in ``vector.vector_search``; with as many probes as cells the result is the same.
    Queries are written by cell; only probed cells are read, and a task multiplies the vectors of a
    cell with the queries that probe it, a block at a time, and keeps ``k`` a query.
    """
    spark = queries.sparkSession
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one row per cell
    centroids = np.array([r.centroid for r in rows])
    own = F.col("own") if "own" in queries.columns else F.lit(None)
    kind, asked = queries.schema["qid"].dataType.simpleString(), new_path(spark, "probes")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = matrix(b.column(2), centroids.shape[1])
            if len(x):
                cells = nearest(x, centroids, probes)
                each = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.record_batch([*(c.take(each) for c in b.columns), pa.array(cells.ravel().astype(np.int32))], names=["qid", "own", "query", "cell"])

    sent = queries.select("qid", own.cast("long").alias("own"), F.col("query").cast("array<double>").alias("query"))
    sent.mapInArrow(probe, f"qid {kind}, own long, query array<double>, cell int").repartition("cell").write.partitionBy("cell").parquet(asked)
    wanted = sorted(r.cell for r in spark.read.schema(f"qid {kind}, own long, query array<double>, cell int").parquet(asked).select("cell").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(asked)
        now, kept = None, []
        for whole in batches:
            cells = whole.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                if cell != now:
                    yield from (best.rows() for best in kept)
                    files = store.get_file_info(fs.FileSelector(f"{root}/cell={cell}"))
                    now, kept = cell, [Best(q, k) for f in files if f.path.endswith(".parquet") for q in pq.ParquetFile(f.path, filesystem=store).iter_batches(block)]
                b = whole.filter(pa.array(cells == cell))
                ids = b.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                x, ok = matrix(b.column(1))
                for best in kept:
                    best.add(ids[order], x[order], ok[order])
        yield from (best.rows() for best in kept)

    vectors = cells_of(spark, path, rows[0].kind).where(F.col("cell").isin(wanted)).select("id", "embedding", "cell")
    scored = vectors.mapInArrow(run, f"qid {kind}, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def cells_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id long, embedding {kind}, cell int").parquet(f"{path}/cells")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vectors with their cells, and the centroids."""
    centroids = spark.read.parquet(f"{path}/centroids")
    return cells_of(spark, path, centroids.first().kind), centroids.select("cell", "centroid")
