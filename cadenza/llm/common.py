"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..working import working_folder as shared_root

#: The ASCII upper-case letters to lower case; other bytes stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder for a table, in the folder that the driver and all executors see."""
    return f"{shared_root(spark)}/cadenza/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Lost executors then cost at most the work since the last such table. The
    shuffle files behind it are no longer needed, so the JVM is asked to collect
    its garbage, upon which Spark's cleaner deletes them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for df in tables:
        remove(df.sparkSession, df._cadenza_path)


def at_places(rows: DataFrame, place: str, chosen: DataFrame) -> DataFrame:
    """The ``rows`` whose ``place`` is in ``chosen``, with the other columns of that, integers.

    ``place`` is the ``monotonically_increasing_id`` that ``rows`` were written with, so the rows that one task
    wrote have a number in its upper bits. ``chosen`` (``place`` and integers, each place once) is written in buckets of
    these numbers, and a task reads the buckets of its own rows: the rows are not shuffled.
    """
    spark = rows.sparkSession
    n, path = wide(spark), new_path(spark, "places")
    bucket = F.pmod(F.shiftright(place, 33), F.lit(n)).cast("int")
    more = [c for c in chosen.columns if c != place]
    listed = chosen.select(place, *(F.col(c).cast("long") for c in more)).withColumn("_bucket", bucket)
    listed.repartition(n, "_bucket").sortWithinPartitions("_bucket", place).write.partitionBy("_bucket").parquet(path)
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in more)])
    at = rows.columns.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        known: dict[int, pa.Table] = {}

        def load(b: int) -> pa.Table:
            if b not in known:
                if len(known) >= 4:
                    known.pop(next(iter(known)))
                folder = f"{root}/_bucket={b}"
                found = store.get_file_info(folder).type == fs.FileType.Directory
                known[b] = pq.read_table(folder, filesystem=store, partitioning=None).sort_by(place) if found else None
            return known[b]

        for batch in batches:
            places = batch.column(at).to_numpy()
            for b in np.unique((places >> 33) % n).tolist():
                table = load(b)
                if table is None:
                    continue
                ids = table[place].to_numpy()
                where = np.minimum(np.searchsorted(ids, places), len(ids) - 1)
                hit = np.flatnonzero(ids[where] == places)
                if len(hit):
                    out = batch.take(pa.array(hit))
                    extra = [table[c].take(pa.array(where[hit])).combine_chunks() for c in more]
                    yield pa.RecordBatch.from_arrays([*out.columns, *extra], names=[*batch.schema.names, *more])

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def compressor(level: int = 1) -> zstandard.ZstdCompressor:
    """A worker's compressor; making one costs more than a small blob."""
    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=1)
def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def wide(spark: SparkSession, least: int = 1) -> int:
    """Partitions for rows that fan out in Python: the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that hash partitioning by an int column deals to ``n`` different partitions, in order."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), n).alias("p"))
        found = {r.p: r.k for r in ids.groupBy("p").agg(F.min("k").alias("k")).collect()}
        size *= 2
    return [found[p] for p in range(n)]
