"""Reciprocal Rank Fusion of two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, POOL = 60, 30


def rrf_fuse(keyword: DataFrame, vector: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """``(qid, id, score, kw_rank, vec_rank, rank)`` from two arms of ``(qid, id, rank)``.

    The score is the sum of 1 / (rrf_k + rank) over the arms. Order: score, best rank,
    id. A document of one arm has a null rank in the other.
    """
    a = keyword.select("qid", "id", F.col("rank").alias("kw_rank"))
    b = vector.select("qid", "id", F.col("rank").alias("vec_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "id"], "full_outer").withColumn("score", part("kw_rank") + part("vec_rank"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.least("kw_rank", "vec_rank"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)
