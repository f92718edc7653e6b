"""Search in three modes, for one query or many in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, lexical, vector
from ..operators.fuse import POOL, rrf_fuse

MODES = ("keyword", "vector", "hybrid")


@dataclass
class Searcher:
    """Chunks with vectors, their postings (stemmed and without stop words or not), and an encoder of a list of query texts."""

    chunks: DataFrame
    index: DataFrame
    encode: object = None
    stemmed: bool = True
    stops: frozenset[str] | None = None

    def _vectors(self, queries: list[tuple[int, str]]) -> DataFrame:
        spark = self.chunks.sparkSession
        encode = self.encode or vector.hashed_words
        made = encode([q for _, q in queries])
        return spark.createDataFrame([(qid, [float(x) for x in v]) for (qid, _), v in zip(queries, made)], "qid long, query array<double>")

    def ranks(self, queries: list[tuple[int, str]], k: int, mode: str, pool: int = POOL) -> DataFrame:
        """``qid, id, score, kw_rank, vec_rank, rank``."""
        if mode not in MODES:
            raise ValueError(f"no search mode {mode!r}; there are {', '.join(MODES)}")
        depth = pool if mode == "hybrid" else k
        none = F.lit(None).cast("int")
        arms = {}
        if mode != "vector":
            arms["keyword"] = lexical.keyword_search(lexical.parsed(self.chunks.sparkSession, queries, self.stemmed, self.stops), self.index, depth)
        if mode != "keyword":
            arms["vector"] = vector.vector_search(self._vectors(queries), self.chunks, depth)
        if mode == "hybrid":
            return rrf_fuse(arms["keyword"], arms["vector"], k)
        ranks = {"keyword": ("rank", None), "vector": (None, "rank")}[mode]
        kw, vec = (F.col(r) if r else none for r in ranks)
        return arms[mode].select("qid", "id", "score", kw.alias("kw_rank"), vec.alias("vec_rank"), "rank")

    def search(self, queries: list[tuple[int, str]], k: int = 5, mode: str = "hybrid", pool: int = POOL) -> DataFrame:
        """Ranked moments with their columns."""
        moments = self.chunks.select("id", "file", "speaker", "start_ms", "end_ms", "text")
        return self.ranks(queries, k, mode, pool).join(moments, "id").select("qid", "rank", "id", "file", "speaker", "start_ms", "end_ms", "text", "score", "kw_rank", "vec_rank")

    def evaluate(self, queries: DataFrame, spans: DataFrame, modes: tuple[str, ...] = MODES, k: int = evaluate.DEPTH) -> DataFrame:
        """Score rows of all queries in all modes; the queries are a small labelled set."""
        texts = [(r.qid, r.query) for r in queries.select("qid", "query").collect()]
        found = None
        for mode in modes:
            rows = self.search(texts, k, mode).withColumn("mode", F.lit(mode))
            found = rows if found is None else found.unionByName(rows)
        return evaluate.score_rows(queries, found, spans).where(F.col("mode").isin(*modes))
