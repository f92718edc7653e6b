"""Rankings against labelled time spans, for all queries and modes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECALL_K, DEPTH = 5, 10
MODES, TYPES = ("keyword", "vector", "hybrid"), ("lexical", "semantic", "mixed")
LEXICAL_TARGET, SEMANTIC_TARGET = 0.80, 0.70


def span_hits(results: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of a result and a span of its query and file that share time; touching is no hit.

    Results: ``qid, mode, rank, file, start_ms, end_ms``; spans: ``qid, span_id, file, start, end`` in seconds.
    """
    s = spans.select("qid", "file", "span_id", (F.col("start") * 1000).alias("_s"), (F.col("end") * 1000).alias("_e"))
    return results.join(s, ["qid", "file"]).where((F.col("start_ms") < F.col("_e")) & (F.col("end_ms") > F.col("_s"))).drop("_s", "_e")


def score_rows(queries: DataFrame, results: DataFrame, spans: DataFrame, recall_k: int = RECALL_K, depth: int = DEPTH) -> DataFrame:
    """One row per query and mode: ``qid, type, mode, recall, rr, first_rank, n_results``.

    Recall is the share of the query's spans that the top ``recall_k`` hit; ``rr`` the
    reciprocal of the first rank that hits any, 0 without one.
    """
    modes = queries.select("qid", "type", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    top = results.where(F.col("rank") <= depth)
    hits = span_hits(top, spans).groupBy("qid", "mode").agg(F.countDistinct(F.when(F.col("rank") <= recall_k, F.col("span_id"))).alias("n_hit"), F.min("rank").alias("first_rank"))
    n_spans = spans.groupBy("qid").agg(F.countDistinct("span_id").alias("n_spans"))
    found = top.groupBy("qid", "mode").agg(F.count("*").alias("n_results"))
    out = modes.join(n_spans, "qid", "left").join(hits, ["qid", "mode"], "left").join(found, ["qid", "mode"], "left")
    return out.select(
        "qid",
        "type",
        "mode",
        F.coalesce(F.col("n_hit") / F.col("n_spans"), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        "first_rank",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
    )


def summarize(rows: DataFrame) -> DataFrame:
    """``type, mode, n, recall, mrr``: means by type and mode and, as type ``all``, by mode; empty groups have 0."""
    spark = rows.sparkSession
    scaffold = spark.createDataFrame([(t, m) for t in (*TYPES, "all") for m in MODES], "type string, mode string")
    every = rows.select(F.explode(F.array("type", F.lit("all"))).alias("type"), "mode", "recall", "rr")
    means = every.groupBy("type", "mode").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))
    return scaffold.join(means, ["type", "mode"], "left").na.fill(0, ["n"]).na.fill(0.0, ["recall", "mrr"])


def criteria(summary: DataFrame) -> DataFrame:
    """Five rows ``pos, name, target, actual, ok`` on unrounded recalls of the hybrid mode."""
    wide = summary.where(F.col("type").isin(*TYPES)).groupBy("type").pivot("mode", list(MODES)).agg(F.first("recall"))
    single = F.greatest("keyword", "vector")
    fixed = F.when(F.col("type") == "lexical", F.lit(LEXICAL_TARGET)).when(F.col("type") == "semantic", F.lit(SEMANTIC_TARGET))
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    a = wide.select(order.alias("pos"), F.concat("type", F.lit(" R@5 (hybrid)")).alias("name"), fixed.alias("target"), F.col("hybrid").alias("actual")).where("target is not null")
    b = wide.select((order + 2).alias("pos"), F.concat("type", F.lit(" R@5: hybrid >= best single arm")).alias("name"), single.alias("target"), F.col("hybrid").alias("actual"))
    return a.unionByName(b).withColumn("ok", F.col("actual") >= F.col("target"))


def failure_status(rows: DataFrame) -> DataFrame:
    """``rows`` of the hybrid mode with what became of an expected failure."""
    status = F.when(F.col("recall") == 0, "still fails").when(F.col("recall") < 1, "partial").otherwise("now passes")
    return rows.where("mode = 'hybrid'").withColumn("status", status)


def zero_result_rate(rows: DataFrame) -> DataFrame:
    return rows.where("mode = 'keyword'").agg(F.count_if(F.col("n_results") == 0).alias("n_empty"), F.count("*").alias("n_queries"))


def per_query(rows: DataFrame) -> DataFrame:
    """One row per query: recall and first rank of each mode side by side."""
    return rows.groupBy("qid", "type").pivot("mode", list(MODES)).agg(F.first("recall").alias("recall"), F.first("first_rank").alias("rank"))
