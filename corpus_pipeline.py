"""A training-corpus pipeline over ``documents``: rules, near duplicates, repeated passages, mixing, packing.

Each stage takes documents with ``doc_id``, ``text``, ``source`` and any other columns, which it keeps; all but the last
return the same columns. Null and blank texts go with the rules. Rows with equal ids are documents of their own, as are
rows without one. Texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import mixing, near_copies, packing, quality, suffix_dedup
from cadenza.llm.common import discard, materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles have a Jaccard index of 0.8 or more, and all they reach, the one of smallest id stays.

    SimHash links at few bits and MinHash buckets are candidates; the true index decides.
    """
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings go from the texts; ``n_chars`` follows."""
    kept = suffix_dedup.dedup(docs, with_text=True).select(docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: as many tokens as there are, no source more than twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, each piece with its token ids; a small word cache, as workers still hold memory of earlier stages."""
    return packing.pack(docs, with_ids=True, most_words=1 << 18)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mix), ("packing", pack)]

#: SimHash and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return docs
