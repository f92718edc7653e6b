"""The synthetic tables as words, spans, turns, texts and vectors. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

WORD_TYPES, SPAN_TYPES = ("click", "error", "signup"), ("view", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, pos, event_type, start, end``: an event lasts ``value`` minutes."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    x = e.select(F.col("user_id").alias("file"), "event_id", "event_type", start.alias("start"), (start + F.round(F.coalesce("value", F.lit(0.0)) * 60000).cast("long")).alias("end"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("start", "event_id")) - 1
    return x.select("file", pos.cast("long").alias("pos"), "event_type", "start", "end")


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = timed_events(spark, sf_dir).where(F.col("event_type").isin(*WORD_TYPES))
    return x.select("file", F.col("pos").alias("word_pos"), F.col("event_type").alias("word"), "start", "end")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = timed_events(spark, sf_dir).where(F.col("event_type").isin(*SPAN_TYPES))
    return x.select("file", F.col("pos").alias("span_pos"), F.col("event_type").alias("speaker"), "start", "end")


def spoken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as words that their type speaks."""
    x = timed_events(spark, sf_dir)
    return x.select("file", F.col("pos").alias("word_pos"), F.concat("event_type", F.lit("."), (F.col("pos") % 7).cast("string")).alias("word"), "start", "end", F.col("event_type").alias("speaker"), (F.col("pos") % 5 == 0).alias("low"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, turn_pos, speaker, text, words``; a word takes 0.4 s of each half second of its turn."""
    c = table(spark, sf_dir, "conversations")
    t = tokens(F.coalesce("text", F.lit("")))
    words = F.transform(t, lambda w, i: F.struct(w.alias("word"), (i * 0.5).cast("double").alias("start"), ((i * 5 + 4) / 10.0).cast("double").alias("end")))
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("turn_pos"), F.col("role").alias("speaker"), "text", words.alias("words"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def benchmark_terms(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """``qid, term, i``: the first ``n`` different ASCII words of six letters or more of a benchmark text."""
    b = table(spark, sf_dir, "benchmark")
    found = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)), F.lit(1), F.lit(n))
    return b.select(F.col("item_id").alias("qid"), F.posexplode(found).alias("i", "term"))
