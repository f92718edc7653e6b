"""JSON documents, audio files and precomputed model outputs, with positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def stem_of(path) -> F.Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row per document (or array element), with ``stem`` of the file."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("*", stem_of(F.col("_metadata.file_path")).alias("stem"))


def segment_normalize(transcripts: DataFrame) -> DataFrame:
    """Trim texts, round times to milliseconds, and make missing word lists empty."""
    word = lambda w: F.struct(F.trim(w["word"]).alias("word"), F.round(w["start"], 3).alias("start"), F.round(w["end"], 3).alias("end"))
    segment = lambda s: F.struct(s["id"].alias("id"), F.trim(s["text"]).alias("text"), F.round(s["start"], 3).alias("start"), F.round(s["end"], 3).alias("end"), F.transform(F.coalesce(s["words"], F.array().cast(schemas.SEGMENT["words"].dataType)), word).alias("words"))
    return transcripts.withColumn("segments", F.transform("segments", segment))


def words(transcripts: DataFrame) -> DataFrame:
    """``file, word_pos, word, start, end`` in document order across segments."""
    x = transcripts.select(F.col("stem").alias("file"), F.posexplode("segments").alias("s", "seg"))
    x = x.select("file", "s", F.posexplode("seg.words").alias("w", "x"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("s", "w")) - 1
    return x.select("file", pos.cast("long").alias("word_pos"), "x.word", "x.start", "x.end")


def spans(diarizations: DataFrame) -> DataFrame:
    """``file, span_pos, speaker, start, end``; order is that of (start, end)."""
    x = diarizations.select(F.col("stem").alias("file"), F.explode(F.array_sort(F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["speaker"].alias("speaker"))))).alias("x"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("x.start", "x.end")) - 1
    return x.select("file", pos.cast("long").alias("span_pos"), "x.speaker", "x.start", "x.end")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks with ``chunk_pos``, their place in the file's array."""
    text = spark.read.text(path, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("stem"), F.from_json("value", f"array<{schemas.CHUNK.simpleString()}>").alias("c"))
    return text.select("stem", F.posexplode("c").alias("chunk_pos", "x")).select("stem", "chunk_pos", "x.*")


def golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled queries ``qid, query, type, note, expect_fail, fail_reason`` and their spans ``qid, span_id, file, start, end, why``."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{schemas.GOLDEN.simpleString()}>").alias("g"))
    rows = text.select(F.posexplode("g").alias("qid", "x")).select(F.col("qid").cast("long"), "x.*")
    labels = rows.select("qid", F.posexplode("spans").alias("span_id", "s")).select("qid", "span_id", "s.file", "s.start", "s.end", "s.why")
    return rows.drop("spans"), labels


def audio(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, path, length, content`` of wav files; columns that are not asked for are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select(stem_of(F.col("path")).alias("stem"), "path", "length", "content")


def pending(inputs: DataFrame, outputs: DataFrame, key: str = "stem") -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(outputs.select(key), key, "left_anti")


def paired(left: DataFrame, right: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Inputs of both kinds, and those that lack the second."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti")


def run_model(inputs: DataFrame, load: Callable[[], Callable[[str, bytes], dict]], schema: StructType) -> DataFrame:
    """Speech or speaker models over audio rows ``path, content``.

    ``load`` makes the model once per task, and only if the task has rows; it maps a
    file to a document of ``schema``. Models themselves are not part of this package.
    """
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            if len(b):
                model = model or load()
                yield pd.DataFrame([model(p, c) for p, c in zip(b["path"], b["content"])], columns=names)

    return inputs.select("path", "content").mapInPandas(run, schema)
