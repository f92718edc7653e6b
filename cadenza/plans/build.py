"""From transcripts and speaker spans to a searchable store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..operators import align, chunk, vector
from ..sources import documents as sink
from ..sources import files
from . import store
from .search import Searcher


def documents(spark: SparkSession, transcripts: str, diarizations: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts that have speaker spans, those spans, and ``stem`` and ``reason`` of the files that are skipped."""
    t = files.segment_normalize(files.read_json(spark, transcripts, schemas.TRANSCRIPT))
    d = files.read_json(spark, diarizations, schemas.DIARIZATION)
    both, alone = files.paired(t, d.select("stem"))
    return both, d, alone.select("stem", F.lit("no speaker spans").alias("reason"))


def turns(spark: SparkSession, transcripts: str, diarizations: str) -> DataFrame:
    """Turns of all recordings that have both documents."""
    both, d, _ = documents(spark, transcripts, diarizations)
    return align.align(files.words(both), files.spans(d))


def skipped(spark: SparkSession, transcripts: str, diarizations: str) -> DataFrame:
    """``stem`` and ``reason`` of transcripts that ``build`` leaves out."""
    return documents(spark, transcripts, diarizations)[2]


def recognise(spark: SparkSession, folder: str, out: str, load: Callable[[], Callable[[str, bytes], dict]], schema: StructType) -> int:
    """Run a model over the wav files of ``folder`` that have no document in ``out`` yet; returns how many.

    Documents are one JSON file each, named like the recording, as ``files.read_json`` takes them. A run
    that fails leaves whole documents only, and the next goes on with the rest.
    """
    todo = files.pending(files.audio(spark, folder), sink.stems(spark, out))

    def with_path() -> Callable[[str, bytes], dict]:
        model = load()
        return lambda path, content: {"_path": path, **model(path, content)}

    made = files.run_model(todo, with_path, StructType([StructField("_path", StringType()), *schema.fields]))
    made = made.withColumn("stem", files.stem_of(F.col("_path")))
    body = F.to_json(F.struct(*schema.fieldNames()))
    rows = made.select("stem", body.alias("value"))
    return sink.save(rows, out)


def build(spark: SparkSession, transcripts: str, diarizations: str, path: str, load=lambda: vector.hashed_words) -> tuple[Searcher, DataFrame]:
    """Align, chunk, embed and store; the store is replaced as a whole. Returns it and the files that were skipped."""
    made = chunk.chunk(turns(spark, transcripts, diarizations))
    store.ingest(vector.embed(store.with_ids(made, "file"), load=load), path)
    return open_store(spark, path), skipped(spark, transcripts, diarizations)


def open_store(spark: SparkSession, path: str, encode=None) -> Searcher:
    return Searcher(*store.tables(spark, path), encode)
