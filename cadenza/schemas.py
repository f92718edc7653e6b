"""Explicit schemas. Order in a list is data, so every table carries a position column."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


S, D, I, L = StringType(), DoubleType(), IntegerType(), LongType()  # noqa: E741

WORD = _struct(word=S, start=D, end=D)
SEGMENT = _struct(id=I, text=S, start=D, end=D, words=ArrayType(WORD))
TRANSCRIPT = _struct(file=S, duration=D, segments=ArrayType(SEGMENT))
SPAN = _struct(speaker=S, start=D, end=D)
DIARIZATION = _struct(file=S, turns=ArrayType(SPAN))
TURN = _struct(speaker=S, start=D, end=D, text=S, n_words=I, n_low=I, words=ArrayType(WORD))
TURNS = _struct(file=S, turns=ArrayType(TURN))
CHUNK = _struct(file=S, speaker=S, start_ms=I, end_ms=I, text=S, n_words=I, embed_text=S)
STORED = StructType([StructField("id", L, False), *CHUNK.fields[:-1], StructField("embedding", ArrayType(FloatType()), True)])
RESULT = _struct(id=L, file=S, speaker=S, start_ms=I, end_ms=I, text=S, score=D, kw_rank=I, vec_rank=I)
LABEL = _struct(file=S, start=D, end=D, why=S)
GOLDEN = _struct(query=S, type=S, spans=ArrayType(LABEL), note=S, expect_fail=BooleanType(), fail_reason=S)
EVAL_ROW = _struct(query=S, type=S, mode=S, recall=D, rr=D, first_rank=I, n_results=I)
