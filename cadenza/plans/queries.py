"""Registered queries over the synthetic tables. Scores are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import activity, align, block_index, chunk, evaluate, fuse, fuzzy, lexical, rerank, vector, vector_index
from ..sources import files, tables
from ..working import new_path, stored
from . import store
from .search import Searcher

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
GAP_MS, MIN_SPAN_MS, BIN_MS = 12 * 3600 * 1000, 60_000, 24 * 3600 * 1000


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def long(name: str, alias: str | None = None):
    return F.col(name).cast("long").alias(alias or name.rpartition(".")[2])


# --- sources, ingest ---


@query
def scan_conversation_stats(spark, d):
    c = tables.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.sum(F.length("text")).alias("n_chars"))


@query
def token_counts(spark, d):
    return tables.documents(spark, d).select("id", text.count_tokens(F.col("text")).cast("long").alias("n_tokens"), F.length(text.non_space_chars(F.col("text"))).cast("long").alias("n_chars"))


@query
def anti_join_pending(spark, d):
    docs, labels = (tables.table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return files.pending(docs, labels, "doc_id")


@query
def paired_inputs(spark, d):
    docs, labels = tables.table(spark, d, "documents").select("doc_id", "source"), tables.table(spark, d, "labels")
    return files.paired(docs, labels, "doc_id")[0].select("doc_id", "source", long("quality"), long("toxic"))


def stored_documents(spark, d) -> DataFrame:
    docs = tables.documents(spark, d).select("source", "id", "text", text.count_tokens(F.col("text")).alias("n_words"))
    return store.with_ids(docs.withColumnRenamed("id", "doc_id"), "source", "doc_id")


@query
def ingest_ids(spark, d):
    return stored_documents(spark, d).select("doc_id", "source", "id")


@query
def ingest_by_file(spark, d):
    return store.by_file(stored_documents(spark, d).withColumnRenamed("source", "file"))


@query
def ingest_health(spark, d):
    docs = tables.documents(spark, d).join(tables.vectors(spark, d), "id", "left")
    return store.health(docs, stored_index(spark, d).lengths)


@query
def segment_normalize(spark, d):
    e = tables.timed_events(spark, d)
    word = F.struct(F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("word"), (F.col("start") % 100_000_000 / 1000.0).alias("start"), (F.col("end") % 100_000_000 / 1000.0).alias("end"))
    segment = F.struct(F.col("pos").cast("int").alias("id"), F.concat(F.lit("  "), "event_type").alias("text"), word["start"].alias("start"), word["end"].alias("end"), F.when(F.col("pos") % 2 == 0, F.array(word)).alias("words"))
    docs = e.select("file", "pos", F.array(segment).alias("segments"))
    x = files.segment_normalize(docs).select("file", "pos", F.explode("segments").alias("s"))
    first = F.get("s.words", 0)
    return x.select("file", "pos", "s.text", "s.start", "s.end", F.size("s.words").cast("long").alias("n_words"), first["word"].alias("word"), first["end"].alias("word_end"))


# --- align ---


@query
def filter_spans(spark, d):
    return align.filter_spans(tables.event_spans(spark, d), MIN_SPAN_MS)


@query
def exclusive_spans(spark, d):
    return align.exclusive_spans(tables.event_spans(spark, d), BIN_MS)


@query
def voice_segments(spark, d):
    """Active stretches of a user's events, whose lengths stand for energies."""
    windows = tables.timed_events(spark, d).select("file", F.col("pos").alias("window"), (F.col("end") - F.col("start")).cast("double").alias("energy"))
    return activity.segments(windows, 20 * 60_000, 100 * 60_000, 3, 16)


@query
def speaker_totals(spark, d):
    x = align.speaker_totals(tables.event_spans(spark, d))
    return x.select("file", "speaker", "total", F.round("share", 6).alias("share"))


def conversation_pieces(spark, d) -> DataFrame:
    """Letters and single marks of a turn as pieces, so that stops, hyphens and percent signs glue back."""
    c = tables.table(spark, d, "conversations")
    x = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+|[^\s\p{L}])"), 1)).alias("p", "word"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p")) - 1
    return x.select(F.col("conv_id").alias("file"), pos.cast("long").alias("word_pos"), "word", (pos * 500).cast("long").alias("start"), (pos * 500 + 400).cast("long").alias("end"))


@query
def join_split_tokens(spark, d):
    return align.join_split_tokens(conversation_pieces(spark, d))


def assigned(spark, d) -> DataFrame:
    return align.assign_speakers(tables.event_words(spark, d), tables.event_spans(spark, d), MIN_SPAN_MS, BIN_MS, "skip")


@query
def assign_overlap(spark, d):
    return assigned(spark, d).select("file", "word_pos", "speaker", "low")


@query
def group_turns(spark, d):
    return align.group_turns(tables.spoken_events(spark, d), GAP_MS).select("file", "turn_pos", "speaker", "start", "end", "text", long("n_words"), long("n_low"))


def aligned(spark, d) -> DataFrame:
    return align.align(tables.event_words(spark, d), tables.event_spans(spark, d), MIN_SPAN_MS, GAP_MS, BIN_MS, "skip")


@query
def align_end_to_end(spark, d):
    return aligned(spark, d).select("file", "turn_pos", "speaker", "start", "end", "text", long("n_words"), long("n_low"))


@query
def align_invariants(spark, d):
    words = tables.spoken_events(spark, d)
    x = align.invariants(words, align.group_turns(align.join_split_tokens(words.drop("speaker", "low")).withColumns({"speaker": F.lit("a"), "low": F.lit(False)}), GAP_MS))
    return x.select("file", long("chars_in"), long("chars_out"), long("tokens_in"), long("tokens_out"), "ok")


@query
def align_report(spark, d):
    x = align.report(aligned(spark, d), tables.event_spans(spark, d), MIN_SPAN_MS)
    return x.select("file", "n_turns", long("n_words"), long("n_low"), "n_spans", "n_dropped", F.round("low_pct", 6).alias("low_pct"))


@query
def low_turns(spark, d):
    x = align.low_turns(aligned(spark, d))
    return x.select("file", "turn_pos", long("rank"), long("n_low"), text.snippet(F.col("text"), 80).alias("snippet"))


# --- chunk ---

#: Words of the synthetic prose that stand in for backchannels.
FILLERS = ("the", "of", "to", "and", "is", "de", "la", "que", "und", "der", "die", "thth", "er", "on")


@query
def backchannel(spark, d):
    c = tables.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("part", "s"))
    return c.select("conv_id", "turn", long("part"), text.is_backchannel(F.col("s"), FILLERS).alias("is_backchannel"))


@query
def split_sentences(spark, d):
    x = tables.conversation_turns(spark, d).select("file", "turn_pos", F.posexplode(chunk.split_sentences(F.transform("words", lambda w: w.cast(chunk.WORD)))).alias("pos", "s"))
    return x.select("file", "turn_pos", long("pos"), F.array_join(F.transform("s", lambda w: w["word"]), " ").alias("sentence"))


@query
def context_for(spark, d):
    return chunk.with_context(tables.conversation_turns(spark, d)).select("file", "turn_pos", "context")


@query
def split_turn(spark, d):
    pieces = chunk.split_turn(F.transform("words", lambda w: w.cast(chunk.WORD)), 40)
    x = tables.conversation_turns(spark, d).select("file", "turn_pos", F.posexplode(pieces).alias("pos", "p"))
    return x.select("file", "turn_pos", long("pos"), F.size("p").cast("long").alias("n_words"), F.array_join(F.transform("p", lambda w: w["word"]), " ").alias("text"))


@query
def merge_small(spark, d):
    """Documents of a source as chunks of one word per 40 characters, merged whatever the speaker."""
    docs = tables.table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 40).cast("int").alias("n"))
    word = F.struct(F.col("doc_id").cast("string").alias("word"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    one = F.struct(F.lit("a").alias("speaker"), F.array(word).alias("words"), F.lit("").alias("context"), F.col("n")).cast(chunk.CHUNK)
    x = chunk.merge_rows(docs.withColumn("c", one), "source", "doc_id", "c")
    return x.select(F.col("file").alias("source"), F.col("chunk_pos").alias("pos"), long("c.n", "n"), F.array_join(F.transform("c.words", lambda w: w["word"]), " ").alias("ids"))


def chunked(spark, d) -> DataFrame:
    return chunk.chunk(tables.conversation_turns(spark, d))


@query
def chunk_output(spark, d):
    return chunked(spark, d).select("file", long("chunk_pos"), "speaker", long("start_ms"), long("end_ms"), "text", long("n_words"), "embed_text")


@query
def chunk_size_report(spark, d):
    x = chunk.size_report(chunked(spark, d))
    return x.select("file", *(long(c) for c in x.columns[1:]))


# --- search ---


def stored_index(spark, d) -> block_index.Index:
    """The stored index of the documents, unstemmed, which DuckDB can make too."""
    return store.index_of(tables.documents(spark, d), f"{d}/documents.parquet", False, frozenset())


def index(spark, d) -> DataFrame:
    return stored_index(spark, d).blocks


def terms(spark, d, kind: str = "and") -> DataFrame:
    """Query rows of a kind: both terms, either, the first without the second, or the first two words as a phrase."""
    t = tables.benchmark_terms(spark, d)
    off = F.lit(0)
    if kind == "phrase":
        b = tables.table(spark, d, "benchmark")
        t = b.select(F.col("item_id").alias("qid"), F.posexplode(F.slice(lexical.lexemes(F.col("text")), F.lit(1), F.lit(2))).alias("i", "term"))
        off = F.col("i")
    grp, alt = {"and": ("i", F.lit(0)), "not": ("i", F.lit(0)), "or": (F.lit(0), "i"), "phrase": (F.lit(0), F.lit(0))}[kind]
    grp, alt = (F.col(x) if isinstance(x, str) else x for x in (grp, alt))
    size = F.count("*").over(Window.partitionBy("qid")) if kind == "phrase" else F.lit(1)
    return t.select("qid", grp.cast("int").alias("grp"), (F.col("i") == 1 if kind == "not" else F.lit(False)).alias("negated"), alt.cast("int").alias("alt"), size.cast("int").alias("size"), "term", off.cast("long").alias("off"))


@query
def postings(spark, d):
    x = block_index.postings(index(spark, d))
    return x.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"), F.sum("pos").alias("sum_pos"))


@query
def keyword_and(spark, d):
    return lexical.boolean_match(terms(spark, d), index(spark, d))


@query
def keyword_or(spark, d):
    return lexical.boolean_match(terms(spark, d, "or"), index(spark, d))


@query
def keyword_not(spark, d):
    return lexical.boolean_match(terms(spark, d, "not"), index(spark, d))


@query
def keyword_phrase(spark, d):
    return lexical.boolean_match(terms(spark, d, "phrase"), index(spark, d))


def keyword_arm(spark, d, k: int = fuse.POOL) -> DataFrame:
    """Arms rank by rounded scores, so that ties are the same for every summation order."""
    t, i = lexical.pinned(terms(spark, d)), index(spark, d)
    scored = lexical.cover_density(t, i, lexical.boolean_match(t, i)).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


@query
def keyword_rank(spark, d):
    return keyword_arm(spark, d, 10).select("qid", "id", "score", long("rank"))


def vector_arm(spark, d, k: int, only: DataFrame | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all others; ``only`` (``qid``) are those that are asked for."""
    v = tables.vectors(spark, d)
    asked = v.where("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("qid"), F.col("id").alias("own"), F.col("embedding").alias("query"))
    return vector.vector_search(asked if only is None else asked.join(only.select("qid").distinct(), "qid", "left_semi"), v, k)


@query
def vector_topk(spark, d):
    return vector_arm(spark, d, 10).select("qid", "id", F.round("score", 6).alias("score"), long("rank"))


@query
def bm25_rank(spark, d):
    """The best ten documents for the two long words of each benchmark item."""
    return block_index.bm25(tables.benchmark_terms(spark, d), stored_index(spark, d), 10, digits=6).select("qid", "id", "score", long("rank"))


def misspelt(spark, d) -> DataFrame:
    """The two long words of each benchmark item without their third letter."""
    t = tables.benchmark_terms(spark, d)
    return t.select("qid", F.concat(F.substring("term", 1, 2), F.substring("term", 4, 100)).alias("term"))


@query
def fuzzy_terms(spark, d):
    """Words of the documents within two edits of misspelt query words."""
    found = fuzzy.matches(misspelt(spark, d), stored_index(spark, d).terms.select("term", "n_docs"))
    return found.select("term", "match", long("distance"), long("n_docs"))


@query
def fuzzy_rank(spark, d):
    """BM25 over the words near misspelt query words, each at half the weight per edit."""
    i = stored_index(spark, d)
    return block_index.bm25(fuzzy.expanded(misspelt(spark, d), i.terms), i, 10, digits=6).select("qid", "id", "score", long("rank"))


def vector_cells(spark, d) -> tuple[DataFrame, str]:
    """Queries as of ``vector_arm``, and the folder of the vectors' cells."""
    v = tables.vectors(spark, d)
    path = new_path(spark, "cells")
    vector_index.write(v, path)
    return v.where("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("qid"), F.col("id").alias("own"), F.col("embedding").alias("query")), path


@query
def vector_cells_all(spark, d):
    """All cells probed: every row is in one cell, and the result is that of ``vector_topk``."""
    asked, path = vector_cells(spark, d)
    return vector_index.search(asked, path, 10, vector_index.CELLS).select("qid", "id", F.round("score", 6).alias("score"), long("rank"))


@query
def vector_cells_few(spark, d):
    """The cells probed that make up a recall of 0.9 or more."""
    asked, path = vector_cells(spark, d)
    return vector_index.search(asked, path, 10).select("qid", "id", F.round("score", 6).alias("score"), long("rank"))


@query
def store_upsert(spark, d):
    """A store of all documents after an update of every second source: labelled texts are revised, short ones go, benchmark items come."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("lang").alias("speaker"), F.col("doc_id").cast("int").alias("start_ms"), F.coalesce("text", F.lit("")).alias("text"))
    rest = [(F.col("start_ms") + 1).alias("end_ms"), "text", text.count_tokens(F.col("text")).alias("n_words"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding")]
    path = new_path(spark, "store")
    store.ingest(store.with_ids(docs.select("file", "speaker", "start_ms", *rest), "file", "start_ms"), path, False, frozenset())
    nth = F.row_number().over(Window.orderBy("file"))  # one row per source
    odd = docs.select("file").distinct().withColumn("nth", nth).where("nth % 2 = 1").select("file")
    labelled = tables.table(spark, d, "labels").select("doc_id", F.lit(" revised").alias("more"))
    revised = docs.join(odd, "file", "left_semi").join(labelled, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("more", F.lit("")))).where(F.length("text") >= 200)
    items = tables.table(spark, d, "benchmark").select(F.lit("benchmark").alias("file"), F.lit("en").alias("speaker"), F.col("item_id").cast("int").alias("start_ms"), "text")
    changed = revised.select("file", "speaker", "start_ms", "text").unionByName(items)
    store.upsert(changed.select("file", "speaker", "start_ms", *rest), path, odd.unionByName(items.select("file").distinct()), False, frozenset())
    chunks, i = store.opened(spark, path)
    return chunks.join(i.lengths, "id").select("id", "file", long("start_ms"), long("n_words"), long("n_terms"), F.md5("text").alias("md5"))


def fused(spark, d, k: int = 10, only: DataFrame | None = None) -> DataFrame:
    return fuse.rrf_fuse(keyword_arm(spark, d), vector_arm(spark, d, fuse.POOL, only), k)


@query
def rrf_fuse(spark, d):
    return fused(spark, d).select("qid", "id", F.round("score", 9).alias("score"), long("kw_rank"), long("vec_rank"), long("rank"))


@query
def hybrid_search(spark, d):
    docs = tables.documents(spark, d)
    found = fused(spark, d, 5).join(docs, "id")
    return found.select("qid", long("rank"), "id", "source", text.snippet(F.col("text")).alias("snippet"), F.round("score", 9).alias("score"), text.rank_or_dash(F.col("kw_rank")).alias("kw_rank"), text.rank_or_dash(F.col("vec_rank")).alias("vec_rank"))


def query_texts(spark, d) -> list[tuple[int, str]]:
    """Search texts of the benchmark items that have terms: by number both words, either, the first without the second, or a phrase."""
    words: dict[int, list[str]] = {}
    for r in tables.benchmark_terms(spark, d).orderBy("qid", "i").collect():
        words.setdefault(r.qid, []).append(r.term)
    first = lexical.lexemes(F.col("text"))
    phrases = {r.item_id: r.two for r in tables.table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(first, F.lit(1), F.lit(2)), " ").alias("two")).collect()}
    forms = (" ".join, " or ".join, " -".join)
    return [(q, forms[q % 4](w) if q % 4 < 3 else f'"{phrases[q]}"') for q, w in sorted(words.items())]


@query
def search_forms(spark, d):
    """All matches of parsed search texts, through the searcher."""
    s = Searcher(tables.documents(spark, d), index(spark, d), stemmed=False, stops=frozenset())
    return s.ranks(query_texts(spark, d), 1 << 30, "keyword").select("qid", "id")


@query
def search_moments(spark, d):
    """Hybrid search of both words and a stored vector, through the searcher, with the columns of moments."""
    v = tables.vectors(spark, d).select("id", "embedding")
    docs = tables.table(spark, d, "documents").withColumnRenamed("doc_id", "id").join(v, "id", "left")
    chunks = docs.select("id", F.col("source").alias("file"), F.col("lang").alias("speaker"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), "text", "embedding")
    asked = [(q, " ".join(t.replace('"', "").split(" or ")).replace(" -", " ")) for q, t in query_texts(spark, d) if q % 4 < 3]
    known = {r.id // 20: r.embedding for r in v.where(F.col("id").isin([20 * q for q, _ in asked])).collect()}
    asked = [(q, t) for q, t in asked if q in known]
    s = Searcher(chunks, index(spark, d), lambda _: [known[q] for q, _ in asked], False, frozenset())
    x = s.search(asked, 5)
    return x.select("qid", long("rank"), "id", "file", "speaker", "start_ms", "end_ms", text.snippet(F.col("text")).alias("snippet"), F.round("score", 9).alias("score"), long("kw_rank"), long("vec_rank"))


@query
def format_moment(spark, d):
    e = tables.timed_events(spark, d)
    return e.select("file", "pos", text.clock(F.col("start") % 10_000_000).alias("at"), text.rank_or_dash(F.when(F.col("pos") % 3 > 0, F.col("pos"))).alias("rank"), text.snippet(F.col("event_type"), 3).alias("snippet"))


# --- evaluate: the arms over documents, whose moments and labels are made of their ids ---


def moments(spark, d) -> DataFrame:
    """Results of the labelled queries in all modes; a document is a moment of file ``id mod 7`` and ten seconds from second ``id mod 50``.

    Each arm runs once and is stored: all modes read it, and the evaluation reads them more than once.
    """
    keyword = stored(keyword_arm(spark, d).select("qid", "id", "rank"), "keyword")  # the best ten are the first of these
    vectors = stored(vector_arm(spark, d, fuse.POOL, labelled(spark, d)[0]).select("qid", "id", "rank"), "vector")
    arms = {"keyword": keyword.where("rank <= 10"), "vector": vectors.where("rank <= 10"), "hybrid": fuse.rrf_fuse(keyword, vectors, 10)}
    rows = [a.select("qid", F.lit(mode).alias("mode"), "rank", "id") for mode, a in arms.items()]
    start = F.col("id") % 50 * 1000
    return rows[0].union(rows[1]).union(rows[2]).select("qid", "mode", "rank", (F.col("id") % 7).alias("file"), start.alias("start_ms"), (start + 10_000).alias("end_ms"))


def labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    """Queries of three types, and spans of three seconds in files of their number."""
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    kind = F.get(F.array(*map(F.lit, evaluate.TYPES)), (F.col("qid") % 3).cast("int"))
    start = (F.col("qid") * 7 + F.col("span_id") * 11) % 55
    spans = b.withColumn("span_id", F.explode(F.sequence(F.lit(0), F.col("qid") % 4))).select("qid", "span_id", ((F.col("qid") + F.col("span_id")) % 7).alias("file"), start.alias("start"), (start + 3).alias("end"))
    return b.withColumn("type", kind), spans


def scored(spark, d) -> DataFrame:
    asked, spans = labelled(spark, d)
    return evaluate.score_rows(asked, moments(spark, d), spans)


@query
def span_hits(spark, d):
    return evaluate.span_hits(moments(spark, d), labelled(spark, d)[1]).select("qid", "mode", long("rank"), "span_id")


@query
def span_recall(spark, d):
    return scored(spark, d).select("qid", "mode", F.round("recall", 6).alias("recall"))


@query
def mrr(spark, d):
    return scored(spark, d).select("qid", "mode", F.round("rr", 6).alias("rr"), long("first_rank"))


@query
def eval_rows(spark, d):
    return scored(spark, d).select("qid", "type", "mode", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), long("first_rank"), "n_results")


@query
def summarize(spark, d):
    return evaluate.summarize(scored(spark, d)).select("type", "mode", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query
def rerank_rows(spark, d):
    """Recall and reciprocal rank of each query with the pool reranked by weights learned from other queries."""
    asked, spans = labelled(spark, d)
    pool = stored(fused(spark, d, fuse.POOL, asked), "pool")  # each fold trains on it and reranks it
    start = F.col("id") % 50 * 1000
    placed = lambda df: df.select("qid", "id", F.lit("hybrid").alias("mode"), "rank", (F.col("id") % 7).alias("file"), start.alias("start_ms"), (start + 10_000).alias("end_ms"))
    found = rerank.cross_validated(pool, evaluate.span_hits(placed(pool), spans), 10)
    rows = evaluate.score_rows(asked, placed(found), spans).where("mode = 'hybrid'")
    return rows.select("qid", "type", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), long("first_rank"), "n_results")


@query
def zero_result_rate(spark, d):
    return evaluate.zero_result_rate(scored(spark, d))


@query
def criteria(spark, d):
    return evaluate.criteria(evaluate.summarize(scored(spark, d))).select("name", F.round("target", 6).alias("target"), F.round("actual", 6).alias("actual"), "ok")


@query
def failure_status(spark, d):
    return evaluate.failure_status(scored(spark, d)).select("qid", "status")


@query
def per_query_pivot(spark, d):
    x = evaluate.per_query(scored(spark, d))
    return x.select("qid", "type", *(F.round(f"{m}_recall", 6).alias(f"{m}_recall") for m in evaluate.MODES), *(long(f"{m}_rank") for m in evaluate.MODES))
