"""Turns to search chunks. Turns are rows ``file, turn_pos, speaker, text, words``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BACKCHANNELS, count_tokens, ends_sentence, is_backchannel, last_words, to_ms

TARGET, MIN_WORDS, CONTEXT_WORDS, MOST_WORDS = 100, 20, 25, 180
#: Pieces of a turn, as a power of two.
PIECE_BITS = 24
#: A word in a fold: its element, tokens, and whether it ends a sentence.
WORD = "struct<word:string,start:double,end:double>"
CHUNK = f"struct<speaker:string,words:array<{WORD}>,context:string,n:int>"


def drop_backchannels(turns: DataFrame, vocabulary: tuple[str, ...] = BACKCHANNELS) -> DataFrame:
    return turns.where(~is_backchannel(F.col("text"), vocabulary))


def with_context(turns: DataFrame, n: int = CONTEXT_WORDS) -> DataFrame:
    """``context``: the last words of the nearest earlier turn of another speaker, or nothing.

    That turn ends the run of turns before this one's run, so it is the text before
    the run's first turn; no self-join is needed.
    """
    order = Window.partitionBy("file").orderBy("turn_pos")
    new = F.coalesce(F.col("speaker") != F.lag("speaker").over(order), F.lit(True))
    marked = turns.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(order))
    marked = marked.withColumn("_before", F.when(F.col("_new"), F.coalesce(F.lag("text").over(order), F.lit(""))))
    run = Window.partitionBy("file", "_run").orderBy("turn_pos")
    return marked.withColumn("context", last_words(F.first("_before").over(run), n)).drop("_new", "_run", "_before")


def sum_tokens(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + count_tokens(w["word"]))


def split_sentences(words: Column) -> Column:
    """Array of sentences; one ends at a sentence-final word, the rest is one more. Each word is copied once."""

    def parts(words: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: (i == F.size(words)) | ends_sentence(F.get(words, i - 1)["word"]))
        return F.when(F.size(words) > 0, one_by_one(words, last)).otherwise(F.array().cast(f"array<array<{WORD}>>"))

    return bound(words, parts)


def one_by_one(values: Column, ends: Column) -> Column:
    """The parts of an array up to each place of ``ends``, which ascend from 1."""
    return bound(ends, lambda e: F.transform(e, lambda end, i: F.slice(values, F.coalesce(F.get(e, i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(e, i - 1), F.lit(0)))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_turn(words: Column, target: int = TARGET) -> Column:
    """Pack whole sentences greedily into pieces of at most ``target`` tokens.

    A longer sentence closes the open piece and is cut every ``target`` words. The pass over the
    sentences keeps where pieces end, and the words are copied once.
    """
    ints = F.array().cast("array<int>")
    fresh = F.struct(ints.alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("n"))
    closed = lambda a: F.when(a["open"] > 0, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"])

    def step(a: Column, s: Column) -> Column:
        """Of the words up to ``at`` the last ``open`` ones, of ``n`` tokens, are in no closed piece."""
        end = a["at"] + s["size"]
        cuts = F.transform(F.sequence(F.lit(1), F.ceil(s["size"] / target).cast("int")), lambda i: F.least(a["at"] + i * target, end))
        return (
            F.when(s["n"] > target, F.struct(F.concat(closed(a), cuts).alias("ends"), end.alias("at"), F.lit(0).alias("open"), F.lit(0).alias("n")))
            .when((a["open"] > 0) & (a["n"] + s["n"] > target), F.struct(closed(a).alias("ends"), end.alias("at"), s["size"].alias("open"), s["n"].alias("n")))
            .otherwise(F.struct(a["ends"].alias("ends"), end.alias("at"), (a["open"] + s["size"]).alias("open"), (a["n"] + s["n"]).alias("n")))
        )

    def packed(words: Column) -> Column:
        sizes = F.transform(split_sentences(words), lambda s: F.struct(F.size(s).alias("size"), sum_tokens(s).alias("n")))
        return one_by_one(words, F.aggregate(sizes, fresh, step, closed))

    return bound(words, packed)


def merge_small(chunks: Column, least: int = MIN_WORDS, most: int = MOST_WORDS, context_words: int = CONTEXT_WORDS, same_speaker: bool = True) -> Column:
    """Merge chunks under ``least`` tokens into the one before, else the one after, of the same speaker.

    Merged chunks stay within ``most`` tokens with their context, and keep the
    earlier one's context. One pass: a small chunk that the last result cannot take
    waits for the next one, and is tested again once merged.
    """
    none = F.array().cast(f"array<{CHUNK}>")
    return bound(chunks, lambda c: F.when(F.size(c) > 0, merge_stretch(c, least, most, context_words, same_speaker)).otherwise(none))


def merge_stretch(chunks: Column, least: int, most: int, context_words: int, same_speaker: bool) -> Column:
    """The pass of ``merge_small``: it keeps the places where results end, the last result's size, and the chunk that waits."""
    last = "struct<n:int,speaker:string>"
    fresh = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(None).cast(last).alias("out"), F.lit(None).cast(last).alias("wait"), F.lit(0).alias("since"))
    fits = lambda a, b: F.coalesce(((a["speaker"] == b["speaker"]) if same_speaker else F.lit(True)) & (a["n"] + b["n"] + context_words <= most), F.lit(False))
    one = lambda n, speaker: F.struct(n.alias("n"), speaker.alias("speaker")).cast(last)
    state = lambda ends, at, out, wait, since: F.struct(ends.alias("ends"), at.alias("at"), out.alias("out"), wait.alias("wait"), since.alias("since"))
    none = F.lit(None).cast(last)
    before = lambda ends, out, place: F.when(out.isNotNull(), F.concat(ends, F.array(place))).otherwise(ends)

    def taken(x: Column) -> Column:
        """The chunk ``e``, which begins at ``since``, joins the last result, becomes one, or waits."""
        a, e = x["a"], x["e"]
        return (
            F.when(e["n"] >= least, state(before(a["ends"], a["out"], a["since"]), a["at"], e, none, a["since"]))
            .when(a["out"].isNotNull() & fits(a["out"], e), state(a["ends"], a["at"], one(a["out"]["n"] + e["n"], a["out"]["speaker"]), none, a["since"]))
            .otherwise(state(a["ends"], a["at"], a["out"], e, a["since"]))
        )

    def step(a: Column, e: Column) -> Column:
        at, new = a["at"] + 1, one(e["n"], e["speaker"])
        joined = F.struct(state(a["ends"], at, a["out"], none, a["since"]).alias("a"), one(a["wait"]["n"] + e["n"], a["wait"]["speaker"]).alias("e"))
        alone = F.struct(state(a["ends"], at, a["out"], none, a["at"]).alias("a"), new.alias("e"))
        after = F.struct(state(before(a["ends"], a["out"], a["since"]), at, a["wait"], none, a["at"]).alias("a"), new.alias("e"))
        return bound(F.when(a["wait"].isNull(), alone).when(fits(a["wait"], e), joined).otherwise(after), taken)

    def finish(a: Column) -> Column:
        return F.when(a["wait"].isNotNull(), F.concat(before(a["ends"], a["out"], a["since"]), F.array(a["at"]))).otherwise(F.concat(a["ends"], F.array(a["at"])))

    def merged(part: Column) -> Column:
        first, n = F.get(part, 0), F.aggregate(part, F.lit(0), lambda a, c: a + c["n"])
        return F.struct(first["speaker"].alias("speaker"), F.flatten(F.transform(part, lambda c: c["words"])).alias("words"), first["context"].alias("context"), n.alias("n"))

    return F.transform(bound(chunks, lambda c: one_by_one(c, F.aggregate(c, fresh, step, finish))), merged)


def merge_rows(rows: DataFrame, file: str, pos: str, chunk: str, least: int = MIN_WORDS, most: int = MOST_WORDS, context_words: int = CONTEXT_WORDS, same_speaker: bool = True, block: int = 1 << 16) -> DataFrame:
    """``merge_small`` over rows, for files that are too long for one row: ``file, chunk_pos, c``.

    A file is cut between two neighbours where nothing that comes before matters for what follows, and
    each stretch is merged in a row of its own: where both are not small, where the two can never be in one result
    (another speaker, or too long together), and before a chunk that is not small if the small one
    before it is sure to have joined the one before that. Where the cuts are, and a result's
    place, follow from blocks of ``block`` places, an integer, and from one row per block: no window holds a file.
    """
    at = rows.select(F.col(file).alias("file"), F.col(pos).cast("long").alias("pos"), F.col(chunk).alias("c"), F.floor(F.col(pos) / block).alias("b"))
    inside, before = Window.partitionBy("file", "b").orderBy("pos"), Window.partitionBy("file").orderBy("b")
    own = F.struct(F.col("c.n").alias("n"), F.col("c.speaker").alias("speaker"))
    edges = at.groupBy("file", "b").agg(F.max_by(own, "pos").alias("last")).select("file", "b", F.lag("last").over(before).alias("above"))
    at = at.join(edges, ["file", "b"]).withColumn("prior", F.coalesce(F.lag(own).over(inside), "above")).withColumn("second", F.lag(own, 2).over(inside))
    n, p, q = F.col("c.n"), F.col("prior"), F.col("second")
    same = lambda a, b: (a == b) if same_speaker else F.lit(True)
    never = (~same(p["speaker"], F.col("c.speaker"))) | (p["n"] + n + context_words > most)
    joined = (n >= least) & (p["n"] < least) & (q["n"] >= least) & same(q["speaker"], p["speaker"]) & (q["n"] + least - 1 + p["n"] + context_words <= most)
    cut = p.isNull() | ((p["n"] >= least) & (n >= least)) | F.coalesce(never, F.lit(False)) | F.coalesce(joined, F.lit(False))
    at = at.withColumn("begins", F.when(cut, F.col("pos"))).drop("above", "prior", "second")
    lasts = at.groupBy("file", "b").agg(F.max("begins").alias("m")).select("file", "b", F.max("m").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    at = at.join(lasts, ["file", "b"]).withColumn("stretch", F.coalesce(F.max("begins").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "carried"))
    lists = at.groupBy("file", "stretch").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("l"))
    done = lists.select("file", "stretch", F.floor(F.col("stretch") / block).alias("b"), merge_stretch(F.transform("l", lambda e: e["c"]), least, most, context_words, same_speaker).alias("out"))
    size = F.size("out").cast("long")
    ahead = done.groupBy("file", "b").agg(F.sum(size).alias("k")).select("file", "b", F.coalesce(F.sum("k").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("file", "b").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    placed = done.join(ahead, ["file", "b"]).withColumn("first", F.col("start") + F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    return placed.select("file", "first", F.posexplode("out").alias("i", "c")).select("file", (F.col("first") + F.col("i")).alias("chunk_pos"), "c")


def to_output(file: Column, chunk: Column) -> list[Column]:
    """Columns of a stored chunk."""
    text = F.array_join(F.transform(chunk["words"], lambda w: w["word"]), " ")
    return [
        file.alias("file"),
        chunk["speaker"].alias("speaker"),
        to_ms(F.get(chunk["words"], 0)["start"]).alias("start_ms"),
        to_ms(F.array_max(F.transform(chunk["words"], lambda w: w["end"]))).alias("end_ms"),
        text.alias("text"),
        chunk["n"].alias("n_words"),
        F.when(chunk["context"] != "", F.concat_ws(" ", chunk["context"], text)).otherwise(text).alias("embed_text"),
    ]


def chunk(turns: DataFrame, target: int = TARGET, least: int = MIN_WORDS, most: int = MOST_WORDS, context_words: int = CONTEXT_WORDS, same_speaker: bool = True, vocabulary: tuple[str, ...] = BACKCHANNELS) -> DataFrame:
    """``file, chunk_pos`` and the columns of a chunk, for all files at once.

    Pieces are packed turn by turn and merged as rows, so no row holds a file.
    """
    kept = with_context(drop_backchannels(turns, vocabulary), context_words)
    pieces = F.transform(split_turn(F.transform("words", lambda w: w.cast(WORD)), target), lambda p: F.struct(F.col("speaker"), p.alias("words"), F.col("context"), sum_tokens(p).alias("n")).cast(CHUNK))
    by_piece = kept.select("file", F.col("turn_pos").cast("long").alias("turn_pos"), F.posexplode(pieces).alias("i", "c"))
    placed = by_piece.select("file", (F.shiftleft("turn_pos", PIECE_BITS) + F.col("i")).alias("pos"), "c")
    rows = merge_rows(placed, "file", "pos", "c", least, most, context_words, same_speaker, block=1 << (PIECE_BITS + 16))
    out = rows.select("chunk_pos", *to_output(F.col("file"), F.col("c")))
    limit = F.when(count_tokens(F.col("embed_text")) > most, F.raise_error(F.lit(f"embed_text of more than {most} words"))).otherwise(F.col("embed_text"))
    return out.withColumn("embed_text", limit)


def size_report(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, least, upper median and most words, chunks under MIN_WORDS, most words to embed."""
    sizes = F.array_sort(F.collect_list("n_words"))
    return chunks.groupBy("file").agg(
        F.count("*").alias("n_chunks"),
        F.min("n_words").alias("min_words"),
        F.get(sizes, F.floor(F.count("*") / 2).cast("int")).alias("median_words"),
        F.max("n_words").alias("max_words"),
        F.count_if(F.col("n_words") < MIN_WORDS).alias("n_small"),
        F.max(count_tokens(F.col("embed_text"))).alias("max_embed_words"),
    )
