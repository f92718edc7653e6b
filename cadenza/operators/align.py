"""Words to speakers to turns.

Words are rows ``file, word_pos, word, start, end``, spans ``file, span_pos,
speaker, start, end``; times are numbers of one unit. Positions order the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, glues, non_space_chars

MIN_SPAN, MAX_GAP, LOW_TURNS = 0.25, 2.0, 15
#: Width of the time bins that words and spans meet in; a few spans long.
BIN = 30.0


def filter_spans(spans: DataFrame, least: float = MIN_SPAN) -> DataFrame:
    """Spans of at least the given length."""
    return spans.where(F.col("end") - F.col("start") >= least)


def exclusive_spans(spans: DataFrame, bin_size: float = 40 * BIN) -> DataFrame:
    """Spans that do not overlap: at any time the span that began first, of several the first in the list, keeps the floor.

    A span loses all that spans before it cover, which is what is up to their largest end; one that is
    covered whole is dropped. That end is a running maximum within a time range of a file, over what the
    ranges before it carry, one row each; so a file of any length is dealt to many tasks.
    """
    at = spans.withColumn("_bin", F.floor(F.col("start") / bin_size))
    order = Window.partitionBy("file", "_bin").orderBy("start", "span_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("file").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = at.groupBy("file", "_bin").agg(F.max("end").alias("_last")).select("file", "_bin", F.max("_last").over(ranges).alias("_carried"))
    covered = F.greatest(F.max("end").over(order), F.col("_carried"))
    out = at.join(carried, ["file", "_bin"]).withColumn("start", F.greatest("start", covered)).where("start < end")
    return out.select(spans.columns)


def join_split_tokens(words: DataFrame, prefixes: tuple[str, ...] | None = None) -> DataFrame:
    """Glue pieces that begin with a prefix to the word before, in chains; a leading piece stays a word.

    The result keeps the first piece's ``word_pos`` and start, and the largest end.
    """
    own = glues(F.col("word"), prefixes) if prefixes else glues(F.col("word"))
    order = Window.partitionBy("file").orderBy("word_pos")
    first = F.row_number().over(order) == 1
    group = F.sum(F.when(~own | first, 1).otherwise(0)).over(order)
    return (
        words.withColumn("_first", first)
        .withColumn("_group", group)
        .groupBy("file", "_group")
        .agg(
            F.min("word_pos").alias("word_pos"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "word"))), lambda x: x["word"]), "").alias("word"),
            F.min_by("start", "word_pos").alias("start"),
            F.max("end").alias("end"),
        )
        .drop("_group")
    )


def overlap(w_start: Column, w_end: Column, s_start: Column, s_end: Column) -> Column:
    """Shared time; negative if apart."""
    return F.least(w_end, s_end) - F.greatest(w_start, s_start)


def distance(w_start: Column, w_end: Column, s_start: Column, s_end: Column) -> Column:
    """Gap between a word and a span, 0 if they touch."""
    return F.greatest(s_start - w_end, w_start - s_end, F.lit(0))


def assign_speakers(words: DataFrame, spans: DataFrame, least: float = MIN_SPAN, bin_size: float = BIN, missing: str = "error") -> DataFrame:
    """``words`` with ``speaker`` and ``low``.

    The span of largest positive overlap wins, the first of equals. A word
    without length takes the first span that holds it. Any other takes the nearest
    span, the first of equals, and is ``low``. A file without spans is an error, or
    its words are dropped (``missing="skip"``).

    Overlaps are found by an equi-join on time bins, so a word meets only spans of
    its own bins; the nearest spans are the last that ended before and the first that
    starts after, found by one ordered pass per file.
    """
    kept = filter_spans(spans, least).select("file", "span_pos", "speaker", F.col("start").alias("s"), F.col("end").alias("e"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size)))
    w = words.withColumn("_b", bins(F.col("start"), F.greatest("start", "end")))
    s = kept.withColumn("_b", bins(F.col("s"), F.col("e")))
    near = w.select("file", "word_pos", "start", "end", "_b").join(s, ["file", "_b"])
    shared = overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e"))
    point = (F.col("end") <= F.col("start")) & F.col("start").between(F.col("s"), F.col("e"))
    hits = (
        near.withColumn("_o", shared)
        .where((F.col("_o") > 0) | point)
        .groupBy("file", "word_pos")
        .agg(
            F.max_by("speaker", F.when(F.col("_o") > 0, F.struct(F.col("_o"), -F.col("span_pos")))).alias("_over"),
            F.min_by("speaker", F.when(point, F.col("span_pos"))).alias("_in"),
        )
    )
    nothing = lambda c: F.lit(None).cast(c)
    span = F.struct("span_pos", "speaker")
    ends = kept.select("file", F.col("e").alias("t"), F.lit(0).alias("k"), nothing("long").alias("word_pos"), F.struct(F.col("e").alias("t"), (-F.col("span_pos")).alias("p"), "speaker").alias("x"))
    asks = words.select("file", F.col("start").alias("t"), F.lit(1).alias("k"), F.col("word_pos").cast("long"), nothing(ends.schema["x"].dataType).alias("x"))
    upto = Window.partitionBy("file").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ends.unionByName(asks).withColumn("before", F.max("x").over(upto)).where("k = 1").select("file", "word_pos", "before")
    starts = kept.select("file", (-F.col("s")).alias("t"), F.lit(0).alias("k"), nothing("long").alias("word_pos"), F.struct(F.col("s").alias("t"), F.col("span_pos").alias("p"), "speaker").alias("x"))
    asks = words.select("file", (-F.col("end")).alias("t"), F.lit(1).alias("k"), F.col("word_pos").cast("long"), nothing(starts.schema["x"].dataType).alias("x"))
    after = starts.unionByName(asks).withColumn("after", F.min("x").over(upto)).where("k = 1").select("file", "word_pos", "after")
    out = words.join(hits, ["file", "word_pos"], "left").join(before, ["file", "word_pos"], "left").join(after, ["file", "word_pos"], "left")
    gap = lambda side, d: F.when(F.col(side).isNotNull(), F.struct(d.alias("d"), F.abs(F.col(f"{side}.p")).alias("p"), F.col(f"{side}.speaker").alias("speaker")))
    apart = lambda side: distance(F.col("start"), F.col("end"), F.col(f"{side}.t"), F.col(f"{side}.t"))
    nearest = F.least(gap("before", apart("before")), gap("after", apart("after")))["speaker"]
    out = out.withColumn("speaker", F.coalesce("_over", "_in", nearest)).withColumn("low", F.col("_over").isNull() & F.col("_in").isNull())
    if missing == "skip":
        out = out.where("speaker is not null")
    else:
        out = out.withColumn("speaker", F.coalesce("speaker", F.raise_error(F.concat(F.lit("no speaker spans left in "), F.col("file").cast("string")))))
    return out.select(*words.columns, "speaker", "low")


def group_turns(words: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Runs of words of one speaker whose gaps are at most ``max_gap``.

    ``file, turn_pos, speaker, start, end, text, n_words, n_low, words``. A gap is
    measured from the largest end so far; ``n_words`` counts tokens, ``n_low`` words.
    """
    order = Window.partitionBy("file").orderBy("word_pos")
    run = F.sum(F.when(F.col("speaker") != F.lag("speaker").over(order), 1).otherwise(0)).over(order)
    inside = Window.partitionBy("file", "_run").orderBy("word_pos").rowsBetween(Window.unboundedPreceding, -1)
    split = F.when((F.col("start") - F.max("end").over(inside) > max_gap) | (F.row_number().over(Window.partitionBy("file", "_run").orderBy("word_pos")) == 1), 1).otherwise(0)
    marked = words.withColumn("_run", run).withColumn("_new", split)
    turn = marked.withColumn("turn_pos", (F.sum("_new").over(order) - 1).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct("word_pos", "word", "start", "end")))
    return (
        turn.groupBy("file", "turn_pos")
        .agg(
            F.first("speaker").alias("speaker"),
            F.min_by("start", "word_pos").alias("start"),
            F.max("end").alias("end"),
            listed.alias("words"),
            F.sum(count_tokens(F.col("word"))).cast("int").alias("n_words"),
            F.count_if("low").cast("int").alias("n_low"),
        )
        .withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
        .withColumn("words", F.transform("words", lambda w: F.struct(w["word"], w["start"], w["end"])))
        .select("file", "turn_pos", "speaker", "start", "end", "text", "n_words", "n_low", "words")
    )


def align(words: DataFrame, spans: DataFrame, least: float = MIN_SPAN, max_gap: float = MAX_GAP, bin_size: float = BIN, missing: str = "error") -> DataFrame:
    """Join split tokens, assign speakers and group into turns."""
    return group_turns(assign_speakers(join_split_tokens(words), spans, least, bin_size, missing), max_gap)


def invariants(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Per file: tokens and characters in and out; aligning loses none."""
    a = words.groupBy("file").agg(F.sum(F.length(non_space_chars(F.col("word")))).alias("chars_in"))
    b = turns.groupBy("file").agg(F.sum(F.length(non_space_chars(F.col("text")))).alias("chars_out"), F.sum("n_words").alias("tokens_out"))
    t = join_split_tokens(words).groupBy("file").agg(F.sum(count_tokens(F.col("word"))).alias("tokens_in"))
    out = a.join(b, "file", "left").join(t, "file")
    return out.withColumn("ok", F.coalesce((F.col("chars_in") == F.col("chars_out")) & (F.col("tokens_in") == F.col("tokens_out")), F.lit(False)))


def speaker_totals(spans: DataFrame) -> DataFrame:
    """Talking time by speaker and its share of the file in percent, 0 of nothing."""
    by = spans.groupBy("file", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    whole = F.sum("total").over(Window.partitionBy("file"))
    return by.withColumn("share", F.when(whole != 0, 100.0 * F.col("total") / whole).otherwise(0.0))


def report(turns: DataFrame, spans: DataFrame, least: float = MIN_SPAN) -> DataFrame:
    """Per file: turns, words, low words and their percentage, spans and dropped spans."""
    a = turns.groupBy("file").agg(F.count("*").alias("n_turns"), F.sum("n_words").alias("n_words"), F.sum("n_low").alias("n_low"))
    b = spans.groupBy("file").agg(F.count("*").alias("n_spans"), F.count_if(F.col("end") - F.col("start") < least).alias("n_dropped"))
    return a.join(b, "file", "left").withColumn("low_pct", F.when(F.col("n_words") > 0, 100.0 * F.col("n_low") / F.col("n_words")).otherwise(0.0))


def low_turns(turns: DataFrame, most: int = LOW_TURNS) -> DataFrame:
    """The first turns of each file that have low words."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("turn_pos"))
    return turns.where("n_low > 0").withColumn("rank", rank).where(F.col("rank") <= most)
