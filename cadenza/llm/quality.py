"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Documents of a sample, the seed of their choice, and characters that a timed run goes over.
SAMPLE_ROWS, SEED, SAMPLE_CHARS = 500, 9, 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where and when ``body`` is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def repeat_words(w: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Most texts repeat
    none, which one hash set shows; only the others sort their windows.
    """
    windows = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            at = F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b))

        return let(pairs, twice)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("long")


def window_distinct(w: Column, n: int = 1000) -> Column:
    """Distinct words of each run of ``n`` words, added up: their share does not fall with a text's length."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(n))
    return F.aggregate(starts, F.lit(0), lambda total, i: total + F.size(F.array_distinct(F.slice(w, i, n))))


Rule = Callable[[Column, Column, Column], Column]

#: Rules that reject a document, from its text, words and lines; BASE are those of ``base_failed``.
BASE: dict[str, Rule] = {
    "few_words": lambda t, w, x: F.size(w) < 10,
    "repeated_windows": lambda t, w, x: 100 * repeat_words(w) > 20 * F.size(w),
}
METHOD: dict[str, Rule] = {
    "symbols": lambda t, w, x: 100 * F.regexp_count(t, F.lit("[#*$%&|<>]")) > 20 * F.size(w),
    "capitals": lambda t, w, x: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 50 * F.char_length(F.array_join(w, "")),
    "digits": lambda t, w, x: 100 * F.regexp_count(t, F.lit("[0-9]")) > 50 * F.char_length(F.array_join(w, "")),
    "word_length": lambda t, w, x: ~F.char_length(F.array_join(w, "")).between(2 * F.size(w), 15 * F.size(w)),
    "duplicate_lines": lambda t, w, x: 100 * dup_lines(x) > 50 * F.size(x),
    "few_distinct_words": lambda t, w, x: 100 * window_distinct(w) < 20 * F.size(w),
}


@dataclass(frozen=True)
class Estimate:
    """What a rule does to a sample: rows it rejects, of how many, and seconds it takes for a million characters."""

    name: str
    rejected: int
    rows: int
    seconds: float

    @property
    def rate(self) -> float:
        """Rejections per cost. Costs count by their power of two, so that small differences of two timings do not matter."""
        return (self.rejected + 0.5) / (self.rows + 1) / 2.0 ** round(math.log2(self.seconds))


def draw(docs: DataFrame, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The whole texts of ``rows`` documents at random: those whose keys have the smallest hashes, the same ones each time.

    The keys alone are read to find the hashes; ``rows`` of these come to the driver.
    """
    rank = F.xxhash64(F.col(key), F.lit(SEED))
    least = [r.h for r in docs.select(rank.alias("h")).orderBy("h").limit(rows).collect()]
    return docs.where(rank <= F.lit(max(least, default=0))).select(F.coalesce(F.col(text), F.lit("")).alias("_text")).limit(rows)


def estimate_rules(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS, rounds: int = 3, text: str = "text", key: str = "doc_id") -> list[Estimate]:
    """Rejections and costs of ``rules`` on a random sample of ``sample_rows`` whole texts.

    Every rule runs once before anything is timed. Then ``rounds`` passes time a run
    without a rule and one of each rule, and a rule's cost is the median of its
    differences. A run goes over the sample as often as makes SAMPLE_CHARS characters.
    """
    sample = draw(docs, sample_rows, text, key).withColumn("_words", words(F.col("_text"))).withColumn("_lines", lines(F.col("_text")))
    sample = materialize(sample.coalesce(1), "rule-sample")
    try:
        n, chars = sample.agg(F.count("*"), F.coalesce(F.sum(F.char_length("_text")), F.lit(0))).first()
        times = max(1, min(1000, SAMPLE_CHARS // max(chars, 1)))
        repeated = sample.coalesce(1).withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def timed(rule: Column) -> tuple[int, float]:
            began = time.perf_counter()
            hits = repeated.agg(F.count_if(rule)).first()[0]
            return hits // times, time.perf_counter() - began

        columns = {name: rule(F.col("_text"), F.col("_words"), F.col("_lines")) for name, rule in rules.items()}
        nothing = F.length("_text") < 0
        hits = {name: timed(c)[0] for name, c in columns.items()}
        timed(nothing)
        took: dict[str, list[float]] = {name: [] for name in rules}
        for _ in range(rounds):
            floor = timed(nothing)[1]
            for name, c in columns.items():
                took[name].append(timed(c)[1] - floor)
        least = 1e-3 * max(chars * times, 1) / 1e6
        return [Estimate(name, hits[name], n, max(median(took[name]), least) / max(chars * times, 1) * 1e6) for name in rules]
    finally:
        discard(sample)


def order_rules(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> list[str]:
    """Names of ``rules`` by rejections per cost, the best first; equal ones as they are given. The verdict is the same in any order."""
    found = {e.name: e.rate for e in estimate_rules(docs, rules, sample_rows, text=text, key=key)}
    return sorted(rules, key=lambda k: -found[k])


def verdict(order: list[str], rules: dict[str, Rule], t: Column, w: Column, x: Column, given: dict[str, Column] | None = None) -> Column:
    """True if no rule rejects; later rules are not evaluated once one does. ``given``: known values of rules."""
    given = given or {}
    out = F.when(F.lit(False), False)
    for k in order:
        out = out.when(F.coalesce(given[k] if k in given else rules[k](t, w, x), F.lit(False)), False)
    return out.otherwise(True)


def score(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept``, one row per row of ``docs``.

    A null or blank text has no words and fails. Rows with equal or null ids are
    judged one by one; an empty table gives no rows; columns besides ``doc_id``
    and ``text`` are ignored. Texts are judged whole, one at a time; rules on distinct
    words go by windows, so that a long clean text passes. Nothing is shuffled.
    """
    docs = docs.select("doc_id", "text")
    order = order_rules(docs, METHOD, sample_rows)

    def base(t: Column, w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup_lines(x).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def judged(t: Column, w: Column, x: Column, b: Column) -> Column:
        n = b["n_words"]
        failed = (n < 10) | (100 * b["n_repeat_words"] > 20 * n)
        given = {"symbols": 100 * b["n_symbols"] > 20 * n, "duplicate_lines": 100 * b["n_dup_lines"] > 50 * F.size(x), "word_length": ~b["word_chars"].between(2 * n, 15 * n)}
        return F.struct(b.alias("b"), failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(order, METHOD, t, w, x, given)).alias("kept"))

    # bound values in one expression: a filter on the result that is pushed below it must not split a text per word
    one = let(F.coalesce("text", F.lit("")), lambda t: let(words(t), lambda w: let(lines(t), lambda x: let(base(t, w, x), lambda b: judged(t, w, x, b)))))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("_j"))
    return out.select("doc_id", "_j.b.*", "_j.base_failed", "_j.kept")


def accepted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, base rules included; all columns stay.

    Null and blank texts go. Rows with equal or null ids are judged one by one; an
    empty table stays empty; texts are judged whole.
    """
    rules = BASE | METHOD
    order = order_rules(docs, rules, sample_rows)
    text = F.coalesce("text", F.lit(""))  # one expression: as a filter it goes below any column that it could use
    return docs.where(let(text, lambda t: let(words(t), lambda w: let(lines(t), lambda x: verdict(order, rules, t, w, x)))))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM p),
d AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
c AS (SELECT g.doc_id, g.i, lead(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS nxt
      FROM g JOIN d ON g.doc_id = d.doc_id AND g.gram = d.gram),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM c GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(list_sum([len(list_distinct(ws[k * 1000 + 1:k * 1000 + 1000])) FOR k IN range(0, (len(ws) + 999) // 1000)]), 0) AS BIGINT) AS n_distinct,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_upper > 50 * word_chars OR 100 * n_digits > 50 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_distinct < 20 * n_words) AS kept
FROM f
"""
