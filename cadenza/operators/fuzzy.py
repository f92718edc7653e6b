"""Terms within a few edits of the vocabulary, by neighbourhoods of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits that are allowed, and letters of a word whose deletions are listed.
EDITS, PREFIX = 2, 8


def without_one(word: Column) -> Column:
    """The word without each of its letters in turn."""
    at = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def deletions(word: Column, edits: int = EDITS, prefix: int = PREFIX) -> Column:
    """What is left of the first ``prefix`` letters after up to ``edits`` deletions.

    Two words within ``edits`` insertions, deletions and substitutions share one of these: the letters that
    an alignment of the two prefixes matches, of which either prefix lacks ``edits`` at most. So a word of any
    length has a bounded number of them.
    """
    start = F.array(F.substr(word, F.lit(1), F.lit(prefix)))
    found, last = start, start
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def allowed(word: Column, edits: int = EDITS) -> Column:
    """Edits that a word may have: none under three letters, one under six."""
    return F.least(F.lit(edits), F.when(F.length(word) < 3, 0).when(F.length(word) < 6, 1).otherwise(edits))


def matches(terms: DataFrame, vocabulary: DataFrame, edits: int = EDITS, prefix: int = PREFIX) -> DataFrame:
    """``term, match, distance``: the words of ``vocabulary`` (``term`` and other columns, which are kept) within the edits that each distinct term may have.

    Both sides meet on a deletion; what meets is verified by its Levenshtein distance. Empty and null terms match nothing.
    """
    near = lambda df: df.select("*", F.explode(deletions(F.col("match" if "match" in df.columns else "term"), edits, prefix)).alias("_left"))
    asked = near(terms.select("term").distinct().where("term <> ''"))
    words = near(vocabulary.where("term <> ''").withColumnRenamed("term", "match"))
    met = asked.join(words, "_left").drop("_left").distinct().withColumn("distance", F.levenshtein("term", "match", edits))
    return met.where(F.col("distance").between(F.lit(0), allowed(F.col("term"), edits)))


def expanded(terms: DataFrame, vocabulary: DataFrame, edits: int = EDITS, base: float = 0.5) -> DataFrame:
    """``qid, term, weight``: each query's terms and those near them; a term of a query counts with ``base`` to the power of its least distance."""
    found = terms.select("qid", "term").distinct().join(matches(terms, vocabulary.select("term"), edits), "term")
    return found.groupBy("qid", F.col("match").alias("term")).agg(F.pow(F.lit(base), F.min("distance")).alias("weight"))
