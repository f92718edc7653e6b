"""Full-text search over a postings table: boolean match and cover-density rank.

Documents are rows ``id, text``; postings are ``id, term, pos`` with positions from
1 that count stop words too. Many queries run in one job, keyed by ``qid``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem, stem_column
from ..working import stored
from . import block_index

#: A number with an optional fraction, or a run of letters.
LEXEME = r"\d+(?:\.\d+)?|\p{L}+"
#: Weight of a minimal cover without noise.
WEIGHT = 0.1
#: Buckets of a stored index by term, terms that a filter on it names at most, and terms that are a local table at most.
BUCKETS, NAMED, MOST_TERMS = 64, 512, 10_000
#: Rows of a stored table of terms that are broadcast at most.
MOST_SENT = 500_000


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """Spark's English stop words and the letters that an apostrophe leaves behind."""
    from pyspark.ml.feature import StopWordsRemover

    found = {w for x in StopWordsRemover.loadDefaultStopWords("english") for w in re.findall(r"[a-z]+", x)}
    return frozenset(found | {"s", "t"})


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LEXEME})"), 1)


def postings(docs: DataFrame, stemmed: bool = True, stops: frozenset[str] | None = None) -> DataFrame:
    """``id, term, pos`` of every word that is no stop word.

    Stemming runs once per distinct word, not per occurrence: the words join their stems.
    """
    rows = docs.select("id", F.posexplode(lexemes(F.coalesce("text", F.lit("")))).alias("pos", "term")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    stops = stop_words() if stops is None else stops
    if stops:
        rows = rows.where(~F.col("term").isin(*sorted(stops)))
    if not stemmed:
        return rows
    stems = rows.select("term").distinct().withColumn("stem", stem_column("term"))
    return rows.join(stems, "term").select("id", F.col("stem").alias("term"), "pos")


def parse(query: str, stemmed: bool = True, stops: frozenset[str] | None = None) -> list[dict]:
    """Web-style query: words and "quoted phrases" are all needed, ``or`` joins alternatives, ``-`` excludes.

    Returns groups that are all needed; a group is alternatives (or one negated
    alternative), each a list of ``(term, offset)``; stop words vanish but count in offsets.
    """
    stops = stop_words() if stops is None else stops
    groups: list[dict] = []
    join_next = False
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if not quoted and not minus and plain.lower() == "or":
            join_next = bool(groups)
            continue
        found = re.findall(r"\d+(?:\.\d+)?|[^\W\d_]+", (quoted or plain).lower())
        terms = [(stem(w) if stemmed else w, i) for i, w in enumerate(found) if w not in stops]
        if not terms:
            join_next = False
            continue
        if join_next and not minus and not groups[-1]["negated"]:
            groups[-1]["any"].append(terms)
        else:
            groups.append({"negated": bool(minus), "any": [terms]})
        join_next = False
    return groups


PARSED = "qid long, grp int, negated boolean, alt int, size int, term string, off long"


def parsed(spark: SparkSession, queries: list[tuple[int, str]], stemmed: bool = True, stops: frozenset[str] | None = None) -> DataFrame:
    """Query strings as rows: one per term of an alternative of a group."""
    rows = [(qid, g, x["negated"], a, len(terms), t, off) for qid, q in queries for g, x in enumerate(parse(q, stemmed, stops)) for a, terms in enumerate(x["any"]) for t, off in terms]
    return spark.createDataFrame(rows, PARSED)


def pinned(terms: DataFrame) -> DataFrame:
    """``terms`` as a local table if they are few: a stated set of queries, which no later plan needs to make again."""
    if hasattr(terms, "_cadenza_terms"):
        return terms
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        terms._cadenza_terms = None
        return terms
    out = terms.sparkSession.createDataFrame(rows, terms.schema)
    out._cadenza_terms = rows
    return out


def pinned_once(terms: DataFrame, label: str) -> DataFrame:
    """``terms`` as by ``pinned``; they are made once, as more than a local table holds are read from where they were written."""
    out = pinned(stored(terms, label))
    out._cadenza_sent = out._cadenza_terms is None and out.limit(MOST_SENT + 1).count() <= MOST_SENT
    return out


def chosen(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of a table by term whose term is asked for; of a stored one only their buckets and row groups are read.

    Few terms become a filter that reaches the scan, more a filter of buckets and a broadcast of the terms, many a join.
    """
    terms = pinned(terms)
    rows = terms._cadenza_terms
    if rows is None:
        return index.join(hint(terms.select("term").distinct(), terms), "term", "left_semi").drop("bucket")
    found = sorted({r.term for r in rows})
    if not found:
        return index.limit(0).drop("bucket")
    out = index.where(F.col("term").isin(*found)) if len(found) <= NAMED else index.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    if "bucket" in index.columns:
        buckets = {bucket_number(t) for t in found}
        out = out.where(F.col("bucket").isin(*sorted(buckets)))
    return out.drop("bucket")


def needed(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, term, pos`` of the terms that are asked for; ``index`` is rows of these, or blocks of ids."""
    rows = chosen(index, terms)
    return block_index.postings(rows) if "gaps" in index.columns else rows


def holders(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct ``id, term`` of the terms that are asked for; of blocks without reading a position."""
    rows = chosen(index, terms)
    if "slots" in index.columns:
        rows = rows.select("block", "term", F.explode("slots").alias("slot")).withColumn("id", block_index.id_of(F.col("slot")))
    return rows.select("id", "term").distinct()


def occurrences(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often the terms that are asked for occur; of blocks from their skip entries."""
    rows = chosen(index, terms)
    return rows.groupBy("term").agg(F.sum("n_postings").alias("n") if "n_postings" in index.columns else F.count("*").alias("n"))


def bucket_number(term: str) -> int:
    """The bucket of a stored index that holds a term."""
    return zlib.crc32(term.encode()) % BUCKETS


def bucket_of(term: str) -> Column:
    """The same as a column."""
    return (F.crc32(F.col(term).cast("binary")) % BUCKETS).cast("int").alias("bucket")


def boolean_match(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``(qid, id)`` of documents that have an alternative of every needed group and of no negated one.

    A single word is looked for by document, its places do not matter. An alternative
    of several terms is a phrase: its terms stand at their offsets. Its
    rarest term says where it can be, and only there the others are looked for, each
    at one place. A query of negated groups alone matches nothing.
    """
    terms = pinned(terms)
    group = ["qid", "grp", "negated", "alt", "size"]
    found: list[DataFrame] = []
    singles, phrases = (pinned(terms.where(c)) for c in ("size = 1", "size > 1"))
    if some(singles):
        found.append(holders(index, singles).join(hint(singles, terms), "term").select("qid", "id", "grp", "negated"))
    if some(phrases):
        places = numbered(needed(index, phrases), phrases)
        lead, rest = rarest(numbered(phrases, phrases), numbered(occurrences(index, phrases), phrases))
        begins = places.join(hint(lead, terms), "term").select(*group, "id", (F.col("pos") - F.col("off")).alias("base"))
        others = begins.join(hint(rest.select("qid", "grp", "alt", "term", "off"), terms), ["qid", "grp", "alt"]).withColumn("pos", F.col("base") + F.col("off"))
        hits = others.join(places, ["id", "pos", "term"])
        found.append(hits.groupBy(*group, "id", "base").agg(F.count("*").alias("n")).where("n = size - 1").select("qid", "id", "grp", "negated"))
    if not found:
        return index.sparkSession.createDataFrame([], "qid long, id long")
    if terms._cadenza_terms is None:
        need = terms.groupBy("qid").agg(F.countDistinct(F.when(~F.col("negated"), F.col("grp"))).alias("need"))
    else:
        groups = {(r.qid, r.grp) for r in terms._cadenza_terms if not r.negated}
        need = index.sparkSession.createDataFrame(sorted(Counter(q for q, _ in groups).items()), "qid long, need int")
    got = reduce(DataFrame.unionAll, found).groupBy("qid", "id").agg(F.size(F.collect_set(F.when(~F.col("negated"), F.col("grp")))).alias("got"), F.max("negated").alias("bad"))
    return got.join(hint(need, terms), "qid").where("got = need and not bad and need > 0").select("qid", "id")


def some(terms: DataFrame) -> bool:
    """Whether there are terms, or may be."""
    return terms._cadenza_terms is None or bool(terms._cadenza_terms)


def rarest(phrases: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rarest term of each phrase by ``counts`` (``term, n``), and its other terms."""
    keys, spark = ["qid", "grp", "negated", "alt", "size", "term", "off"], phrases.sparkSession
    rows = pinned(phrases)._cadenza_terms
    if rows is None:
        rare = F.row_number().over(Window.partitionBy("qid", "grp", "alt").orderBy(F.coalesce("n", F.lit(0)), "off"))
        ordered = phrases.join(counts, "term", "left").withColumn("r", rare)
        return ordered.where("r = 1").select(keys), ordered.where("r > 1").select(keys)
    n = {r.term: r.n for r in counts.collect()}
    lead: dict[tuple, Row] = {}
    for r in sorted(rows, key=lambda r: (n.get(r.term, 0), r.off)):
        lead.setdefault((r.qid, r.grp, r.alt), r)
    first, schema = list(lead.values()), phrases.select(keys).schema
    chosen = {id(r) for r in first}
    made = ([tuple(r[k] for k in keys) for r in part] for part in (first, [r for r in rows if id(r) not in chosen]))
    return tuple(spark.createDataFrame(x, schema) for x in made)


def numbered(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` of the terms of ``terms`` with numbers in their place, if these are few."""
    known = pinned(terms)._cadenza_terms
    if known is None:
        return rows
    numbers = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(sorted({r["term"] for r in known}))], "term string, _n int")
    return rows.join(F.broadcast(numbers), "term").withColumn("term", F.col("_n")).drop("_n")


def hint(df: DataFrame, terms: DataFrame) -> DataFrame:
    """A table made of query terms, broadcast if these are proven few."""
    return F.broadcast(df) if pinned(terms)._cadenza_terms is not None or getattr(terms, "_cadenza_sent", False) else df


def cover_density(terms: DataFrame, index: DataFrame, matches: DataFrame) -> DataFrame:
    """``(qid, id, score)``: 0.1 / (1 + noise) summed over minimal covers.

    A cover is a shortest stretch with every needed term; its noise is the number of
    positions in it that match no term. For each hit the cover that ends there starts
    at the earliest of the terms' latest positions; of covers with one start the first
    end counts. One pass over a document's hits keeps each term's latest place and the score so far.
    """
    terms = pinned(terms)
    index = needed(index, terms)
    wanted = terms.where("not negated").select("qid", "term").distinct()
    need = wanted.groupBy("qid").agg(F.collect_set("term").alias("all_terms"))
    hits = index.join(hint(wanted, terms), "term").join(matches, ["qid", "id"], "left_semi")
    listed = hits.groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("hits"))
    listed = listed.join(hint(need, terms), "qid")
    place = "struct<pos:bigint,nth:int>"
    fresh = F.struct(
        F.transform("all_terms", lambda _: F.lit(None).cast(place)).alias("last"),
        F.lit(None).cast(place).alias("at"),
        F.lit(None).cast("bigint").alias("start"),
        F.lit(0.0).alias("score"),
    )

    def step(a: Column, h: Column) -> Column:
        """Places are numbered as they come, so that the matches in a cover are a difference of numbers."""
        nth = F.when(a["at"]["pos"] == h["pos"], a["at"]["nth"]).otherwise(F.coalesce(a["at"]["nth"], F.lit(0)) + 1)
        at = F.struct(h["pos"].alias("pos"), nth.alias("nth")).cast(place)
        return F.struct(F.transform("all_terms", lambda t, i: F.when(t == h["term"], at).otherwise(F.get(a["last"], i))).alias("last"), at.alias("at"), a["start"].alias("start"), a["score"].alias("score"))

    def first_end(a: Column) -> Column:
        return F.struct(a.alias("a"), F.when(F.forall(a["last"], lambda p: p.isNotNull()), F.array_min(a["last"])).alias("first"))

    def scored(x: Column) -> Column:
        a, first = x["a"], x["first"]
        new = first.isNotNull() & (a["start"].isNull() | (a["start"] != first["pos"]))
        noise = a["at"]["pos"] - first["pos"] - (a["at"]["nth"] - first["nth"])
        return F.struct(a["last"].alias("last"), a["at"].alias("at"), F.when(new, first["pos"]).otherwise(a["start"]).alias("start"), F.when(new, a["score"] + F.lit(WEIGHT) / (1 + noise)).otherwise(a["score"]).alias("score"))

    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    score = F.aggregate("hits", fresh, lambda a, h: once(once(step(a, h), first_end), scored), lambda a: a["score"])
    return listed.select("qid", "id", score.alias("score"))


def keyword_search(terms: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rank)``: the best ``k`` matches of each query by score, then id.

    Scores count to the ninth digit, so that equal sums tie in whatever order they were added up.
    """
    terms = pinned(terms)
    scored = cover_density(terms, index, boolean_match(terms, index))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
