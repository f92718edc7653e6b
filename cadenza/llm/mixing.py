"""Temperature mixing of sources, realised as budgeted block permutations; DataFrame expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .quality import words

#: Columns of a copy.
ADDED = ("epoch", "block", "block_key", "doc_key", "n_tokens")


@dataclass(frozen=True)
class Mix:
    """``budget``: tokens to give out, by default as many as there are. The exponent is the
    largest in [0, 1] whose weights have at least ``entropy`` nats if that is given, else the
    smallest at which no source repeats more than ``repeats`` times. Limits that no exponent
    meets, alone or together, are an error."""

    budget: int | None = None
    entropy: float | None = None
    repeats: float | None = 2.0
    block_tokens: int = 1 << 16
    seed: int = 17
    halvings: int = 30


def token_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_source`` (null-safe), ``_key`` and ``n_tokens``, the words of the text."""
    return docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        "n_tokens": F.size(words(F.coalesce("text", F.lit("")))).cast("long"),
    })


def key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def exponent(sources: DataFrame, mix: Mix, total: int, budget: int, tree: int = 5) -> float:
    """Bisect [0, 1]; a job evaluates all the midpoints that the next ``tree`` halvings may need."""
    stats = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def bisect(good: str, keep_low: bool) -> float:
        lo, step = 0.0, 1.0
        for done in range(0, mix.halvings, tree):
            depth = min(tree, mix.halvings - done)
            points = [lo + step * k / (1 << depth) for k in range(1, 1 << depth)]
            x = stats.select("p", F.explode(F.array(*map(F.lit, points))).alias("x")).withColumn("q", F.pow("p", F.col("x")))
            sums = x.groupBy("x").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.ln("q")).alias("s"), F.max(F.col("q") / F.col("p")).alias("r"))
            verdicts = {r.x: r.good for r in sums.select("x", F.expr(good).alias("good")).collect()}
            for _ in range(depth):
                step /= 2
                if verdicts[lo + step] == keep_low:
                    lo += step
        return lo if keep_low else lo + step

    low = 0.0
    if mix.repeats is not None and budget > mix.repeats * total:
        raise ValueError(f"a budget of {budget} tokens out of {total} repeats some source more than {mix.repeats} times under any weights")
    if mix.entropy is not None and mix.entropy > math.log(stats.count()) + 1e-12:
        raise ValueError(f"weights of {stats.count()} sources have less than {mix.entropy} nats")
    if mix.repeats is not None:
        low = bisect(f"r / z * {budget / total!r}D > {float(mix.repeats)!r}D", True)
        low = 1.0 if low >= 1 - 2.0**-mix.halvings else low and low + 2.0**-mix.halvings
    if mix.entropy is None:
        return low
    high = bisect(f"ln(z) - s / z >= {float(mix.entropy)!r}D", True)
    if low > high + 2.0 ** (1 - mix.halvings):
        raise ValueError(f"at {mix.entropy} nats some source repeats more than {mix.repeats} times")
    return high


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of documents, sources, cut blocks and, in these, of the documents taken."""
    own = docs.select("doc_id", "_source", "n_tokens")
    sources = own.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"))
    sources = materialize(sources, "mix-sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if mix.budget is None else mix.budget
    x = exponent(sources, mix, total, budget) if total else 0.0
    live = sources.where("tokens > 0").withColumn("q", F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(x)))
    z = (live.agg(F.sum("q")).first()[0] or 1.0) if total else 1.0
    share = live.select("_source", "tokens", F.round(F.col("q") / F.lit(z) * F.lit(float(budget))).cast("long").alias("want"))
    sizes = takewhile(lambda n: n < 1 << 63, (mix.block_tokens * 16**d for d in count()))
    digits = sum((F.col("tokens") > n).cast("int") for n in sizes)
    share = share.select("_source", "tokens", "want", F.expr("want div tokens").alias("epochs"), F.expr("want % tokens").alias("rest"), digits.alias("digits"))
    share = materialize(share, "mix-shares")
    seed = F.lit(mix.seed)
    placed = own.join(share, "_source").withColumn("block", F.substring(key(seed, F.lit("block"), F.col("doc_id")), F.lit(1), F.col("digits")))
    sums = placed.groupBy("_source", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("block_key", key(seed, F.col("epochs"), F.col("_source"), F.col("block")))
    running = Window.partitionBy("_source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("n").over(running))
    blocks = sums.select("_source", "block", F.when(F.col("end") <= F.col("rest"), F.lit(1)).otherwise(F.lit(0)).alias("whole"), F.greatest(F.lit(0), F.col("rest") - F.col("end") + F.col("n")).alias("left"), "n")
    blocks = materialize(blocks.where("whole = 1 or left > 0"), "mix-blocks")
    cut = placed.join(blocks.where("whole = 0"), ["_source", "block"]).withColumn("doc_key", key(seed, F.col("epochs"), F.col("doc_id")))
    inside = Window.partitionBy("_source", "block").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = cut.withColumn("upto", F.sum("n_tokens").over(inside)).where("upto <= left").select("_source", "doc_id").distinct()
    taken = materialize(taken, "mix-taken")
    discard(sources)
    return placed, share, blocks, taken


def copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with ``epoch, block, block_key, doc_key, n_tokens``: one row per copy that is given out.

    A source's weight is its share of all tokens to the power of an exponent,
    normalised, and its budget that part of ``mix.budget``. A budget is spent in
    epochs: each is a permutation of the source's blocks, and of the documents in
    a block (sort by ``epoch, block_key, doc_key``). The last epoch stops before
    the first document beyond the budget. Sums run over blocks, then inside the
    one block per source that is cut, so no task sees a whole source. Blocks have about
    ``block_tokens`` tokens however large a source is. Texts are counted whole.

    A null source is one of its own. Null and blank texts have no tokens and go
    along with their block; a source without tokens has no weight and gives no
    rows. Rows with equal ids are taken or left together, as are those with null
    ids. An empty table gives no rows. Other columns stay as they are, save
    those named like the added ones, which are replaced.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rows = token_counts(docs.select(names))
    counted = materialize(rows.select("doc_id", "_source", "n_tokens"), "mix-documents")
    _, share, blocks, taken = plan(counted, mix)
    seed = F.lit(mix.seed)
    out = rows.join(share.select("_source", "epochs", "digits"), "_source")
    out = out.withColumn("block", F.substring(key(seed, F.lit("block"), F.col("doc_id")), F.lit(1), F.col("digits")))
    out = out.join(blocks.select("_source", "block", "whole"), ["_source", "block"], "left")
    some = taken.select("_source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.lit(1).alias("_taken"))
    out = out.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(some, ["_source", "_id"], "left")
    last = F.when(F.col("whole") == 1, 1).when(F.col("_taken") == 1, 1).otherwise(0)
    out = out.withColumn("_n", F.col("epochs") + last).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("block_key", key(seed, F.col("epoch"), F.col("_source"), F.col("block"))).withColumn("doc_key", key(seed, F.col("epoch"), F.col("doc_id")))
    return out.select(*names, "epoch", "block", "block_key", "doc_key", "n_tokens")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The copies with the columns of ``docs`` alone, those named like the columns of ``copies`` too."""
    kept = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    out = copies(docs.withColumnsRenamed(kept), mix)
    return out.select([F.col(kept.get(c, c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, '=' || source AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY s),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM src),
p AS (SELECT s, tokens, tokens / total AS p, total FROM src, tot WHERE tokens > 0),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS step
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT max(pow(p, lo + step / 2) / p) / sum(pow(p, lo + step / 2)) FROM p) > 2.0 THEN lo + step / 2 ELSE lo END, step / 2
  FROM bis WHERE i < 30),
x AS (SELECT CASE WHEN lo >= 1 - pow(2, -30) THEN 1.0 WHEN lo = 0 THEN 0.0 ELSE lo + pow(2, -30) END AS x FROM bis WHERE i = 30),
w AS (SELECT s, tokens, CAST(round(pow(p, x) / (SELECT sum(pow(p, x)) FROM p, x) * total) AS BIGINT) AS want FROM p, x),
sh AS (SELECT s, tokens, want // tokens AS epochs, want % tokens AS rest,
       CAST(list_sum([CAST(tokens > 65536 * CAST(pow(16, k) AS BIGINT) AS INT) FOR k IN range(0, 12)]) AS BIGINT) AS digits FROM w),
pl AS (SELECT d.*, epochs, rest, substr(md5('17:block:' || doc_id), 1, digits) AS block FROM d JOIN sh ON d.s = sh.s),
bl AS (SELECT s, block, epochs, rest, sum(n_tokens) AS n FROM pl GROUP BY s, block, epochs, rest),
be AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY md5('17:' || epochs || ':' || s || ':' || block), block) AS e FROM bl),
dk AS (SELECT pl.*, be.e, be.n, sum(n_tokens) OVER (PARTITION BY pl.s, pl.block ORDER BY md5('17:' || pl.epochs || ':' || doc_id)) AS upto
       FROM pl JOIN be ON pl.s = be.s AND pl.block = be.block),
nn AS (SELECT *, epochs + CASE WHEN e <= rest THEN 1 WHEN rest - e + n > 0 AND upto <= rest - e + n THEN 1 ELSE 0 END AS n_copies FROM dk),
ep AS (SELECT *, unnest(range(0, n_copies)) AS epoch FROM nn)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, md5('17:' || epoch || ':' || s || ':' || block) AS block_key,
       md5('17:' || epoch || ':' || doc_id) AS doc_key, n_tokens
FROM ep
"""
