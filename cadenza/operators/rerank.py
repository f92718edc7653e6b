"""A second stage over the fused pool: weights of what the arms say of a result, learned from labelled queries pair by pair."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..working import stored

#: Rounds of training, and the pull of weights to zero.
ROUNDS, RIDGE = 25, 1e-2
#: What a row of a fused pool (``kw_rank, vec_rank, score``) says: reciprocal ranks that fall slowly and fast, which arms have it, and how good it is by fusion.
FEATURES = {
    "kw_slow": lambda: 10.0 / (F.lit(10.0) + F.col("kw_rank")),
    "vec_slow": lambda: 10.0 / (F.lit(10.0) + F.col("vec_rank")),
    "kw_fast": lambda: 1.0 / F.col("kw_rank"),
    "vec_fast": lambda: 1.0 / F.col("vec_rank"),
    "both": lambda: (F.col("kw_rank").isNotNull() & F.col("vec_rank").isNotNull()).cast("double"),
    "fused": lambda: 30.0 * F.col("score"),
}


def features() -> list[Column]:
    """The features of a pool's rows; an arm without the row gives 0."""
    return [F.coalesce(f().cast("double"), F.lit(0.0)).alias(f"_{name}") for name, f in FEATURES.items()]


def differences(labelled: DataFrame, fold: Column) -> DataFrame:
    """``fold``, what a relevant row has over another of its query feature by feature, and ``n``, the pairs of that difference.

    Features of ranks take few values, so that the rows are bounded by the depth of the arms and not by the number of queries.
    """
    rows = labelled.select("qid", fold.alias("fold"), F.coalesce("relevant", F.lit(False)).alias("_relevant"), *features())
    good, others = rows.where("_relevant"), rows.where("NOT _relevant").select("qid", *(F.col(f"_{x}").alias(f"_other_{x}") for x in FEATURES))
    less = [(F.col(f"_{x}") - F.col(f"_other_{x}")).alias(f"_{x}") for x in FEATURES]
    return good.join(others, "qid").select("fold", *less).groupBy("fold", *(f"_{x}" for x in FEATURES)).agg(F.count("*").alias("n"))


def fit(pairs: DataFrame, without: list[int]) -> list[list[float]]:
    """For each number of ``without``, weights by all ``differences`` of other folds: logistic loss, by Newton's method.

    A round is one aggregate for all weights. Its terms are summed as whole numbers, which gives the same sums for
    every partitioning. Weights without a pair are 0.
    """
    pairs, d = stored(pairs, "pairs"), [F.col(f"_{x}") for x in FEATURES]
    sizes = pairs.groupBy("fold").agg(F.sum("n").alias("n"), F.array(*(F.max(F.abs(x)) for x in d)).alias("most")).collect()
    counts = {m: sum(r.n for r in sizes if r.fold != m) for m in without}
    weights, going = {m: np.zeros(len(d)) for m in without}, [m for m in without if counts[m]]
    most = np.array([r.most for r in sizes] or [[0.0] * len(d)]).max(axis=0)
    most[most == 0] = 1.0
    upper, p = [(i, j) for i in range(len(d)) for j in range(i, len(d))], F.col("_p")
    units = np.array([*most, *(most[i] * most[j] for i, j in upper)]) * sum(r.n for r in sizes) / 2.0**62  # no sum is beyond 64 bits
    terms = [*(F.col("n") * p * x for x in d), *(F.col("n") * p * (1 - p) * d[i] * d[j] for i, j in upper)]
    whole = F.array(*(F.rint(x / F.lit(float(unit))).cast("long") for x, unit in zip(terms, units)))
    for _ in range(ROUNDS):
        if not going:
            break
        models = F.array(*(F.struct(F.lit(m).alias("m"), F.array(*(F.lit(float(x)) for x in weights[m])).alias("w")) for m in going))
        margin = reduce(lambda a, b: a + b, (F.get("w", F.lit(i)) * x for i, x in enumerate(d)))
        met = pairs.select("*", F.inline(models)).where(F.col("fold") != F.col("m")).withColumn("_p", 1 / (1 + F.exp(F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0)))))
        sums = {m: np.zeros(len(units)) for m in going}
        for r in met.select("m", F.posexplode(whole).alias("at", "x")).groupBy("m", "at").agg(F.sum("x").alias("x")).collect():
            sums[r.m][r["at"]] = r.x * units[r["at"]]
        for m, x in sums.items():
            pull, hessian = RIDGE * counts[m], np.zeros((len(d), len(d)))
            for (i, j), bend in zip(upper, x[len(d) :]):
                hessian[i, j] = hessian[j, i] = bend
            step = np.linalg.solve(hessian + pull * np.eye(len(d)), pull * weights[m] - x[: len(d)])
            weights[m] = weights[m] - step
            if np.abs(step).max() < 1e-9:
                going.remove(m)
    return [weights[m].tolist() for m in without]


def train(labelled: DataFrame, most: int | None = None) -> list[float]:
    """Weights that put relevant rows (``relevant``) of a query over its others, by all pairs of all labelled rows.

    Pairs are formed within a query only. Without a pair of both kinds all weights are 0, which leaves the order by
    fusion. A caller, and none here is one, may ask for ``most`` rows by hash of query and id.
    """
    rows = labelled if most is None else labelled.orderBy(F.xxhash64("qid", "id")).limit(most)
    return fit(differences(rows, F.lit(0)), [-1])[0]


def apply(pool: DataFrame, weights: list[float], k: int | None = None) -> DataFrame:
    """The pool's rows with the weighted sum as ``score``, ranked by it, then as they were, and cut to ``k``."""
    made = reduce(lambda a, b: a + b, (F.lit(float(w)) * f for w, f in zip(weights, features())))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "_was"))
    out = pool.withColumn("_was", F.col("rank")).withColumn("score", made).withColumn("rank", rank).drop("_was")
    return out if k is None else out.where(F.col("rank") <= k)


def cross_validated(pool: DataFrame, relevant: DataFrame, k: int, folds: int = 5) -> DataFrame:
    """The pool reranked so that no query is scored by weights that its own labels had part in.

    ``relevant`` are ``qid, id`` of the relevant rows, all of which are learned from. A query's fold is a hash of its number.
    """
    fold = F.pmod(F.xxhash64("qid", F.lit("fold")), F.lit(folds))
    labelled = pool.join(relevant.select("qid", "id").distinct().withColumn("relevant", F.lit(True)), ["qid", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    weights = fit(differences(labelled, fold), list(range(folds)))
    parts = [apply(pool.where(fold == i), w, k) for i, w in enumerate(weights)]
    return reduce(DataFrame.unionByName, parts)
