import random

import numpy as np
import pytest
from cadenza.operators import evaluate, fuse, rerank
from pyspark.sql import functions as F

ARM = "qid long, id long, rank int"


@pytest.fixture(scope="module")
def arms(spark):
    """The keyword arm is right at rank one, the vector arm is noise, so fusion alone is a poor order."""
    rng = random.Random(2)
    keyword, vector, right = [], [], []
    for q in range(80):
        ids = rng.sample(range(1000), 40)
        good = ids[0]
        right.append((q, good))
        keyword += [(q, x, r) for r, x in enumerate([good, *ids[1:10]], 1)]
        noise = ids[10:40] + ids[1:4]
        rng.shuffle(noise)
        vector += [(q, x, r) for r, x in enumerate([*ids[1:3], *[x for x in noise if x not in ids[1:3]]][:30], 1)]
    return spark.createDataFrame(keyword, ARM), spark.createDataFrame(vector, ARM), spark.createDataFrame(right, "qid long, id long")


def metrics(spark, ranked, right):
    """Recall and reciprocal rank by the scorer of all evaluations; a row is a moment of its id's file."""
    asked = right.select("qid", F.lit("mixed").alias("type"))
    spans = right.select("qid", F.lit(0).alias("span_id"), F.col("id").cast("string").alias("file"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    results = ranked.select("qid", F.lit("hybrid").alias("mode"), "rank", F.col("id").cast("string").alias("file"), F.lit(100).alias("start_ms"), F.lit(900).alias("end_ms"))
    row = evaluate.score_rows(asked, results, spans).where("mode = 'hybrid'").agg(F.avg("recall").alias("recall"), F.avg("rr").alias("rr")).first()
    return row.recall, row.rr


def test_held_out_metrics(spark, arms):
    keyword, vector, right = arms
    pool = fuse.rrf_fuse(keyword, vector, fuse.POOL)
    before = metrics(spark, pool.where("rank <= 10"), right)
    after = metrics(spark, rerank.cross_validated(pool, right, 10), right)
    assert before[1] < 0.6 and after[1] > 0.95 and after[0] >= before[0]


def test_the_pool_is_reordered_only(spark, arms):
    keyword, vector, right = arms
    pool = fuse.rrf_fuse(keyword, vector, fuse.POOL)
    out = rerank.cross_validated(pool, right, fuse.POOL)
    key = lambda df: sorted((r.qid, r.id, r.kw_rank or 0, r.vec_rank or 0) for r in df.collect())
    assert key(out) == key(pool)
    ranks = {}
    for r in out.collect():
        ranks.setdefault(r.qid, []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())


def test_without_labels_the_order_stays(spark, arms):
    keyword, vector, right = arms
    pool = fuse.rrf_fuse(keyword, vector, 10)
    out = rerank.cross_validated(pool, right.limit(0), 10)
    assert sorted((r.qid, r["rank"], r.id) for r in out.collect()) == sorted((r.qid, r["rank"], r.id) for r in pool.collect())
    assert rerank.train(pool.withColumn("relevant", F.lit(True))) == [0.0] * len(rerank.FEATURES)
    assert rerank.cross_validated(pool.limit(0), right, 5).collect() == []


def test_training_takes_a_bounded_sample(spark, arms):
    keyword, vector, right = arms
    pool = fuse.rrf_fuse(keyword, vector, 10).join(right.withColumn("relevant", F.lit(True)), ["qid", "id"], "left").na.fill(False, ["relevant"])
    assert rerank.train(pool, 300) == rerank.train(pool.repartition(5), 300) != rerank.train(pool)


def large_pool(spark):
    """900 queries of 30 rows, 27,000 labelled rows, the first of each relevant and some others too; some rows lack an arm."""
    h = lambda word, n: F.pmod(F.xxhash64("id", F.lit(word)), F.lit(n)).cast("int")
    x = spark.range(900 * 30).select((F.col("id") / 30).cast("long").alias("qid"), "id", F.when(h("arms", 5) > 0, 1 + h("kw", 30)).alias("kw_rank"), F.when(h("arms", 5) < 4, 1 + h("vec", 30)).alias("vec_rank"))
    part = lambda c: F.coalesce(1.0 / (60.0 + F.col(c)), F.lit(0.0))
    x = x.withColumn("score", part("kw_rank") + part("vec_rank")).withColumn("rank", (F.col("id") % 30 + 1).cast("int"))
    return x.withColumn("relevant", (F.col("rank") == 1) | (h("right", 40) < F.when(F.col("kw_rank") < 8, 4).otherwise(1)))


def off(pool, weights):
    """How far weights are from the least mean loss over every pair of the pool, formed one query at a time."""
    rows = pool.select("qid", "relevant", *rerank.features()).toPandas()
    parts = []
    for _, group in rows.groupby("qid"):
        x, y = group[[f"_{n}" for n in rerank.FEATURES]].to_numpy(), group["relevant"].to_numpy(dtype=bool)
        parts.append((x[y][:, None, :] - x[~y][None, :, :]).reshape(-1, x.shape[1]))
    d, w = np.concatenate(parts), np.array(weights)
    return np.abs(rerank.RIDGE * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d)).max()


def test_all_labelled_rows_train(spark):
    """Training once took 20,000 rows by hash; rows beyond them count as well, in whatever partitions they come."""
    pool = large_pool(spark).localCheckpoint()
    weights = rerank.train(pool)
    assert off(pool, weights) < 1e-9 and off(pool, rerank.train(pool, 20_000)) > 1e-6
    assert weights == rerank.train(pool.repartition(5)) == rerank.train(pool.repartition(3, "id"))


def test_folds_learn_from_all_labels_of_the_others(spark, monkeypatch):
    pool = large_pool(spark).localCheckpoint()
    used, apply = [], rerank.apply
    monkeypatch.setattr(rerank, "apply", lambda part, w, k: used.append((part, w)) or apply(part, w, k))
    right = pool.where("relevant").select("qid", "id")
    assert rerank.cross_validated(pool.drop("relevant"), right, 10).count() == 900 * 10
    for part, w in used:
        others = pool.join(part.select("qid").distinct(), "qid", "left_anti")
        assert others.count() > 20_000 and off(others, w) < 1e-9


def test_large_differences_are_summed_without_overflow(spark):
    """A feature far beyond a rank's: sums stay whole numbers of 64 bits."""
    pool = large_pool(spark).where("qid < 50").withColumn("score", F.when(F.col("relevant"), 1e4).otherwise(0.0) + F.col("score")).localCheckpoint()
    weights = rerank.train(pool)
    assert all(np.isfinite(weights)) and off(pool, weights) < 1e-6


def test_labelled_queries_alone_are_searched_and_once(spark, monkeypatch):
    """Vector queries without a label add nothing to an evaluation; each arm runs once for all modes and folds."""
    from cadenza.plans import queries

    d, asked, ran = "/root/testdata/sf0.001", [], []
    search, arm = queries.vector.vector_search, queries.keyword_arm
    monkeypatch.setattr(queries.vector, "vector_search", lambda q, *a: asked.append({r.qid for r in q.select("qid").collect()}) or search(q, *a))
    monkeypatch.setattr(queries, "keyword_arm", lambda *a: ran.append(1) or arm(*a))
    few = queries.tables.table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).orderBy("qid").limit(1)
    labelled = queries.labelled
    monkeypatch.setattr(queries, "labelled", lambda *a: tuple(x.join(few, "qid", "left_semi") for x in labelled(*a)))
    for made in (queries.moments(spark, d), queries.rerank_rows(spark, d)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "arrow" not in plan.lower().replace("parquet", "")
    first = few.first().qid
    assert asked and all(a <= {first} for a in asked) and len(ran) == 2
