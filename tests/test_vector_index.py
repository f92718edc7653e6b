import numpy as np
import pytest
from cadenza.operators import vector, vector_index
from cadenza.plans import queries
from pyspark.sql import functions as F


def ids(df):
    return {(r.qid, r.id) for r in df.collect()}


def test_recall_of_the_query(spark):
    """Recall at ten against the exact query over all of sf0.1, and every row in one cell."""
    d = "/root/testdata/sf0.1"
    exact = ids(queries.vector_arm(spark, d, 10))
    assert len(exact & ids(queries.REGISTRY["vector_cells_few"](spark, d))) >= 0.9 * len(exact)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Vectors around 40 centers, a third of them around one; null, zero and short ones."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16))
    rows = [(i, (centers[0 if i % 3 == 0 else i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6).cache()
    path = "file://" + str(tmp_path_factory.mktemp("cells"))
    vector_index.write(v, path, cells=32)
    asked = v.where("id % 50 = 0 and id < 3000").select(F.col("id").alias("qid"), F.col("id").alias("own"), F.col("embedding").alias("query"))
    return v, path, asked


def test_few_probes_find_neighbours_in_clusters(clustered):
    v, path, asked = clustered
    exact = ids(vector.vector_search(asked, v, 5))
    few = ids(vector_index.search(asked, path, 5, probes=8))
    assert len(exact & few) >= 0.95 * len(exact)


def test_all_probes_are_exact_and_no_row_is_lost(spark, clustered):
    v, path, asked = clustered
    rows, centroids = vector_index.stored(spark, path)
    assert rows.count() == v.count() == rows.select("id").distinct().count() and centroids.count() <= 32
    exact = vector.vector_search(asked, v, 5).collect()
    assert sorted(vector_index.search(asked, path, 5, probes=32).collect()) == sorted(exact)
    plan = vector_index.search(asked.limit(1), path, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    vector_index.write(none, f"file://{tmp_path}/none", cells=4)
    one = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<float>")
    vector_index.write(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<float>"), f"file://{tmp_path}/one", cells=4)
    found = vector_index.search(one, f"file://{tmp_path}/one", 5).collect()
    assert [(r.id, r.score) for r in found] == [(1, 1.0), (2, None)]
    assert vector_index.search(one.limit(0), f"file://{tmp_path}/one", 5).collect() == []
