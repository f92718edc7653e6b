import duckdb
import pytest
from cadenza.plans import oracles, queries
from cadenza.streaming.turns import live_turns

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


#: Approximate or trained: held against the exact query by tests/test_vector_index.py, and against brute-force cases by tests/test_rerank.py.
WITHOUT_SQL = {"vector_cells_few", "rerank_rows"}


def test_every_query_has_an_oracle():
    assert set(queries.REGISTRY) - WITHOUT_SQL == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - WITHOUT_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    df = queries.REGISTRY[name](spark, SF)
    found = duck.sql(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_limit_groups(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tokens = plan(queries.REGISTRY["token_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in tokens and "Exchange" not in tokens
    assert "WindowGroupLimit" in plan(queries.REGISTRY["vector_topk"](spark, SF))
    assert "CartesianProduct" not in plan(queries.REGISTRY["assign_overlap"](spark, SF))


def test_live_turns(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "file string, speaker string, word string, start timestamp, end timestamp"
    rows = [[("f", "A", "hi", at(0), at(1)), ("f", "A", "there", at(2), at(3))], [("f", "A", "later", at(6), at(7)), ("f", "B", "yes", at(7), at(8))], [("g", "C", "far", at(100), at(101))], [("g", "C", "off", at(200), at(201))]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    words = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live_turns(words).writeStream.format("memory").queryName("live_turns").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.speaker, r.text, r.n_words) for r in spark.table("live_turns").collect()}
    assert {("A", "hi there", 2), ("A", "later", 1), ("B", "yes", 1)} <= got
