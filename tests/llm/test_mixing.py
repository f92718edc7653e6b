import math
from collections import Counter, defaultdict

import pytest
from cadenza.llm import mixing
from cadenza.llm.mixing import Mix
from pyspark.sql import Row


def frame(spark, rows):
    return spark.createDataFrame([Row(doc_id=a, source=b, text=c, epoch="x", block_key=1) for a, b, c in rows], "doc_id long, source string, text string, epoch string, block_key int")


def table(spark):
    return frame(spark, [(i, s, "w " * (1 + i % 7)) for s, n in (("a", 400), ("b", 100), ("c", 20), (None, 30)) for i in range(n)])


def spent(rows):
    out = Counter()
    for r in rows:
        out[r.source] += r.n_tokens
    return out


def test_budget_and_repeats(spark):
    docs = table(spark)
    got = mixing.copies(docs, Mix(block_tokens=64, repeats=2.0)).collect()
    size, used = spent(mixing.copies(docs, Mix(repeats=1.0)).collect()), spent(got)
    assert set(used) == {"a", "b", "c", None}
    assert all(used[s] <= 2.0 * size[s] + 1 for s in used)
    assert used["c"] > 1.9 * size["c"] and used["a"] < size["a"]
    assert sum(size.values()) - 8 * len(used) <= sum(used.values()) <= sum(size.values()) + 4
    copies = defaultdict(list)
    for r in got:
        copies[(r.source, r.doc_id)].append(r.epoch)
    assert all(sorted(e) == list(range(len(e))) for e in copies.values())


def test_repetition_limit_of_one_is_the_corpus(spark):
    docs = table(spark)
    got = mixing.copies(docs, Mix(repeats=1.0)).collect()
    assert Counter((r.source, r.doc_id) for r in got) == Counter((r.source, r.doc_id) for r in docs.collect())


@pytest.mark.parametrize("goal", [1.0, 1.2])
def test_entropy_target(spark, goal):
    used = spent(mixing.copies(table(spark), Mix(budget=60_000, entropy=goal, repeats=None, block_tokens=64)).collect())
    n = sum(used.values())
    assert -sum(v / n * math.log(v / n) for v in used.values()) == pytest.approx(goal, abs=0.01)


def test_edges(spark):
    docs = frame(spark, [(1, "a", None), (2, "a", ""), (None, "a", "x y"), (None, "a", "x y"), (3, "a", "z"), (3, "a", "z"), (4, "none", " "), (5, "long", "w " * 50000)])
    got = mixing.copies(docs, Mix(repeats=1.0)).collect()
    assert Counter((r.source, r.doc_id) for r in got) == Counter([("a", 1), ("a", 2), ("a", None), ("a", None), ("a", 3), ("a", 3), ("long", 5)])
    assert mixing.copies(docs.limit(0)).collect() == []
    assert mixing.mixed(docs).columns == docs.columns


def test_blocks_stay_together_and_epochs_differ(spark):
    docs = frame(spark, [(i, "a", "w w w w") for i in range(300)])
    got = mixing.copies(docs, Mix(budget=2400, repeats=None, block_tokens=128)).collect()
    order = [[r.doc_id for r in sorted(got, key=lambda r: (r.block_key, r.doc_key)) if r.epoch == e] for e in (0, 1)]
    assert sorted(order[0]) == sorted(order[1]) == list(range(300)) and order[0] != order[1]
    assert len({r.block for r in got}) == 16


@pytest.mark.parametrize(
    ("mix", "message"),
    [
        (Mix(budget=10_000_000, repeats=2.0), "repeats some source"),
        (Mix(entropy=5.0, repeats=None), "less than 5.0 nats"),
        (Mix(budget=2000, entropy=1.38, repeats=1.2), "nats some source repeats"),
    ],
)
def test_limits_that_cannot_be_met_are_an_error(spark, mix, message):
    with pytest.raises(ValueError, match=message):
        mixing.copies(table(spark), mix)


def test_blocks_of_a_large_source_stay_small(spark):
    """The number of digits follows the tokens of the source."""
    docs = frame(spark, [(i, "a", "w " * 20) for i in range(3000)])
    got = mixing.copies(docs, Mix(repeats=1.0, block_tokens=1)).collect()
    assert {len(r.block) for r in got} == {4} and len({r.block for r in got}) > 2800


def test_query_equals_its_sql(spark):
    import duckdb
    from cadenza.llm import queries

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = duck.sql(mixing.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)
    df = queries.op6_mixing(spark, sf)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == want
