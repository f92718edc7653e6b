import random
from pathlib import Path

import pytest
from cadenza.llm import common, graph
from cadenza.llm.graph import components
from pyspark.sql import functions as F


class Session:
    """A session with a given setting and master."""

    def __init__(self, folder, master):
        self.conf, self.sparkContext = self, self
        self.folder, self.master, self.applicationId = folder, master, "test-app"

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_is_the_session_s():
    assert common.shared_root(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(Session(None, master))
    own = common.shared_root(Session(None, "local[4]"))
    assert own == common.shared_root(Session(None, "local[4]")) and Path(own.removeprefix("file://")).is_dir()


def test_tables_are_written_and_discarded(spark):
    table = common.materialize(spark.range(5), "x")
    path = Path(table._cadenza_path.removeprefix("file://"))
    assert table.count() == 5 and table._cadenza_path.startswith(common.shared_root(spark))
    common.discard(table)
    assert not path.exists()


def test_partition_keys_are_one_per_partition(spark):
    keys = common.partition_keys(spark, 7)
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7, "k").select("k", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(7)) and all(keys[r.p] == r.k for r in rows)


@pytest.mark.parametrize("small", [graph.SMALL, 10])
def test_components_equal_union_find(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(3)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(50)] + [(9000 + 7 * (i % 3), 10_000 + i) for i in range(4000)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_at_places(spark):
    """Rows of several writers, read in other splits; places of writers without a chosen row."""
    df = spark.range(1000).repartition(7).withColumns({"place": F.monotonically_increasing_id(), "t": F.concat(F.lit("x"), "id"), "a": F.array("id")})
    rows = common.materialize(df, "test-rows")
    chosen = rows.where("id % 10 = 0 and id < 500").select("place", (F.col("id") * 2).alias("double"))
    got = common.at_places(rows, "place", chosen).collect()
    assert sorted((r.id, r.t, r.a, r.double) for r in got) == [(i, f"x{i}", [i], 2 * i) for i in range(0, 500, 10)]
    assert common.at_places(rows, "place", chosen.select("place").limit(0)).collect() == []
    assert common.at_places(rows, "place", chosen.select("place")).columns == rows.columns
