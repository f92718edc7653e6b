import json

import pyarrow as pa
import pytest
from cadenza.sources import documents, files
from pyspark.sql import functions as F


def rows(spark, n, parts=7):
    return spark.range(n).repartition(parts).select(F.concat(F.lit("doc "), "id").alias("stem"), F.to_json(F.struct("id")).alias("value"))


def test_documents_are_written_by_tasks(spark, tmp_path):
    out = tmp_path / "out"
    assert documents.stems(spark, str(out)).collect() == []
    assert documents.save(rows(spark, 3000), str(out)) == 3000
    assert documents.save(rows(spark, 0), str(out)) == 0
    assert {p.name: json.loads(p.read_text())["id"] for p in out.iterdir() if not p.name.startswith("_")} == {f"doc {i}.json": i for i in range(3000)}
    assert list(out.glob("_staged*")) == []
    found = documents.stems(spark, str(out))
    assert found.distinct().count() == 3000 and "content" not in found._jdf.queryExecution().optimizedPlan().toString().partition("Relation")[0]
    assert files.pending(rows(spark, 3005), found).count() == 5


def test_a_task_that_fails_leaves_nothing_to_see(spark, tmp_path):
    out = tmp_path / "out"
    broken = rows(spark, 50, 1).withColumn("value", F.when(F.col("stem") == "doc 40", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        documents.save(broken, str(out))
    assert list(out.rglob("*.json")) == [] and list(out.glob("_staged*")) == []


def test_of_two_attempts_of_a_task_one_result_is_left(tmp_path):
    """A task that is run twice, or lost while it writes, leaves each document once and whole."""
    w = documents.Writer(str(tmp_path))
    batch = pa.record_batch([pa.array(["a", "b"]), pa.array(["1", "2"])], names=["stem", "value"])

    def lost():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(lost())
    assert [p for p in tmp_path.iterdir() if p.suffix == ".json"] == []
    messages = [w.write(iter([batch])), w.write(iter([batch]))]
    w.commit(messages)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.json": "1", "b.json": "2"}
