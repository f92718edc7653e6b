import pytest
from cadenza.operators import lexical, vector
from cadenza.plans import store
from cadenza.plans.search import Searcher
from pyspark.sql import functions as F

ROW = "file string, speaker string, start_ms int, end_ms int, text string, n_words int"


def rows(spark, said):
    data = [(f, "A", at, at + 900, text, len(text.split())) for f, at, text in said]
    return vector.embed(spark.createDataFrame(data, ROW), "text")


def loaded(spark, path, said):
    store.ingest(store.with_ids(rows(spark, said), "file", "start_ms"), path)


FIRST = [("a.wav", 0, "moon base plans"), ("a.wav", 1000, "space robots on the moon"), ("b.wav", 0, "cooking pasta"), ("b.wav", 1000, "boiling water"), ("c.wav", 0, "old moon talk")]
#: b changes a row, loses one and gets two; c goes; d comes.
UPDATE = [("b.wav", 0, "cooking moon pasta"), ("b.wav", 500, "salt and robots"), ("b.wav", 2000, "the end"), ("d.wav", 0, "new moon robots")]
AFTER = FIRST[:2] + UPDATE


def found(spark, path, number=None):
    chunks, index = store.opened(spark, path, number)
    s = Searcher(chunks, index.blocks)
    asked = [(0, "moon robots"), (1, "moon"), (2, '"moon pasta"'), (3, "boiling"), (4, "talk or salt")]
    return sorted((r.qid, r.file, r.start_ms, r.text) for m in ("keyword", "vector", "hybrid") for r in s.search(asked, 3, m).collect())


@pytest.fixture
def path(spark, tmp_path):
    out = f"file://{tmp_path}/store"
    loaded(spark, out, FIRST)
    return out


def test_an_upsert_writes_only_what_changed(spark, path, tmp_path):
    before = {(r.file, r.start_ms): r.id for r in store.tables(spark, path)[0].collect()}
    files = spark.createDataFrame([("b.wav",), ("c.wav",), ("d.wav",)], "file string")
    told = {(r.file, r.start_ms): (r.id, r.state) for r in store.upsert(rows(spark, UPDATE), path, files).collect()}
    assert {k: s for k, (_, s) in told.items()} == {("b.wav", 0): "changed", ("b.wav", 500): "new", ("b.wav", 1000): "gone", ("b.wav", 2000): "new", ("c.wav", 0): "gone", ("d.wav", 0): "new"}
    assert told["b.wav", 0][0] == before["b.wav", 0]
    chunks, index = store.opened(spark, path)
    live = {(r.file, r.start_ms): r.id for r in chunks.collect()}
    assert set(live) == {(f, at) for f, at, _ in AFTER} and len(set(live.values())) == len(live)
    assert all(live[k] == before[k] for k in live if k in before), "ids are stable"
    assert min(i for k, i in live.items() if k not in before) > max(before.values()), "ids are never used again"
    segment = store.snapshot(spark, path).segments[-1]
    assert spark.read.parquet(f"{path}/{segment}/chunks").count() == 4
    # the index of both segments is that of a full load, but for ids
    loaded(spark, f"file://{tmp_path}/full", AFTER)
    full_chunks, full = store.opened(spark, f"file://{tmp_path}/full")
    assert found(spark, path) == found(spark, f"file://{tmp_path}/full")
    words = lambda c, i: sorted((r.file, r.start_ms, r.term, r.pos) for r in lexical.needed(i.blocks, i.terms.select("term")).join(c, "id").collect())
    assert words(chunks, index) == words(full_chunks, full)
    assert sorted(index.terms.select("term", "n_docs", "n_postings").collect()) == sorted(full.terms.select("term", "n_docs", "n_postings").collect())
    assert index.summary.first() == full.summary.first()
    told = store.upsert(rows(spark, UPDATE), path, files).collect()
    assert told == [], "the same rows again change nothing"


def test_compaction_keeps_rows_and_ids(spark, path):
    store.upsert(rows(spark, UPDATE), path, spark.createDataFrame([("b.wav",), ("c.wav",), ("d.wav",)], "file string"))
    store.upsert(rows(spark, [("a.wav", 0, "moon base plans again")]), path)
    was, live = found(spark, path), sorted(store.tables(spark, path)[0].select("id", "file", "text").collect())
    assert len(store.snapshot(spark, path).segments) == 3
    next_id = store.snapshot(spark, path).next_id
    store.compact(spark, path)
    assert len(store.snapshot(spark, path).segments) == 1 and store.snapshot(spark, path).next_id == next_id
    assert found(spark, path) == was and sorted(store.tables(spark, path)[0].select("id", "file", "text").collect()) == live


def test_readers_keep_their_snapshot(spark, path):
    was = found(spark, path)
    number = store.versions(spark, path)[0]
    store.upsert(rows(spark, [("a.wav", 0, "gone")]), path)
    assert found(spark, path, number) == was != found(spark, path)


def test_of_two_upserts_from_one_state_one_is_published(spark, path, monkeypatch):
    state = store.snapshot(spark, path)
    store.upsert(rows(spark, [("a.wav", 0, "first")]), path)
    was = found(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store, "snapshot", lambda *a, **k: state)  # this load began from the state before
        with pytest.raises(store.StoreChangedError):
            store.upsert(rows(spark, [("a.wav", 0, "second")]), path)
    assert found(spark, path) == was
    # its folder went with it; of a load that died the folder goes when it is old
    spark.range(1).write.parquet(f"{path}/s-dead/chunks")
    assert store.vacuum(spark, path) == 0 and store.vacuum(spark, path, hours=0) == 1
    assert found(spark, path) == was


def test_repeated_rows_and_empty_updates(spark, path):
    twice = [("a.wav", 0, "same"), ("a.wav", 0, "same"), ("a.wav", 0, "other")]
    store.upsert(rows(spark, twice), path)
    live = store.tables(spark, path)[0].where("file = 'a.wav'").collect()
    assert sorted(r.text for r in live) == ["other", "same", "same"] and len({r.id for r in live}) == 3
    store.upsert(rows(spark, twice[1:]), path)
    assert sorted(r.text for r in store.tables(spark, path)[0].where("file = 'a.wav'").collect()) == ["other", "same"]
    store.upsert(rows(spark, FIRST).limit(0), path, spark.createDataFrame([("a.wav",)], "file string"))
    assert store.tables(spark, path)[0].where("file = 'a.wav'").count() == 0
    with pytest.raises(FileNotFoundError):
        store.upsert(rows(spark, FIRST), f"{path}-none")


@pytest.fixture
def catalog(spark):
    name = "catalog_test"
    yield name
    for suffix in store.TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}{suffix}")


def test_a_catalog_table_is_searched_like_a_store(spark, path, catalog):
    store.ingest_table(store.with_ids(rows(spark, AFTER), "file", "start_ms"), catalog, buckets=8)
    store.ingest_table(store.with_ids(rows(spark, FIRST), "file", "start_ms"), catalog, buckets=8)  # takes the place of the first
    chunks, index = store.table_index(spark, catalog)
    asked = [(0, "moon robots"), (1, "moon"), (2, "boiling")]
    hits = lambda c, i: sorted((r.qid, r.file, r.start_ms) for r in Searcher(c, i.blocks).search(asked, 3, "keyword").collect())
    assert hits(chunks, index) == hits(*store.opened(spark, path)) != []
    assert chunks.count() == len(FIRST) and index.summary.first() == store.opened(spark, path)[1].summary.first()
    terms = lexical.parsed(spark, [(0, "moon")])
    plan = lexical.chosen(index.terms, terms)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "Exchange" not in plan
    whole = index.terms._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in whole, "counts by term are bucket by bucket"


def test_a_catalog_table_takes_no_null(spark, catalog):
    store.ingest_table(store.with_ids(rows(spark, FIRST), "file", "start_ms"), catalog, buckets=2)
    broken = store.with_ids(rows(spark, UPDATE), "file", "start_ms").withColumn("speaker", F.when(F.col("start_ms") != 500, F.col("speaker")))
    with pytest.raises(Exception, match="null in speaker"):
        store.ingest_table(broken, catalog, buckets=2)
    assert spark.table(catalog).count() == len(FIRST)
