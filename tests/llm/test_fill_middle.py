import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
from cadenza.llm import fill_middle


def brute(rows):
    """The contract over Python strings."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
        n = len(t)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        made = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        out.append((doc_id, n, form, None if plain else a, None if plain else b - a, hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in fill_middle.digests(df).collect()), key=str)


def test_edge_rows(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀", "́", "<", ">", "P", "S", "M", "\n"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(0, 40)))) for i in range(600)]
    rows += [(700, None), (701, ""), (None, "no id"), (5, "same id"), (5, "same id"), (-3, "x<S>y"), (702, "<" * 9), (703, "😀é" * 300_000)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, form string")
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_rank_and_select_equal_counting():
    rng = np.random.default_rng(0)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        data = rng.choice(np.array([0x41, 0xC3, 0xA9, 0xE6, 0xBC], dtype=np.uint8), size)
        marks = fill_middle.Boundaries(data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.arange(size + 1)
        assert (marks.rank(at) == np.searchsorted(starts, at)).all()
        k = np.arange(len(starts) + 3)
        assert (marks.select(k) == np.concatenate([starts, [size] * 3])).all()


def test_spans_of_a_batch_and_slices(monkeypatch):
    """Small spans give the same cuts as one over the whole batch; sliced arrays count from their offset."""
    texts = pa.array(["é" * (i % 7) + "ab" for i in range(50)]).cast(pa.binary())[3:]
    h1, h2 = np.arange(47) * 7919, np.arange(47) * 104729
    whole = fill_middle.cuts(texts, h1, h2)
    monkeypatch.setattr(fill_middle, "SPAN", 10)
    for a, b in zip(whole, fill_middle.cuts(texts, h1, h2)):
        assert (a == b).all()


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    docs = spark.read.parquet(path)
    want = sorted(c.execute(fill_middle.ORACLE).fetchall(), key=str)
    assert got(docs) == want
    assert want == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_outputs_rebuild_the_texts(spark):
    rows = [(i, "añb😀" * (i % 5) + str(i)) for i in range(200)]
    made = fill_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), seed=7).collect()
    assert {r.doc_id: fill_middle.restored(bytes(r.output), r.form).decode() for r in made} == dict(rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
