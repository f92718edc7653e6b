import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from cadenza.llm import mixing, queries

from . import test_near_copies, test_quality
from .test_tokens import whole

SF = "/root/testdata/sf0.001"


def by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def strip_repeats(rows):
    """Text that is left when strings of 100 bytes that start earlier are cut at whole characters."""
    first, texts = {}, {d: t.encode() for d, t in rows}
    for d in sorted(texts):
        for p in range(len(texts[d]) - 99):
            first.setdefault(texts[d][p : p + 100], (d, p))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (d, p):
                gone[p : p + 100] = b"\1" * 100
        s, at = "", 0
        for ch in t.decode():
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                s += ch
            at += n
        out[d] = s
    return out


def by_sql(docs):
    """How often the mixing SQL gives out each document."""
    import duckdb
    import pyarrow as pa

    duck = duckdb.connect()
    duck.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    found = duck.sql(mixing.ORACLE)
    at = [d[0] for d in found.description].index("doc_id")
    return Counter(r[at] for r in found.fetchall())


def test_stages_equal_brute_force(spark):
    source, ruled, single, cut, mixed, packed = by_stage(spark)
    rows = {r.doc_id: r for r in source.collect()}
    good = {r.doc_id: r.text for r in ruled.collect()}
    base = {d for d, r in rows.items() if not test_quality.brute(r.text)[5]}
    assert set(good) <= base and all(good[d] == rows[d].text for d in good)
    scored = {r.doc_id for r in queries.op9_quality(spark, SF).collect() if r.kept}
    assert set(good) == scored
    ids = sorted(good)
    first = {}
    for d, x in zip(ids, test_near_copies.brute([good[d] for d in ids])):
        first.setdefault(x, d)
    first = set(first.values())
    assert {r.doc_id for r in single.collect()} == first and len(first) < len(good)
    want = strip_repeats([(d, good[d]) for d in first])
    left = {r.doc_id: r for r in cut.collect()}
    assert {d: r.text for d, r in left.items()} == want
    assert all(r.n_chars == len(r.text) and r.source == rows[d].source for d, r in left.items())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == by_sql(cut) and max(copies.values()) <= 3
    assert [s.columns == source.columns for s in (ruled, single, cut, mixed)] == [True] * 4
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append((r.start, r.ids))
        assert r.offset + r.length <= 4096 and len(r.ids) == r.length
    for d, n in copies.items():
        tokens = list(whole(want[d]))
        assert sum(len(x) for _, x in pieces[d]) == n * len(tokens)
        assert all(x == tokens[at : at + len(x)] for at, x in pieces[d]), "the ids are those of the mixing stage's texts"
    assert set(pieces) == set(copies)


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_every_query_is_registered(name):
    assert sum(q.startswith(name) for q in queries.queries()) == 1
    assert not any(re.search(r"limit|%|mod", s[:60], re.I) for s in queries.oracle_sql())


PROSE = "the quick brown fox jumps over lazy dog and then runs far away from here before it rests a while".split()


def test_run_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null ids, texts and sources, empty and long texts, repeated rows, equal ids of different texts, names of working columns."""
    prose = [" ".join(f"{w}{chr(97 + k)}{i}" for i in range(4) for w in PROSE) for k in range(12)]
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(prose[:6])]
    rows += [(0, prose[0], "en", "web", 0)] * 3 + [(1, prose[6], "fr", None, 0), (None, prose[7], None, "web", None), (None, None, None, None, None), (None, prose[8], "en", "b", 1), (9, "", "en", "b", 0), (10, " \n", "en", "b", 0), (11, None, "en", "b", 0)]
    rows += [(12, "word " * 50_000, "en", "b", 0), (13, " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)), "en", "b", 0)]
    names = "block string, epoch int, n_tokens int, start int, length string, fp long, node long, root long, d long, t string, spans int, kept boolean"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + names
    extra = ("x", 1, 2, 3, "y", 4, 5, 6, 7, "z", 8, True)
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    out = packed.collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "test-edges")
        assert docs.schema.names == df.columns
        seen.append(docs.collect())
        assert all(tuple(r)[5:] == extra for r in seen[-1])
    single = [r.text for r in seen[2]]
    assert {r.doc_id for r in seen[2]} == {0, 1, 2, 3, 4, 5, None, 13} and single.count(prose[0]) == 1 and prose[6] in single
    assert all(t and t.strip() for t in single)
    texts = [r.text for r in seen[3]]
    assert set(texts) <= set(single)
    assert sum(r.length for r in out) == sum(len(whole(t)) for t in texts)
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
