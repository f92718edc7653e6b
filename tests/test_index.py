import math
import random
import re
from collections import Counter

import pytest
from cadenza.operators import block_index, fuzzy, lexical
from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "gamma", "delta", "night", "nights", "knight", "river", "rivers", "zebra"]
WEIGHTS = [90, 80, 70, 60, 3, 3, 2, 2, 1, 1]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, weights=WEIGHTS, k=rng.randrange(0, 60)))) for i in range(1500)]
    rows += [(2000, None), (2001, "..."), (2002, "zebra " * 30), (2003, "The Rivers, at night: 3.5")]
    return rows


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    df = spark.createDataFrame(texts, "id long, text string").repartition(5)
    return block_index.write(df, "file://" + str(tmp_path_factory.mktemp("index")), False, frozenset())


def test_blocks_hold_every_posting(spark, texts, index):
    df = spark.createDataFrame(texts, "id long, text string")
    asked = lexical.postings(df, False, frozenset()).select("term").distinct()
    got = sorted(lexical.needed(index.blocks, asked).collect())
    want = sorted((i, w, p) for i, t in texts for p, w in enumerate(re.findall(r"\d+(?:\.\d+)?|[^\W\d_]+", (t or "").lower()), 1))
    assert [(r.id, r.term, r.pos) for r in sorted(got, key=lambda r: (r.id, r.pos))] == sorted(want, key=lambda r: (r[0], r[2]))
    assert {(r.id, r.n_terms) for r in index.lengths.collect()} == {(i, sum(x[0] == i for x in want)) for i, _ in texts}
    blocks = index.blocks.collect()
    assert all(b.n_docs == len(b.slots) == len(set(b.slots)) <= 32 and b.slots == sorted(b.slots) and b.max_tf == max(b.tfs) and b.min_len == min(b.lens) and b.n_postings == sum(b.tfs) == len(b.gaps) for b in blocks)
    counts = Counter(w for _, w, _ in want)
    assert {r.term: r.n_postings for r in index.terms.collect()} == counts


def test_blocks_with_stems_and_stop_words(spark, texts, tmp_path):
    df = spark.createDataFrame(texts, "id long, text string")
    made = block_index.write(df, f"file://{tmp_path}/i").blocks
    whole = lexical.postings(df)
    asked = whole.select("term").distinct()
    assert sorted(lexical.needed(made, asked).select("id", "term", "pos").collect()) == sorted(whole.select("id", "term", "pos").collect())
    assert "the" not in {r.term for r in made.select("term").distinct().collect()} and "river" in {r.term for r in made.select("term").distinct().collect()}


def test_a_block_holds_many_postings(spark, tmp_path):
    """Rows that a query for frequent words reads, against a row per position."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    made = block_index.write(docs, f"file://{tmp_path}/b", False, frozenset())
    frequent = made.terms.orderBy(F.desc("n_postings")).limit(50).select("term")
    rows = lexical.chosen(made.blocks, frequent).agg(F.count("*"), F.sum("n_postings")).first()
    assert rows[1] > 20 * rows[0]


def brute_bm25(texts, asked, k):
    docs = {i: Counter(re.findall(r"\d+(?:\.\d+)?|[^\W\d_]+", (t or "").lower())) for i, t in texts}
    n, average = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = []
    for q, terms in asked.items():
        idf = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t in terms if (df := sum(t in c for c in docs.values()))}
        score = {i: sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for t in idf if t in c) for i, c in docs.items()}
        best = sorted(((-round(s, 9), i) for i, s in score.items() if any(t in docs[i] for t in idf)))[:k]
        out += [(q, i, pytest.approx(-s, abs=1e-8), r) for r, (s, i) in enumerate(best, 1)]
    return out


def test_bm25_equals_brute_force(spark, texts, index):
    asked = {1: ["zebra", "rivers"], 2: ["alpha"], 3: ["3.5", "alpha", "beta", "night"], 4: ["absent"], 5: ["absent", "knight"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts] + [(2, "alpha")], "qid long, term string")
    got = sorted(tuple(r) for r in block_index.bm25(terms, index, 7).collect())
    assert sorted(got, key=lambda r: (r[0], r[3])) == brute_bm25(texts, asked, 7)
    plan = block_index.bm25(terms, index, 7)._jdf.queryExecution().executedPlan().toString()
    assert "gaps" not in plan


def test_blocks_that_cannot_matter_are_not_opened(spark):
    from cadenza.plans import queries
    from cadenza.sources import tables

    d = "/root/testdata/sf0.01"
    index, terms = queries.stored_index(spark, d), tables.benchmark_terms(spark, d)
    asked, summary = block_index.weighted(terms, index), index.summary.first()
    every = block_index.bounds(asked, index, summary.n_terms / summary.n_docs)
    left = block_index.stages(terms, index, 10)[2]
    rows = lambda b: b.join(asked, "qid").join(index.blocks, ["term", "block"]).agg(F.sum("n_docs")).first()[0] or 0
    assert left.count() < 0.5 * every.count() and rows(left) < 0.5 * rows(every)


def test_words_within_edits(spark):
    rng = random.Random(9)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 12))) for _ in range(300)} | {"a" * 40, "a" * 41, "b" + "a" * 40, "x"}
    vocabulary = spark.createDataFrame([(w, 1) for w in words] + [("", 1), (None, 1)], "term string, n int")
    asked = sorted(words)[::7] + ["", "absentword", "a" * 40]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for edits in (1, 2):
        want = {(a, b, d) for a in set(asked) - {""} for b in words if (d := distance(a, b)) <= min(edits, 0 if len(a) < 3 else 1 if len(a) < 6 else 2)}
        got = fuzzy.matches(spark.createDataFrame([(w,) for w in asked] + [(None,)], "term string"), vocabulary, edits).collect()
        assert {(r.term, r.match, r.distance) for r in got} == want and len(got) == len(want)


def test_expansion_weighs_the_nearest_term(spark, index):
    terms = spark.createDataFrame([(1, "nigt"), (1, "night"), (2, "none of them")], "qid long, term string")
    got = {(r.qid, r.term): r.weight for r in fuzzy.expanded(terms, index.terms).collect()}
    assert got == {(1, "night"): 1.0, (1, "nights"): 0.5, (1, "knight"): 0.5}


def test_rank_is_linear_in_a_long_text(spark):
    """A megabyte of one pair of words: tens of thousands of covers, scored in one pass."""
    import time

    n = 100_000
    df = spark.createDataFrame([(1, "alpha beta " * n), (2, "alpha x beta")], "id long, text string")
    asked = lexical.parsed(spark, [(0, "alpha beta")], False, frozenset())
    began = time.perf_counter()
    got = {r.id: r.score for r in lexical.keyword_search(asked, lexical.postings(df, False, frozenset()), 5).collect()}
    assert got[2] == pytest.approx(0.05) and got[1] == pytest.approx(0.1 * (2 * n - 1))
    assert time.perf_counter() - began < 60


def test_no_posting_is_a_row_before_its_block(spark, texts):
    """Texts are shuffled, not postings; documents that share an id keep all places."""
    df = spark.createDataFrame(texts + [(7, "alpha beta alpha"), (7, "beta alpha")], "id long, text string")
    made = block_index.blocks(df, False, frozenset())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    whole = lexical.postings(df, False, frozenset())
    assert sorted(block_index.postings(made).collect()) == sorted(whole.select("id", "term", "pos").collect())
    assert made.groupBy("term", "block").count().where("count > 1").count() == 0


def test_blocks_of_parts_are_whole(spark, texts, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(block_index, "HELD", 100)
    monkeypatch.setattr(block_index, "SLICE", 7)
    monkeypatch.setattr(block_index, "OUT", 50)
    batches = [pa.record_batch([pa.array([i for i, _ in part]), pa.array([None if t is None else re.findall(r"[a-z]+", t.lower()) for _, t in part], pa.list_(pa.string()))], names=["id", "w"]) for part in (texts[:700], texts[700:])]
    rows = [r for b in block_index.gathered(iter(batches)) for r in b.to_pylist()]
    assert len({(r["term"], r["block"]) for r in rows}) == len(rows) and max(r["n_docs"] for r in rows) > 7
    assert sum(r["n_postings"] for r in rows) == sum(len(re.findall(r"[a-z]+", (t or "").lower())) for _, t in texts)


def test_many_terms_are_made_once_and_meet_their_own_blocks(spark, texts, index, monkeypatch):
    """Terms beyond a local table are stored and broadcast: what makes them runs once, and the index is not shuffled for them."""
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    asked = {1: ["zebra", "rivers"], 3: ["3.5", "alpha", "beta", "night"]}
    rows = [(q, t) for q, ts in asked.items() for t in ts]
    terms = spark.createDataFrame(rows, "qid long, term string").mapInArrow(count, "qid long, term string")
    got = sorted(tuple(r) for r in block_index.bm25(terms, index, 7).collect())
    assert sorted(got, key=lambda r: (r[0], r[3])) == brute_bm25(texts, asked, 7)
    assert made.value == len(rows)
    weighted = block_index.weighted(terms, index)
    plan = lexical.chosen(index.blocks, weighted)._jdf.queryExecution().executedPlan().toString()
    assert weighted._cadenza_terms is None and "BroadcastHashJoin" in plan
