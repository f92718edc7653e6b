import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from cadenza.llm import katz, queries
from pyspark.sql import Row


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Brute:
    """The model over plain dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for d, t in rows if crc32(b"" if d is None else str(d).encode()) % 7 != 2]
        self.c = Counter(w for ws in train for w in ws)
        self.n, self.docs = sum(self.c.values()), len(train)
        pairs = Counter(p for ws in train for p in zip(["<s>", *ws], ws))
        hist = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
        self.d1, self.d2 = katz.good_turing(hist(self.c)), katz.good_turing(hist(pairs), 1)
        saved = sum((1 - self.d(self.d1, v)) * v for v in self.c.values())
        self.unseen = max(saved / self.n, 1 / (self.n + 1)) if self.n else 1.0
        self.mass = self.n - saved
        self.next = defaultdict(dict)
        for (a, b), v in pairs.items():
            if v >= 2:
                self.next[a][b] = v

    def d(self, ds, r):
        return ds[r - 1] if r <= 5 else 1.0

    def p1(self, w):
        return (1 - self.unseen) * self.d(self.d1, self.c[w]) * self.c[w] / self.mass if self.c[w] else self.unseen

    def p(self, a, b):
        h = self.docs if a == "<s>" else self.c[a]
        follow = self.next.get(a, {})
        if not follow or not h:
            return self.p1(b)
        share = sum(self.d(self.d2, v) * v for v in follow.values()) / h
        left = max(1 - share, 1 / (h + 1))
        if b in follow:
            return (1 - left) / share * self.d(self.d2, follow[b]) * follow[b] / h
        return left / (1 - sum(self.p1(w) for w in follow)) * self.p1(b)

    def row(self, d, t):
        ws = tokens(t)
        v = len(self.c)
        base = sum(math.log10((self.c[w] + 1) / (self.n + v + 1)) for w in ws)
        score = sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *ws], ws))
        return d, crc32(b"" if d is None else str(d).encode()) % 7 == 2, len(ws), sum(self.c[w] > 0 for w in ws), self.n, base, score


def compare(df, rows):
    model = Brute(rows)
    got = sorted((tuple(r) for r in katz.score(df).collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    want = sorted((model.row(*r) for r in rows), key=lambda r: (str(r[0]), r[2], r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return model


def test_documents_equal_brute_force_and_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    model = compare(docs, [(r.doc_id, r.text) for r in docs.collect()])
    for a in ["<s>", *list(model.next)[:40], "never seen"]:
        assert sum(model.p(a, w) for w in model.c) + model.p(a, "\0unseen") == pytest.approx(1, abs=1e-9)


def test_edge_rows(spark):
    rows = [(0, None), (1, ""), (2, "A b\x0bc a B"), (2, "A b\x0bc a B"), (None, "a b"), (5, "é a b " * 20000), (16, "unknown words here"), (-3, "a b c")]
    df = spark.createDataFrame([Row(doc_id=d, text=t, words="x", c=1) for d, t in rows], "doc_id long, text string, words string, c int")
    compare(df.repartition(3), rows)
    assert katz.score(df.limit(0)).collect() == []


def test_nothing_learned(spark):
    d = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    r = katz.score(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    rows = katz.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_query_keeps_pairs_seen_once(spark):
    """Against brute force with every pair kept, whose single pairs get their Good-Turing discount."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = Brute(rows)
    pairs = Counter(p for d, t in rows if crc32(str(d).encode()) % 7 != 2 for ws in [tokens(t)] for p in zip(["<s>", *ws], ws))
    model.d2 = katz.good_turing([sum(v == r for v in pairs.values()) for r in range(1, 7)])
    for (a, b), v in pairs.items():
        model.next[a][b] = v
    assert model.d2[0] > 0
    got = {r.doc_id: r.score for r in queries.op10_katz(spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx({d: model.row(d, t)[6] for d, t in rows}, rel=1e-9)
    for a in ["<s>", *list(model.next)[:40], "never seen"]:
        assert sum(model.p(a, w) for w in model.c) + model.p(a, "\0unseen") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("kept", [1, 2])
def test_three_orders_equal_brute_force(spark, kept):
    """Recursive, over dictionaries: each order's exact rest goes to the order below."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60] + [(None, None), (3, "")]
    base = Brute(rows)
    train = [["<s>", "<s>", *tokens(t)] for d, t in rows if crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    follow, factors = {}, {}
    for k in (2, 3):
        grams = Counter(tuple(ws[i - k + 1 : i + 1]) for ws in train for i in range(2, len(ws)))
        factors[k] = katz.good_turing([sum(v == r for v in grams.values()) for r in range(1, 7)], kept - 1)
        for g, v in grams.items():
            follow.setdefault(g[:-1], {})[g[-1]] = v
    known = {}

    def left(context):
        if context not in known:
            f, d = follow[context], factors[len(context) + 1]
            h, keep = sum(f.values()), {w: v for w, v in f.items() if v >= kept}
            share = sum(base.d(d, v) * v for v in keep.values()) / h
            rest = max(1 - share, 1 / (h + 1)) if share else 1.0
            known[context] = h, keep, share, rest, rest / (1 - sum(p(context[1:], w) for w in keep))
        return known[context]

    def p(context, w):
        if not context:
            return base.p1(w)
        if context not in follow:
            return p(context[1:], w)
        h, keep, share, rest, backoff = left(context)
        if w in keep:
            return (1 - rest) / share * base.d(factors[len(context) + 1], keep[w]) * keep[w] / h
        return backoff * p(context[1:], w)

    def score(text):
        ws = ["<s>", "<s>", *tokens(text)]
        return sum(math.log10(p((ws[i - 2], ws[i - 1]), ws[i])) for i in range(2, len(ws)))

    for context in list(follow)[:: len(follow) // 40]:
        assert sum(p(context, w) for w in base.c) + p(context, "\0unseen") == pytest.approx(1, abs=1e-9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.n_tokens, r.score) for r in katz.score(df, kept, 3).collect())
    want = sorted((len(tokens(t)), score(t)) for _, t in rows)
    assert [n for n, _ in got] == [n for n, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


@pytest.mark.parametrize(("kept", "order"), [(1, 2), (2, 3)])
def test_a_stored_model_scores_as_it_was_learned(spark, tmp_path, kept, order):
    """Texts of the training run get the scores of ``score``; new texts those of the same model by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:80] + [(None, None), (3, ""), (2, "A b"), (2, "A b")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, row int").repartition(3)
    path = katz.fit(df, f"file://{tmp_path}/model", kept, order)
    same = lambda x, y: [r[:5] for r in x] == [r[:5] for r in y] and [v for r in x for v in r[5:]] == pytest.approx([v for r in y for v in r[5:]], rel=1e-9)
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    want = sorted((tuple(r) for r in katz.score(df, kept, order).collect()), key=key)
    assert same(sorted((tuple(r) for r in katz.score_with(path, df).collect()), key=key), want)
    new = [(500, "words that no text has ever had xyzzy"), (501, None), (502, rows[0][1] + " xyzzy " + (rows[1][1] or "")), (None, "The end\x0b the")]
    got = sorted((tuple(r) for r in katz.score_with(path, spark.createDataFrame(new, "doc_id long, text string")).collect()), key=key)
    if order == 2:
        model = Brute(rows)
        pairs = Counter(p for d, t in rows if crc32(b"" if d is None else str(d).encode()) % 7 != 2 for ws in [tokens(t)] for p in zip(["<s>", *ws], ws))
        model.d2 = katz.good_turing([sum(v == r for v in pairs.values()) for r in range(1, 7)])
        for (a, b), v in pairs.items():
            model.next[a][b] = v
        assert same(got, sorted((model.row(*r) for r in new), key=key))
    assert len(got) == 4 and katz.score_with(path, df.limit(0)).collect() == []


def test_nothing_is_left_behind(spark):
    from pathlib import Path

    from cadenza.llm.common import shared_root

    root = Path(shared_root(spark).removeprefix("file://")) / "cadenza"
    before = set(root.iterdir()) if root.exists() else set()
    katz.score(spark.createDataFrame([(1, "a b a"), (2, "b a")], "doc_id long, text string")).collect()
    assert [p.name.rpartition("-")[0] for p in set(root.iterdir()) - before] == ["katz-scores"]
