import hashlib
import random

import numpy as np
import pytest
from cadenza.llm import prefix_sort, suffix_dedup
from pyspark.sql import Row


def brute(rows):
    """Remove by a table of all 100-byte strings and the places they start at first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first = {}
    texts = [(t or "").encode() for _, t in rows]
    for i in order:
        for p in range(len(texts[i]) - 99):
            first.setdefault(texts[i][p : p + 100], (i, p))
    out = []
    for i, (d, _) in enumerate(rows):
        t = texts[i]
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([Row(doc_id=d, text=t, n_bytes="x", spans=1) for d, t in rows], "doc_id long, text string, n_bytes string, spans int").repartition(3)


def planted(seed):
    """Documents of a small alphabet with shared passages, copies, edits, periodic and short texts."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passages = [text(rng.randint(80, 260)) for _ in range(6)]
    rows = []
    for i in range(60):
        kind = rng.randrange(6)
        t = text(rng.randint(0, 300))
        if kind == 0 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind == 1 and rows:
            t = rng.choice(rows)[1] or ""
            k = rng.randrange(len(t) + 1)
            t = t[:k] + "#" + t[k + 1 :]
        elif kind in (2, 3):
            t = t + rng.choice(passages) + text(50) + rng.choice(passages)
        elif kind == 4:
            t = rng.choice(["a", "ab", text(37)]) * rng.randint(1, 300)
        rows.append((i * 7 % 61 - 5, t))
    return [*rows, (900, None), (901, ""), (None, passages[0] * 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = planted(seed)
    assert got(suffix_dedup.dedup(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_small_runs_and_pieces(monkeypatch, seed):
    """Without Spark's workers, so that the small limits hold: pieces, runs and merges give what brute force gives."""
    rows = [(d, t) for d, t in planted(seed) if d is not None]
    monkeypatch.setattr(suffix_dedup, "PIECE", 400)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    monkeypatch.setattr(prefix_sort, "BLOCK", 7)
    suffix_dedup._powers.cache_clear()
    docs = [(d, 0, (t or "").encode()) for d, t in rows]
    codes = []
    for parts, text, bounds in suffix_dedup.pieces(iter(docs)):
        a, first, last, _ = suffix_dedup.anchors(text, bounds)
        own = np.searchsorted(bounds, a, side="right") - 1
        for x, f, z, o in zip(a.tolist(), first.tolist(), last.tolist(), own.tolist()):
            d, _, at = parts[o]
            codes.append((d, (x - bounds[o] + at) << 14 | (x - f) << 7 | (x - z)))
    suffix_dedup._powers.cache_clear()
    texts = {d: t for d, _, t in docs}
    assert sum((c >> 7 & 127) - (c & 127) + 1 for _, c in codes) == sum(max(0, len(t) - 99) for t in texts.values())

    def sort(records, group, spans, edge):
        run, blobs = suffix_dedup.Run([0, 1, 2], group, spans, edge), {}
        for x in [*records, None]:
            if (x and run.add(x)) or (x is None and run.held):
                for t, kind, blob in zip(*(c.to_pylist() for c in run.flush().columns)):
                    blobs.setdefault(t, []).append((kind, blob))
        for b in blobs.values():
            for batch in suffix_dedup.merge(b, group, spans, edge):
                yield from batch.to_pylist()

    one = list(sort([(suffix_dedup.anchor_key(texts[d], int(c)), d, 0, int(c) >> 14) for d, c in codes], 48, suffix_dedup.anchor_span, suffix_dedup.anchor_text))
    windows = [(b"12345678" + t[i : i + 100], d, r, s + i) for x in one if x["kind"] == 2 for d, r, s, t in suffix_dedup.edge_rows(x["blob"]) for i in range(len(t) - 99)]
    windows = [(hashlib.md5(w[8:]).digest()[:8] + w[8:], *rest) for w, *rest in windows]
    two = list(sort(windows, 0, suffix_dedup.window_span, None))
    out = []
    for d, _, t in docs:
        x = np.array([(y["start"], y["end"]) for y in one + two if y["kind"] == 1 and y["d"] == d], dtype=np.int64).reshape(-1, 2)
        s, e = suffix_dedup.union_spans(x[:, 0], x[:, 1])
        kept = b"".join(t[a:z] for a, z in zip([0, *e], [*s, len(t)]))
        out.append((d, len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
    assert sorted(out, key=str) == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=500))
    rows = got(suffix_dedup.dedup(frame(spark, [(1, long), (1, long), (2, long), (2, "x" + long)])))
    assert [r[2] for r in rows] == [0, 0, 500, 500]
    assert got(suffix_dedup.dedup(frame(spark, [(1, "a")]).limit(0))) == []


def test_text_keeps_whole_characters(spark):
    a = "é" * 200
    out = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame([(1, "en", "xy" + a), (2, "fr", "z" + a + "ètail")], "doc_id long, lang string, text string"), with_text=True).collect()}
    assert out[2].text == "zètail" and out[2].lang == "fr" and out[1].text.startswith("xy")
    assert out[2].n_removed >= 400


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(suffix_dedup.dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_runs_round_trip_and_merge():
    rng = random.Random(9)
    keys = lambda: sorted(bytes(rng.choices(b"ab\0", k=rng.randint(0, 12))) for _ in range(200))
    runs, everything = [], []
    for i in range(7):
        ks = keys() if i else []
        along = np.array([(i, j) for j in range(len(ks))], dtype=np.int64).reshape(-1, 2)
        runs.append(prefix_sort.encode(ks, prefix_sort.shared_prefixes(ks), along))
        everything += [(k, (i, j)) for j, k in enumerate(ks)]
    out = list(prefix_sort.LoserTree([prefix_sort.decode(r) for r in runs]))
    assert [(k, a) for _, k, a in out] == sorted(everything)
    for (_, x, _), (s, y, _) in zip(out, out[1:]):
        assert s == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_known_prefixes_are_not_compared():
    """Heads that share different lengths with the last string are ordered without their bytes."""

    class Blind(bytes):
        def __getitem__(self, i):
            raise AssertionError("looked at bytes")

    tree = prefix_sort.LoserTree([[(0, b"aaab", (0,))], [(0, b"ab", (1,))]])
    tree.key, tree.shared = [Blind(b"aaab"), Blind(b"ab")], [2, 1]
    assert tree._play(0, 1) == (0, 1) and tree._play(1, 0) == (0, 1)


def test_texts_of_several_pieces(spark):
    """Passages of megabytes, shared, shifted and cut by an edit, in texts that are longer than a piece."""
    rng = random.Random(8)
    big = "".join(rng.choices("abcdefgh ij", k=(2 << 20) + 12345))
    rows = [(1, big), (2, "x" + big[: 1 << 20] + "#" + big[1 << 20 :]), (3, big[5000:1_100_000])]
    assert suffix_dedup.PIECE < len(big) / 2
    assert got(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_query_equals_its_sql(spark):
    import duckdb
    from cadenza.llm import queries

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got(queries.op7_suffix_dedup(spark, sf)) == sorted(duck.sql(queries.oracle_sql()["op7_suffix_dedup"]).fetchall(), key=str)
