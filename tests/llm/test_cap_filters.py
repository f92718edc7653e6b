import math

import numpy as np
import pytest
from cadenza.llm import cap_filters

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, row long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], SCHEMA)


def brute(rows, least=0.9):
    """Every pair by cosine in doubles."""
    x = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x.append(np.array(v, dtype=np.float32).astype(float) if ok else None)
    unit = [None if v is None else v / np.linalg.norm(v) for v in x]
    label, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i] += 1
                n[j] += 1
                if label[i] != label[j]:
                    label = [label[j] if y == label[i] else y for y in label]
    first = {}
    for (d, _), y in zip(rows, label):
        if d is not None:
            first[y] = min(first.get(y, d), d)
    out = []
    for (d, _), y, m in zip(rows, label, n):
        c = first.get(y)
        out.append((d, m, c, c is None if d is None or c is None else d == c))
    return sorted(((a, b, c, bool(k) if a is not None else c is None) for a, b, c, k in out), key=str)


def got(df):
    return sorted((tuple(r) for r in cap_filters.near_duplicates(df).collect()), key=str)


def near(rng, v, cos):
    """A unit vector at an angle of cosine ``cos`` to ``v``."""
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cos * v + math.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def unit(rng, d):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def test_edge_rows(spark):
    rng = np.random.default_rng(4)
    v, w = unit(rng, 64), unit(rng, 64)
    rows = [(9, v.tolist()), (3, (5 * v).tolist()), (3, v.tolist()), (4, (-v).tolist()), (None, near(rng, v, 0.95).tolist()), (20, w.tolist()), (21, near(rng, w, 0.91).tolist())]
    rows += [(30, None), (31, []), (32, [0.0] * 64), (33, [1.0, None] * 32), (34, [float("nan")] * 64), (35, [float("inf")] + [0.0] * 63), (None, None)]
    rows += [(40, [3.0]), (41, [0.5]), (42, [-1.0]), (43, [1.0, 0.0]), (44, [1.0, 0.1]), (45, v[:16].tolist()), (46, (v[:16] + 0.001).tolist())]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, [])) == []


@pytest.mark.parametrize("spread", [0.99, 0.955, 0.93])
def test_groups_of_near_copies(spark, spread):
    """Tight groups are taken whole; looser ones, whose radii decide nothing, are compared member by member."""
    rng = np.random.default_rng(int(spread * 1000))
    rows = [(i, unit(rng, 64).tolist()) for i in range(300)]
    for g, size in enumerate((2, 3, 40, 150)):
        v = unit(rng, 64)
        rows += [(1000 * (g + 1) + i, near(rng, v, spread).tolist()) for i in range(size)]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    want = brute(rows)
    found = got(table(spark, rows).repartition(7))
    total = sum(r[1] for r in want)
    assert sum(r[1] for r in found) >= 0.99 * total
    assert all(a[1] <= b[1] for a, b in zip(sorted(found), sorted(want)))
    if spread == 0.99:
        assert found == want


def test_recall_at_the_bound():
    """Pairs of cosine 0.9, the hardest that count: over 0.97 of them share a filter, in several widths."""
    rng = np.random.default_rng(8)
    for d in (2, 4, 8, 12, 32, 64, 256):
        code = cap_filters.Code(d)
        x = np.array([unit(rng, d) for _ in range(400)])
        y = np.array([near(rng, v, 0.9) for v in x])
        sets = []
        for m in (x, y):
            s = [set() for _ in m]
            for r, f in zip(*code.decode(m)):
                s[r].add(int(f))
            sets.append(s)
        shared = np.mean([bool(a & b) for a, b in zip(*sets)])
        assert shared >= 0.97, (d, shared)


def test_list_decoding_finds_every_exceeding_filter():
    code = cap_filters.Code(16, words=20, codes=3)
    rng = np.random.default_rng(0)
    x = np.array([unit(rng, 16) for _ in range(300)])
    r, f = code.decode(x)
    assert (np.diff(r) >= 0).all()
    for row, v in enumerate(x):
        want = set()
        for k, (left, right) in enumerate(code.codes):
            sums = (v @ left)[:, None] + v @ right
            want |= {k * 400 + int(i) for i in np.flatnonzero(sums.ravel() >= code.reach)}
        assert set(f[r == row].tolist()) == want


def test_large_filters_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "MOST_ROWS", 4)
    monkeypatch.setattr(cap_filters, "MEMBERS", 8)
    rng = np.random.default_rng(12)
    v = unit(rng, 64)
    rows = [(i, near(rng, v, 0.94).tolist()) for i in range(60)]
    found, want = got(table(spark, rows).repartition(5)), brute(rows)
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want)


def test_query_equals_brute_force(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    assert got(v) == brute(rows)


def test_short_and_long_buckets_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = unit(rng, 32)
    rows = [(i, near(rng, v, 0.97).tolist()) for i in range(90)] + [(100 + i, unit(rng, 32).tolist()) for i in range(50)]
    df = table(spark, rows).repartition(3)
    found = got(df)
    monkeypatch.setattr(cap_filters, "SHORT", 2)
    monkeypatch.setattr(cap_filters, "HELD", 50)
    assert got(df) == found
