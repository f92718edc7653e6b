import re

import xxhash
from cadenza.llm import simhash
from pyspark.sql import Row


def brute(rows):
    """Fingerprints bit by bit and components by comparing every pair."""
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted(((d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base.replace("w7 ", "x7 ")), (9, base.upper()), (2, None), (7, " \n"), (8, "one two"), (8, "one two"), (None, "One Two"), (11, "w1 " * 40000)]
    df = spark.createDataFrame([Row(doc_id=a, text=b, fp=1, component_id="x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == []


def test_salted_buckets_and_long_chains(spark):
    """Small limits force salting; a chain of prints one bit apart is one component."""
    chain = [(1 << i) - 1 for i in range(63)]
    fps = spark.createDataFrame([(x,) for x in chain + [0x5555 << 45]], "fp long")
    for salt in (4, 1000):
        found = {r.node: r.root for r in simhash.components(simhash.links(fps, salt_rows=salt)).collect()}
        assert {found[x] for x in chain} == {0}
        assert (0x5555 << 45) not in found


def test_near_splits_long_lists(monkeypatch):
    import numpy as np

    x = np.unique(np.random.default_rng(1).integers(0, 1 << 16, 500).astype(np.uint64))

    def classes(links):
        label = {int(v): int(v) for v in x}
        for a, b in links:
            a, b = label[a], label[b]
            label = {k: (a if v == b else v) for k, v in label.items()}
        return len(set(label.values()))

    whole = classes(simhash.near(x, 3))
    monkeypatch.setattr(simhash, "COMPARE_BLOCK", 16)
    assert classes(simhash.near(x, 3)) == whole


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_large_buckets_give_spanning_links_in_linear_space(spark):
    """Tight and loose groups of thousands in one bucket: few links, the components of all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 60))
    tight = [base ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(24) for j in range(i) for k in range(j)]
    loose = [int(x) << 26 for x in rng.integers(0, 1 << 37, 3000)]
    prints = sorted({x % (1 << 63) for x in [base, *tight, *loose]})
    fps = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = simhash.links(fps, salt_rows=500).collect()
    whole = simhash.spanning(np.array(prints, dtype=np.uint64), 3)

    def classes(pairs):
        label = {x: x for x in prints}

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
        return {x: root(x) for x in prints}

    assert all(bin(r.u ^ r.v).count("1") <= 3 for r in found)
    assert classes([(r.u, r.v) for r in found]) == classes(whole)
    assert len(found) < 300 * len(prints), "not all pairs"
    assert classes(simhash.near(np.array(prints, dtype=np.uint64), 3)) == classes(whole)
