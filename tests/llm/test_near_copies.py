import random
import re

import corpus_pipeline
import pytest
from cadenza.llm import near_copies, simhash


def sets(texts):
    out = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))))
    return out


def brute(texts):
    """A label for each text: components at a five-word Jaccard index of 0.8 or more, by comparing every pair."""
    grams, label = sets(texts), list(range(len(texts)))
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if label[i] != label[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force_jaccard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {}
    for (d, _), x in zip(rows, brute([t for _, t in rows])):
        want.setdefault(x, d)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(want.values())


@pytest.mark.parametrize("part", [near_copies.PART, 6000])
def test_edited_copies_chains_and_split_components(spark, part):
    rng = random.Random(3)
    texts = []
    for k in range(4):
        base = [f"w{k}x{i}" for i in range(300)]
        texts.append(" ".join(base))
        for n in (3, 5, 6, 8, 12, 20):
            w = list(base)
            for i in rng.sample(range(300), n):
                w[i] = f"edit{rng.random()}"
            texts.append(" ".join(w))
    texts += [" ".join(f"c{i}" for i in range(s, s + 200)) for s in range(0, 200, 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {}
    for d, x in enumerate(brute(texts)):
        want.setdefault(x, d)
    assert sorted(r.doc_id for r in near_copies.keep_one(df, part).collect()) == sorted(want.values())


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash.keep_one])
def test_repeated_rows_and_rows_without_an_id(spark, keep_one):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(50)) for x in "abce")
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (1, b), (None, c), (None, c), (7, e), (7, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, keep_one(df).collect()), key=str) == sorted([(1, a), (1, b), (None, c), (7, e)], key=str)
