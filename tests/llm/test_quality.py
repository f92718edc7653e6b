import re
from collections import Counter

from cadenza.llm import quality
from pyspark.sql import Row


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(covered), failed


GOOD = "The quick brown fox jumps over the lazy dog and runs far away from here."
TEXTS = [None, "", " \t\n\x0b\x0c\r", GOOD, GOOD + "\n" + GOOD, "a b c d e " * 3000, " x y \U0001f600 z", GOOD.upper() * 2, "### " * 4 + GOOD, "1 2 3 4 5 6 7 8 9 10 11 12", "\n\n a \n a\n a\r\nb", " ".join(f"w{i}" for i in range(50000))]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([Row(doc_id=None if i == 3 else i // 2, text=t, kept="x", _words=1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, _words int")
    got = [tuple(r)[1:7] for r in quality.score(df).collect()]
    assert sorted(got) == sorted(map(brute, TEXTS))
    assert all(not r.kept for r in quality.score(df).collect() if r.base_failed)


def test_verdicts(spark):
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.score(df).collect() if r.kept}
    assert kept == {3}
    stage = quality.accepted(df)
    assert stage.columns == df.columns and {r.doc_id for r in stage.collect()} == kept


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = quality.BASE | quality.METHOD
    judged = docs.withColumn("_text", docs.text)
    judged = judged.withColumn("_words", quality.words(judged._text)).withColumn("_lines", quality.lines(judged._text))
    parts = [judged[c] for c in ("_text", "_words", "_lines")]
    one, two = (judged.select(quality.verdict(order, rules, *parts).alias("v")).collect() for order in (list(rules), list(rules)[::-1]))
    assert one == two and 0 < sum(r.v for r in one) < len(one)
    assert set(quality.order_rules(docs, rules, 50)) == set(rules)


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(none).collect() == [] and quality.accepted(none).collect() == []
    plan = quality.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_clean_labelled_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs).join(labels, "doc_id")
    assert scored.where("quality = 1 and not base_failed and not kept").count() == 0
    assert scored.where("quality = 0 and not base_failed and not kept").count() > 0


def test_long_clean_text_stays_and_poor_text_goes(spark):
    """The share of distinct words falls with length in clean text; the verdict must not."""
    import random

    rng = random.Random(8)
    made = lambda n, vocabulary: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) if vocabulary is None else rng.choice(vocabulary) for _ in range(n))
    clean, poor = made(4000, None).split(), made(30, None).split()
    texts = [made(60_000, clean), made(3000, clean), made(200, poor[:10]), made(3000, poor)]
    assert len(set(texts[0].split())) < 0.2 * 60_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.score(df).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {0, 1} == {r.doc_id for r in quality.accepted(df).collect()}


def test_cheap_and_selective_rules_come_first(spark):
    """Planted rules: the order follows rejections per cost, and stays the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slow = lambda t, w: quality.repeat_words(w) + quality.repeat_words(w, 4) + quality.repeat_words(w, 6)
    from pyspark.sql import functions as F

    rules = {
        "slow_rare": lambda t, w, x: slow(t, w) > 10**6,
        "slow_frequent": lambda t, w, x: slow(t, w) > -1,
        "cheap_rare": lambda t, w, x: F.size(w) > 10**6,
        "cheap_frequent": lambda t, w, x: F.size(w) > 1,
    }
    found = {e.name: e for e in quality.estimate_rules(docs, rules)}
    assert found["slow_rare"].seconds > 4 * found["cheap_rare"].seconds
    assert found["slow_rare"].rejected == found["cheap_rare"].rejected == 0 and found["cheap_frequent"].rejected > 400 and found["cheap_frequent"].rows == 500
    assert {tuple(quality.order_rules(docs, rules)) for _ in range(5)} == {("cheap_frequent", "slow_frequent", "cheap_rare", "slow_rare")}


def test_sample_is_of_whole_texts_and_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.text for r in docs.collect()}
    one, two = (sorted(r[0] for r in quality.draw(d, 100).collect()) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == 100 and set(one) <= texts
    ids = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "c")], "doc_id long, text string")
    assert quality.draw(ids, 3).count() == 3 and quality.draw(ids.limit(0), 3).count() == 0


def test_long_texts_equal_the_sql(spark):
    """Distinct words go by windows in the query and in its SQL."""
    import duckdb

    rows = [(i, " ".join(f"w{(k * 7) % m}x" for k in range(n))) for i, (n, m) in enumerate([(1000, 150), (1000, 300), (5000, 900), (20000, 2500), (1999, 199), (30, 30)])]
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = duck.sql(quality.ORACLE)
    want = sorted(dict(zip([d[0] for d in found.description], r)).items() for r in found.fetchall())
    got = sorted(sorted(r.asDict().items()) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(sorted(w) for w in want) and len({dict(g)["kept"] for g in got}) == 2
