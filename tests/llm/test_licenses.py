import re

import pytest
from cadenza.llm import licenses
from pyspark.sql import Row

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [None, "", "...", "MIT License", "mit\n\nLICENSE, mit-license; MIT_license", "emit license", "mit licenses", "GNU General Public License Apache License CC BY", "cc by cc by", "É mit é license", "été " * 30000 + "Apache-License", "a mit license", "123 mit license4"]


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame([Row(doc_id=i // 2, text=t, labels=0) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels int")
    got = [tuple(r)[1:6] for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted(map(brute, TEXTS), key=str)
    assert licenses.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize(("text", "label", "edits"), [("Released under the MIT Licence.", "mit", 1), ("the Apche License", "apache", 1), ("GNU Genral Public Licence v3", "gpl", 2), ("All rihts reserved", "proprietary", 1), ("Licensed under CC BY-NC 4.0", "cc-by-nc", 0)])
def test_edits_within_the_bound(text, label, edits):
    _, _, found = licenses.Scanner().scan(text.encode())
    assert min(x.edits for x in found if x.label == label) == edits


def test_plain_text_has_no_label():
    for text in ("the and of emit licensed things", "apace lines were seen", "public affairs of the general"):
        assert licenses.Scanner().scan(text.encode())[2] == []


def test_windows_lose_no_match():
    """The seeded search finds what a search of the whole line finds."""
    import random

    rng, scanner = random.Random(5), licenses.Scanner()
    for _ in range(300):
        n = rng.randrange(len(licenses.NOTICES))
        p, label, k = scanner.notices[n]
        chars = list(p)
        for _ in range(rng.randint(0, k)):
            i = rng.randrange(1, len(chars) - 1)
            rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, rng.choice("abc")), lambda: chars.__setitem__(i, rng.choice("abc"))])()
        line = f" some words {''.join(chars)} and more "
        whole = bool(scanner.patterns[n].search(line))
        assert whole and label in {x.label for x in scanner.fuzzy(line)}


def test_adjacent_notices_are_all_found():
    """A better match later in a window hides none before it."""
    scanner = licenses.Scanner()

    def spans(line, label="mit", size=2):
        return [(x.first, x.edits) for x in scanner.fuzzy(line) if x.label == label and x.last - x.first + 1 == size]

    assert spans(" the mit licence and mit license here ") == [(1, 1), (4, 0)]
    assert spans(" mit licence mit licence mit license mit licence ") == [(0, 1), (2, 1), (4, 0), (6, 1)]
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    assert spans(f" {notice.replace('granted', 'grantd')} {notice} ", size=13) == [(0, 1), (13, 0)]
    gpl = "gnu general public license"
    assert spans(f" a {gpl} {gpl.replace('public', 'publik')} {gpl} ", "gpl", 4) == [(1, 0), (5, 1), (9, 0)]
    assert len(spans(" mit licence" * 5000 + " ")) == 5000


LICENSE_LINE = "Released under the MIT License. Licensed under the Apache License, Version 2.0. GNU Genral Public License. All rights reserved. CC BY 4.0\n"


def test_many_matches_take_linear_time():
    """A text of 10 MB of license lines."""
    import time

    scanner, times = licenses.Scanner(), []
    for size in (1 << 20, 10 << 20):
        text = (LICENSE_LINE * (size // len(LICENSE_LINE) + 1)).encode()
        began = time.process_time()
        n, base, found = scanner.scan(text)
        times.append(time.process_time() - began)
        lines = size // len(LICENSE_LINE) + 1
        assert len(base) == 3 * lines and n == 24 * lines and len([x for x in found if x.label == "gpl"]) == lines
    assert times[1] < 20 * times[0]


def whole_line(scanner, line):
    """Every notice sought in the whole line, without seeds or windows; words are counted from the start."""
    out = []
    for n, (p, label, _) in enumerate(scanner.notices):
        for start, end, edits in scanner.matches(n, line, 0, len(line)):
            first = line.count(" ", 0, start) - 1
            out.append((label, first, first + line.count(" ", start, end), edits, 1 - edits / len(p)))
    return out


def test_documents_equal_a_search_of_whole_lines(spark):
    """Labels, score and spans of all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {-1 - i: t for i, t in enumerate([LICENSE_LINE * 5, "mit licence mit license mit licence apache licens released under teh mit license", "gnu general public license gnu genral public license"])}
    scanner = licenses.Scanner()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        found = whole_line(scanner, " " + " ".join(words).encode().decode("latin-1") + " ")
        base = brute(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == {x[0] for x in found} | set(base[4].split(",")) - {""}
        assert r.score == pytest.approx(1.0 if base[1] else max((x[4] for x in found), default=0.0))
        assert sorted(r.spans.split(";")) == sorted([f"{x[0]}:{x[1]}-{x[2]}:{x[3]}" for x in found] or [""])
