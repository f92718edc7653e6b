import pytest
from cadenza.operators import align
from cadenza.sources import files
from pyspark.sql import functions as F


def words(spark, rows, file="a"):
    return spark.createDataFrame([(file, i, w, float(s), float(e)) for i, (w, s, e) in enumerate(rows)], "file string, word_pos long, word string, start double, end double")


def spans(spark, rows, file="a"):
    return spark.createDataFrame([(file, i, sp, float(s), float(e)) for i, (sp, s, e) in enumerate(rows)], "file string, span_pos long, speaker string, start double, end double")


def said(df):
    return [(r.speaker, r.low) for r in df.orderBy("word_pos").collect()]


def test_span_filter_is_inclusive(spark):
    assert [r.speaker for r in align.filter_spans(spans(spark, [("x", 0, 0.25), ("y", 1, 1.2)])).collect()] == ["x"]


@pytest.mark.parametrize("bin_size", [0.5, 30.0])
def test_assignment(spark, bin_size):
    w = words(spark, [("over", 1, 3), ("tie", 8, 10), ("gap", 20, 21), ("point", 9.5, 9.5), ("edge", 40, 41), ("lone", 15, 15)])
    s = spans(spark, [("A", 0, 1.6), ("B", 1.7, 5), ("C", 7, 9), ("D", 9, 11), ("E", 24, 30), ("short", 20, 20.1)])
    got = said(align.assign_speakers(w, s, bin_size=bin_size))
    assert got == [("B", False), ("C", False), ("E", True), ("D", False), ("E", True), ("D", True)]


def test_overlapping_spans_and_equal_distances(spark):
    w = words(spark, [("in", 2, 3), ("mid", 12, 13), ("at", 10, 10)])
    s = spans(spark, [("A", 0, 10), ("B", 1, 9), ("C", 15, 20), ("D", 15, 16)])
    assert said(align.assign_speakers(w, s)) == [("A", False), ("A", True), ("A", False)]


def test_assignment_equals_the_loop(spark):
    import random

    rng = random.Random(4)
    for _ in range(2):
        sp = sorted((rng.randint(0, 60), rng.randint(1, 20)) for _ in range(12))
        sp = [(f"s{i}", a, a + n) for i, (a, n) in enumerate(sp)]
        ws = [("w", a := rng.randint(0, 90), a + rng.choice([0, 0, 1, 2, 5])) for _ in range(60)]
        want = []
        for _, a, z in ws:
            overlaps = [min(z, e) - max(a, b) for _, b, e in sp]
            inside = [i for i, (_, b, e) in enumerate(sp) if z <= a and b <= a <= e]
            if max(overlaps) > 0:
                want.append((sp[overlaps.index(max(overlaps))][0], False))
            elif inside:
                want.append((sp[inside[0]][0], False))
            else:
                gaps = [max(b - z, a - e, 0) for _, b, e in sp]
                want.append((sp[gaps.index(min(gaps))][0], True))
        assert said(align.assign_speakers(words(spark, ws), spans(spark, sp), bin_size=7.0)) == want


def test_no_spans_is_an_error(spark):
    w, s = words(spark, [("a", 0, 1)]), spans(spark, [("x", 0, 0.1)])
    with pytest.raises(Exception, match="no speaker spans"):
        align.assign_speakers(w, s).collect()
    assert align.assign_speakers(w, s, missing="skip").count() == 0


def test_turns(spark):
    w = words(spark, [("a", 0, 0.5), ("b c", 2.5, 3.0), ("d", 5.1, 5.5), ("e", 5.6, 5.8), ("f", 6, 6.2)])
    w = w.withColumns({"speaker": F.when(F.col("word") == "e", "y").otherwise("x"), "low": F.col("word") == "d"})
    got = [(r.turn_pos, r.speaker, r.text, r.n_words, r.n_low, r.start, r.end) for r in align.group_turns(w).orderBy("turn_pos").collect()]
    assert got == [(0, "x", "a b c", 3, 0, 0.0, 3.0), (1, "x", "d", 1, 1, 5.1, 5.5), (2, "y", "e", 1, 0, 5.6, 5.8), (3, "x", "f", 1, 0, 6.0, 6.2)]


def test_gap_counts_from_the_latest_end(spark):
    w = words(spark, [("long", 0, 10), ("in", 1, 2), ("near", 11.5, 12)]).withColumns({"speaker": F.lit("x"), "low": F.lit(False)})
    assert align.group_turns(w).count() == 1


def test_split_tokens(spark):
    got = align.join_split_tokens(words(spark, [("-lead", 0, 1), ("4", 1, 2), (".5", 2, 4), ("%", 3, 3.5), ("$", 5, 6), ("co", 6, 7), ("-op", 7, 8)])).orderBy("word_pos").collect()
    assert [(r.word_pos, r.word, r.start, r.end) for r in got] == [(0, "-lead", 0, 1), (1, "4.5%", 1, 4), (4, "$", 5, 6), (5, "co-op", 6, 8)]


def test_end_to_end_reports_and_invariants(spark):
    w = words(spark, [("Hi", 0, 1), ("there", 1, 2), (".", 2, 2.2), ("Yes", 3, 4), ("far", 30, 31)])
    s = spans(spark, [("A", 0, 2.5), ("B", 2.8, 4.5), ("noise", 5, 5.1)])
    turns = align.align(w, s)
    assert [(r.speaker, r.text, r.n_words, r.n_low) for r in turns.orderBy("turn_pos").collect()] == [("A", "Hi there.", 2, 0), ("B", "Yes", 1, 0), ("B", "far", 1, 1)]
    row = align.report(turns, s).first()
    assert (row.n_turns, row.n_words, row.n_low, row.n_spans, row.n_dropped, row.low_pct) == (3, 4, 1, 3, 1, 25.0)
    assert align.invariants(w, turns).first().ok
    assert [r.turn_pos for r in align.low_turns(turns).collect()] == [2]


def test_speaker_totals(spark):
    got = {r.speaker: (r.total, r.share) for r in align.speaker_totals(spans(spark, [("A", 0, 3), ("B", 3, 4)])).collect()}
    assert got == {"A": (3.0, 75.0), "B": (1.0, 25.0)}
    assert align.speaker_totals(spans(spark, [("A", 1, 1)])).first().share == 0.0


def test_sources(spark, tmp_path):
    import json

    (tmp_path / "t").mkdir()
    (tmp_path / "d").mkdir()
    seg = {"id": 0, "text": " hi ", "start": 0.00049, "end": 1.5, "words": None}
    full = seg | {"words": [{"word": " a ", "start": 0.12345, "end": 1.0}]}
    (tmp_path / "t/one.json").write_text(json.dumps({"file": "one.wav", "duration": 2.0, "segments": [seg, full]}, indent=1))
    (tmp_path / "t/two.json").write_text(json.dumps({"file": "two.wav", "duration": 2.0, "segments": []}))
    (tmp_path / "d/one.json").write_text(json.dumps({"file": "one.wav", "turns": [{"speaker": "B", "start": 2, "end": 3}, {"speaker": "A", "start": 0, "end": 2}]}))
    from cadenza import schemas

    t = files.segment_normalize(files.read_json(spark, str(tmp_path / "t"), schemas.TRANSCRIPT))
    d = files.read_json(spark, str(tmp_path / "d"), schemas.DIARIZATION)
    assert [(r.file, r.word, r.start) for r in files.words(t).collect()] == [("one", "a", 0.123)]
    assert [s.words for s in t.where("stem = 'one'").first().segments][0] == []
    assert [r.speaker for r in files.spans(d).orderBy("span_pos").collect()] == ["A", "B"]
    both, lacks = files.paired(t, d)
    assert [r.stem for r in both.collect()] == ["one"] and [r.stem for r in lacks.collect()] == ["two"]
    assert [r.stem for r in files.pending(t, d).collect()] == ["two"]


def test_audio_model_adapter(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"no")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    found = files.audio(spark, str(tmp_path))
    assert [r.stem for r in found.select("stem").collect()] == ["a"]
    schema = StructType([StructField("file", StringType()), StructField("n", LongType())])
    out = files.run_model(found, lambda: lambda path, content: {"file": path.rpartition("/")[2], "n": len(content)}, schema)
    assert [tuple(r) for r in out.collect()] == [("a.wav", 3)]


def test_recordings_without_a_document_are_recognised(spark, tmp_path):
    """A second run does what the first left; documents read back like any others."""
    import json

    from cadenza import schemas
    from cadenza.plans import build

    for name in ("a", "b b"):
        (tmp_path / f"{name}.wav").write_bytes(name.encode())
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.json").write_text(json.dumps({"file": "a.wav", "turns": []}))

    def load():
        return lambda path, content: {"file": path.rpartition("/")[2], "turns": [{"speaker": content.decode(), "start": 0.0, "end": 1.5}]}

    assert build.recognise(spark, str(tmp_path), str(out), load, schemas.DIARIZATION) == 1
    assert build.recognise(spark, str(tmp_path), str(out), load, schemas.DIARIZATION) == 0
    assert sorted(p.name for p in out.iterdir() if p.suffix == ".json") == ["a.json", "b b.json"]
    found = files.spans(files.read_json(spark, str(out), schemas.DIARIZATION)).collect()
    assert [(r.file.replace("%20", " "), r.speaker, r.end) for r in found] == [("b b", "b b", 1.5)]


def test_skipped_files_are_named(spark, tmp_path):
    import json

    from cadenza.plans import build

    for folder, names in (("t", ("x", "y")), ("d", ("x",))):
        (tmp_path / folder).mkdir()
        for n in names:
            body = {"file": n, "segments": []} if folder == "t" else {"file": n, "turns": []}
            (tmp_path / folder / f"{n}.json").write_text(json.dumps(body))
    assert [tuple(r) for r in build.skipped(spark, str(tmp_path / "t"), str(tmp_path / "d")).collect()] == [("y", "no speaker spans")]


def test_exclusive_spans_equal_a_look_at_every_moment(spark):
    """At each moment the span that began first, of several the first in the list, speaks; time ranges of any width give the same."""
    import random

    rng = random.Random(5)
    rows = []
    for f in "ab":
        for i in range(120):
            start = rng.randrange(0, 300)
            rows.append((f, i, rng.choice("AB"), start, start + rng.choice([0, 1, 2, 3, 5, 9, 40])))
    df = spark.createDataFrame(rows, "file string, span_pos int, speaker string, start long, end long")
    want = set()
    for f in "ab":
        for t in range(350):
            live = [(s, i) for g, i, _, s, e in rows if g == f and s <= t < e]
            if live:
                want.add((f, t, min(live)[1]))
    for size in (7, 50, 10_000):
        got = align.exclusive_spans(df, size).collect()
        assert {(r.file, t, r.span_pos) for r in got for t in range(r.start, r.end)} == want
        assert sum(r.end - r.start for r in got) == len(want), "no two overlap"
