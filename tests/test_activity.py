import random
import struct
import wave

import numpy as np
import pytest
from cadenza.operators import activity
from cadenza.sources import audio
from pyspark.sql import functions as F


def whole_file(energies, low, high, silence):
    """One pass over a file's windows with a state: in a run or not, was it loud, how long is the pause."""
    runs, now = [], None
    for i, e in enumerate([*energies, None]):
        if e is not None and e >= low:
            now = now or [i, i, False]
            now[1], now[2] = i, now[2] or e >= high
        elif now:
            runs += [now[:2]] if now[2] else []
            now = None
    out = []
    for a, b in runs:
        if out and a - out[-1][1] <= silence:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [3, 10, 1 << 14])
def test_segments_equal_a_pass_over_the_file(spark, block):
    rng = random.Random(1)
    files = {f"f{k}": [rng.choice([0.0, 0.0, 0.004, 0.012, 0.015, 0.03, None]) for _ in range(n)] for k, n in enumerate((0, 1, 40, 400, 900))}
    df = spark.createDataFrame([(f, i, e) for f, es in files.items() for i, e in enumerate(es)], "file string, window long, energy double").repartition(5)
    want = {(f, a, b) for f, es in files.items() for a, b in whole_file(es, 0.01, 0.02, 4)}
    assert {tuple(r) for r in activity.segments(df, silence=4, block=block).collect()} == want != set()


def save(path, x, rate, width, channels):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.repeat(np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels)
        raw = (scaled + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in scaled)
        w.writeframes(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(3)
    for name, rate, width, channels, seconds in (("a", 8000, 2, 1, 7.013), ("b", 11025, 1, 2, 3.2), ("c", 16000, 3, 1, 2.5), ("d", 8000, 4, 2, 1.0), ("e", 8000, 2, 1, 0)):
        t = np.arange(int(rate * seconds)) / rate
        loud = (np.floor(t * 1.7) % 2 == 0) * (0.3 * np.sin(2 * np.pi * 220 * t)) + 0.001 * rng.normal(size=len(t))
        save(out / f"{name}.wav", np.clip(loud, -1, 1), rate, width, channels)
    (out / "x.txt").write_text("no audio")
    return out


@pytest.mark.parametrize("size", [1000, 33_333, 8 << 20])
def test_windows_of_ranges_equal_those_of_whole_files(spark, folder, size):
    got = {(r.stem, r.window): (r.start_ms, r.energy) for r in audio.energies(spark, str(folder), size=size).collect()}
    want = {}
    for p in folder.glob("*.wav"):
        with wave.open(str(p)) as w:
            x = audio.samples(w.readframes(w.getnframes()), w.getsampwidth())
            step, rate, channels = w.getframerate() * 20 // 1000, w.getframerate(), w.getnchannels()
        for i in range(0, len(x), step * channels):
            k = i // (step * channels)
            want[p.stem, k] = (k * step * 1000 // rate, float(np.sqrt(np.mean(x[i : i + step * channels] ** 2))))
    assert got.keys() == want.keys() and len(got) > 500
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in got)


def test_speech_of_files_read_in_ranges(spark, folder):
    windows = audio.energies(spark, str(folder), size=5000).withColumnRenamed("stem", "file")
    assert windows.rdd.getNumPartitions() > 10, "a file is dealt to tasks"
    got = {tuple(r) for r in activity.segments(windows, block=16).collect()}
    by = {}
    for r in sorted(windows.collect(), key=lambda r: (r.file, r.window)):
        by.setdefault(r.file, []).append(r.energy)
    assert got == {(f, a, b) for f, es in by.items() for a, b in whole_file(es, activity.LOW, activity.HIGH, activity.SILENCE)}
    assert sum(f == "a" for f, _, _ in got) == 6


def test_files_that_are_no_wav(spark, tmp_path):
    assert audio.energies(spark, str(tmp_path)).collect() == []
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    with pytest.raises(Exception, match="no samples"):
        audio.energies(spark, str(tmp_path)).collect()
    assert audio.energies(spark, str(tmp_path)).select(F.col("stem")).schema.names == ["stem"]
