import hashlib
from zlib import crc32

import numpy as np
from cadenza.llm import media
from pyspark.sql import Row
from pyspark.sql import functions as F

TEXTS = [None, "", "a", "x" * 576, "x" * 577, "é" * 400, "same text", "same text", "".join(chr(32 + i * i % 90) for i in range(200_000))]


def frame(spark):
    return spark.createDataFrame([Row(doc_id=None if i == 2 else i, text=t, feature=1, row="x") for i, t in enumerate(TEXTS)], "doc_id long, text string, feature int, row string")


def test_figures(spark):
    got = {(r.n_bytes, r.doc_id): r for r in media.media(frame(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        r = got[(len(raw), None if i == 2 else i)]
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), crc32(want[-32:]))
        stored = b"P5\n24 %d\n255\n" % (len(want) // 24) + want
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    same = [r for r in got.values() if r.n_bytes == 9]
    assert same[0].feature == same[1].feature


def test_gear_hash_rolls():
    data = bytes(np.random.default_rng(3).integers(0, 256, 1000, dtype=np.uint8))
    h, want = 0, []
    for b in data:
        h = (2 * h + int(media.gear()[b])) % 2**32
        want.append(h)
    assert media.gear_hash(data).tolist() == want
    assert media.gear_hash(data[:5]).tolist() == want[:5]


def test_cuts_follow_content():
    data = bytes(np.random.default_rng(4).integers(0, 256, 200_000, dtype=np.uint8))
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and (sizes[:-1] >= media.LEAST).all() and (sizes <= media.MOST).all()
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"some bytes in front" + data
    ends = media.cuts(moved)
    assert len(chunks & {moved[a:b] for a, b in zip([0, *ends], ends)}) > 0.9 * len(chunks)


def test_chunks_are_stored_once(spark):
    docs = frame(spark).repartition(4)
    manifests, chunks = media.store(docs.union(docs))
    digests = {bytes(d) for r in manifests.collect() for d in r.digests}
    assert media.index(chunks).count() == len(digests)


def test_damage_is_seen(spark):
    manifests, chunks = media.store(frame(spark))
    other = chunks.withColumn("offset", F.lit(0).cast("long"))
    try:
        media.rebuild(manifests, media.index(other)).collect()
    except Exception as e:
        assert "do not give its media" in str(e) or "decompress" in str(e)
    else:
        raise AssertionError


def test_empty_table(spark):
    assert media.media(frame(spark).limit(0)).collect() == []


def test_feature_by_loops():
    import math

    data = bytes((i * i) % 251 for i in range(576 * 3))
    n, w = len(data), media.WIDTH
    mean = sum(data) / n
    sd = math.sqrt(sum((b - mean) ** 2 for b in data) / n)
    entropy = -sum(data.count(v) / n * math.log2(data.count(v) / n) for v in set(data))
    across = [abs(data[i] - data[i + 1]) for i in range(n - 1) if i % w < w - 1]
    down = [abs(data[i] - data[i + w]) for i in range(n - w)]
    want = f"mean={mean:.4f};sd={sd:.4f};entropy={entropy:.4f};across={sum(across) / len(across):.4f};down={sum(down) / len(down):.4f}"
    assert media.feature(data) == want


def test_neighbours_come_with_one_read(tmp_path):
    path = tmp_path / "x.pack"
    frames = [media.compressor(3).compress(bytes([i]) * 50) for i in range(100)]
    path.write_bytes(b"".join(frames))
    ends = np.cumsum([len(f) for f in frames])
    places = {("file:///", str(path), int(e) - len(f), len(f)) for e, f in zip(ends, frames)}
    packs = media.Packs()
    found = packs.chunks(places)
    assert packs.reads == 1 and sorted(found.values()) == [bytes([i]) * 50 for i in range(100)]


def test_reclaim_leaves_only_live_chunks(spark):
    """Copies of other tasks and files of failed ones go; every document comes back from what is left."""
    from pyarrow import fs

    docs = frame(spark).repartition(4)
    uri = media.new_path(spark, "test-packs")
    manifests, chunks = media.store(docs.union(docs), uri)
    store, root = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(f"{root}/failed.pack") as out:
        out.write(b"left by a task that failed")
    size = lambda: sum(f.size for f in store.get_file_info(fs.FileSelector(root)))
    before, want = size(), sorted(map(str, media.rebuild(manifests, media.index(chunks)).collect()))
    new = media.reclaim(media.index(chunks), uri)
    stored = sum(r.place.stored for r in new.collect())
    assert size() == stored < before
    assert sorted(map(str, media.rebuild(manifests, new).collect())) == want
