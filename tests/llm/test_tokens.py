from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from cadenza.llm import packing, token_files
from cadenza.llm.tokens import Encoder, tokenizer_path
from pyspark.sql import Row
from tokenizers import Tokenizer

TEXTS = ["Hello World, it's 2024!", None, "", " \t\n\x0b\x0c ", "école Été 東京 x y  z", "á é", "<|endoftext|> in<|startoftext|>side", "same same", "same same", "ha " * 9000, "\x1c\x85 odd\x1fspace", "ΣΑΣ İ ǅ"]


def whole(text):
    t = Tokenizer.from_file(tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def frame(spark, texts=TEXTS):
    ids = [7, 3, 3, 0, 12, 5, None, 8, 9, 1, 2, 4]
    return spark.createDataFrame([Row(doc_id=i, text=t, start="x", length="y") for i, t in zip(ids, texts)], "doc_id long, text string, start string, length string")


@pytest.mark.parametrize("most_words", [1 << 19, 4])
def test_encoder_equals_the_library(most_words):
    e = Encoder(tokenizer_path(), most_words=most_words)
    docs = [t or "" for t in TEXTS]
    import pyarrow.parquet as pq

    docs += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t in docs:
        assert e.encode(t.encode()).tolist() == whole(t)


def test_capitals_with_combining_marks():
    """A capital may have no composed form though its small letter has: the library composes first."""
    t, e = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = [f"{chr(c)}{chr(m)}x a{chr(c)}{chr(m)} {chr(c)}\u0323{chr(m)}" for c in range(65, 91) for m in range(0x300, 0x370)]
    want = [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode_all([s.encode() for s in texts])] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_another_tokenizer_gets_whole_texts(name):
    t, e = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    assert e.by_words == (name == "word_bpe_49k.json")
    texts = [x or "" for x in TEXTS]
    assert [x.tolist() for x in e.encode_all([x.encode() for x in texts])] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("shard_tokens", [token_files.SHARD_TOKENS, 20])
def test_files_round_trip(spark, shard_tokens):
    shards = token_files.write(frame(spark), length=16, shard_tokens=shard_tokens)
    got = sorted(token_files.read(shards).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in frame(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        ids = whole(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_sequences_and_masks(tmp_path):
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "x.arrow")
    w = token_files.ShardWriter(store, path, length=8, rows=3)
    ids = np.arange(30, dtype=np.uint32)
    for part in np.split(ids, [1, 5, 20]):
        w.add(part)
    w.close()
    r = token_files.ShardReader(store, path, rows=3)
    assert r.ids(11, 15).tolist() == list(range(11, 26))
    assert r.sequence(2)[0].tolist() == list(range(16, 24)) and token_files.unpacked(r.sequence(2)[1]).all()
    ids, mask = r.sequence(3)
    assert ids.tolist() == [24, 25, 26, 27, 28, 29, 0, 0] and token_files.unpacked(mask).tolist() == [True] * 6 + [False] * 2
    assert ids.base is not None and mask.base is not None and not mask.flags.owndata and mask.dtype == np.uint8, "views, not copies"


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert token_files.read(token_files.write(none)).collect() == []
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_pack_keeps_every_token_once(spark, block):
    docs = frame(spark)
    got = packing.pack(docs, most=256, block_tokens=block, with_ids=True).collect()
    expected = sorted(whole(r.text) for r in docs.collect())
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        assert crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    joined = []
    for (_, n), rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist() or (rows[0].doc_id is not None and n < sum(r.length for r in rows))
        ids = [i for r in rows for i in r.ids]
        joined += [ids] if len(ids) == n else [ids[:n], ids[n:]]
    assert sorted(joined) == expected


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 3000, 2000).tolist()
    pieces = packing.pack_block(lengths)
    cost, size = defaultdict(float), defaultdict(int)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 1024
        size[s] += n
    full = [c for s, c in cost.items() if size[s] == 4096]
    assert np.std(full) / np.mean(full) < 0.1
    assert sum(size.values()) == sum(lengths)
