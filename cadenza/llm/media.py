"""Media columns: content-defined chunks, a deduplicated chunk store, verified reconstruction."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressor, decompressor, materialize, new_path, wide

#: Payloads are padded to a multiple of BLOCK samples and stored as rows of WIDTH 8-bit grey samples.
BLOCK, WIDTH, PAD = 576, 24, b"\xff"
#: Chunk sizes in bytes: least, most, and the bits of the hash that are zero at a cut (2048 bytes on average).
LEAST, MOST, CUT_BITS = 512, 16384, 11
#: Bytes of media put together at once; bytes between chunks that one read goes over, and that it may span.
GROUP_BYTES, GAP, RANGE = 16 << 20, 1 << 14, 4 << 20
#: Bytes that a gear hash of 32 bits depends on.
REACH = 32


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 pseudo-random words, made by a rule: the first four bytes of SHA-256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def gear_hash(data: bytes) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[data[i]] mod 2^32, for all i at once by doubling the reach."""
    h = gear()[np.frombuffer(data, dtype=np.uint8)]
    reach = 1
    while reach < REACH:
        h[reach:] += h[:-reach] << np.uint32(reach) if reach < len(h) else 0
        reach *= 2
    return h


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks: after a byte whose top hash bits are zero, ``least`` to ``most`` bytes apart."""
    marks = np.flatnonzero(gear_hash(data) >> np.uint32(32 - bits) == 0) + 1 if len(data) > least else []
    out, at = [], 0
    while len(data) - at > least:
        k = np.searchsorted(marks, at + least)
        end = int(marks[k]) if k < len(marks) else len(data)
        at = min(end, at + most, len(data))
        out.append(at)
    if at < len(data):
        out.append(len(data))
    return out


def payload(text: bytes) -> bytes:
    """The text padded to a positive multiple of BLOCK bytes."""
    return text + PAD * (BLOCK - len(text) if not text else -len(text) % BLOCK)


def to_media(samples: bytes) -> bytes:
    """A binary grey map: a lossless image of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def from_media(media: bytes) -> bytes:
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit grey map")
    return samples


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours in a row and in a column."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    image = x.reshape(-1, WIDTH).astype(np.int16)
    across, down = (float(np.abs(np.diff(image, axis=a)).mean()) for a in (1, 0))
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};across={across:.4f};down={down:.4f}"


def store(docs: DataFrame, uri: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the media of ``docs`` as chunks; returns manifests and chunk copies.

    A manifest row has ``row, doc_id, n_bytes, media_bytes, media_sha256`` and the
    ordered chunk ``digests``. A task writes each chunk that is new to it once,
    compressed, to a pack file of its own in the shared folder, and names the
    place in ``chunks`` (``digest, file, offset, stored``). A task that is run
    again writes another file; only the files that the tables name count.
    """
    spark = docs.sparkSession
    uri = uri or new_path(spark, "media-packs")
    base, root = fs.FileSystem.from_uri(uri)
    base.create_dir(root, recursive=True)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.struct([("digest", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("stored", pa.int64())]))]
    names = ["row", "doc_id", "n_bytes", "media_bytes", "media_sha256", "digests", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pack, (disk, root) = TaskContext.get(), compressor(3), fs.FileSystem.from_uri(uri)
        path = posixpath.join(root, f"{task.partitionId():06d}-{task.taskAttemptId()}.pack")
        out, at, seen, number = None, 0, set(), task.partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                media = to_media(payload(text))
                digests, new, begin = [], [], 0
                for end in cuts(media):
                    piece = media[begin:end]
                    digests.append(hashlib.sha256(piece).digest())
                    if digests[-1] not in seen:
                        seen.add(digests[-1])
                        out = out or disk.open_output_stream(path)
                        out.write(frame := pack.compress(piece))
                        new.append((digests[-1], path, at, len(frame)))
                        at += len(frame)
                    begin = end
                row = (number, doc_id, len(text), len(media), hashlib.sha256(media).digest(), digests, [dict(zip(("digest", "file", "offset", "stored"), x)) for x in new])
                number += 1
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.record_batch([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    written = rows.mapInArrow(run, f"row long, doc_id long, n_bytes long, media_bytes long, media_sha256 binary, digests array<binary>, chunks array<struct<digest:binary,file:string,offset:bigint,stored:bigint>>")
    written = materialize(written, "media-manifests")
    return written.drop("chunks"), written.select(F.inline("chunks")).withColumn("uri", F.lit(uri))


def index(chunks: DataFrame) -> DataFrame:
    """One place for each digest: the copies of the same chunk in other packs are left to be reclaimed."""
    return chunks.groupBy("digest").agg(F.min(F.struct("file", "offset", "stored", "uri")).alias("place"))


#: A chunk's place: folder, file, first byte, bytes.
Place = tuple[str, str, int, int]


def _place(ref: dict) -> Place:
    return ref["uri"], ref["file"], ref["offset"], ref["stored"]


def _groups(b: pa.RecordBatch, most: int) -> Iterator[list[dict]]:
    """Rows of a batch by about ``most`` bytes of media."""
    held, size = [], 0
    for i in range(b.num_rows):
        held.append(b.slice(i, 1).to_pylist()[0])
        size += held[-1]["media_bytes"]
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Packs:
    """Reads chunks from pack files in order of their places; neighbours come with one read."""

    def __init__(self):
        self.stores: dict[str, fs.FileSystem] = {}
        self.reads = 0

    def frames(self, places: set[Place]) -> Iterator[tuple[Place, bytes]]:
        """The stored bytes of places, file by file."""
        for (uri, file), mine in groupby(sorted(places), key=lambda p: p[:2]):
            if uri not in self.stores:
                self.stores[uri] = fs.FileSystem.from_uri(uri)[0]
            with self.stores[uri].open_input_file(file) as source:
                near: list[Place] = []
                for p in [*mine, None]:
                    if near and (p is None or p[2] - near[-1][2] - near[-1][3] > GAP or p[2] - near[0][2] > RANGE):
                        first = near[0][2]
                        data = source.read_at(near[-1][2] + near[-1][3] - first, first)
                        self.reads += 1
                        yield from ((q, data[q[2] - first : q[2] - first + q[3]]) for q in near)
                        near = []
                    near.append(p)

    def chunks(self, places: set[Place]) -> dict[Place, bytes]:
        unpack = decompressor()
        return {p: unpack.decompress(frame) for p, frame in self.frames(places)}


def rebuild(manifests: DataFrame, places: DataFrame) -> DataFrame:
    """Read every row's chunks in order, check the whole against ``media_sha256``, and compute features.

    Chunk lists join the index on the digest; a row's places come together with
    their ordinals. Bytes are read where they are used, for about GROUP_BYTES of media
    at once in order of their places, so that chunks that lie together are one read.
    """
    refs = manifests.select("row", F.posexplode("digests").alias("pos", "digest")).join(places, "digest")
    lists = refs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "place.file", "place.offset", "place.stored", "place.uri"))).alias("refs"))
    rows = manifests.select("row", "doc_id", "n_bytes", "media_bytes", "media_sha256").join(lists, "row")
    # rows are numbered as they were written: neighbours share packs
    rows = rows.repartition(wide(manifests.sparkSession), F.shiftright("row", 12)).sortWithinPartitions("row")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs()
        for b in batches:
            for group in _groups(b, GROUP_BYTES):
                found = packs.chunks({_place(ref) for r in group for ref in r["refs"]})
                cols: list[list] = [[] for _ in names]
                for r in group:
                    media = b"".join([found[_place(ref)] for ref in r["refs"]])
                    digest = hashlib.sha256(media)
                    if digest.digest() != r["media_sha256"] or len(media) != r["media_bytes"]:
                        raise ValueError(f"the stored chunks of document {r['doc_id']} do not give its media")
                    samples = from_media(media)
                    row = (r["doc_id"], r["n_bytes"], len(samples), hashlib.sha256(samples).hexdigest(), crc32(samples[-32:]), len(media), digest.hexdigest(), feature(samples), len(r["refs"]))
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.record_batch([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long")


def reclaim(places: DataFrame, uri: str) -> DataFrame:
    """Rewrite the packs in the folder ``uri`` with the chunks of the index ``places`` alone; returns the new index.

    Copies that other tasks wrote, and the files of tasks that failed, go once the new
    index is written. Each task copies the live chunks of some files, in order.
    """
    spark = places.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packs, (disk, root) = TaskContext.get(), Packs(), fs.FileSystem.from_uri(uri)
        path = posixpath.join(root, f"live-{task.partitionId():06d}-{task.taskAttemptId()}.pack")
        out, at = None, 0
        for b in batches:
            rows = {_place(r): r["digest"] for r in b.to_pylist()}
            made = []
            for place, frame in packs.frames(set(rows)):
                out = out or disk.open_output_stream(path)
                out.write(frame)
                made.append((rows[place], path, at, len(frame), uri))
                at += len(frame)
            yield pa.record_batch([pa.array(c, type=k) for c, k in zip(zip(*made) if made else [()] * 5, (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "file", "offset", "stored", "uri"])
        if out:
            out.close()

    flat = places.select("digest", "place.file", "place.offset", "place.stored", "place.uri").repartition(wide(spark), "file").sortWithinPartitions("file", "offset")
    new = materialize(flat.mapInArrow(run, "digest binary, file string, offset long, stored long, uri string").groupBy("digest").agg(F.min(F.struct("file", "offset", "stored", "uri")).alias("place")), "media-index")
    live = {r.file for r in new.select("place.file").distinct().collect()}
    store, root = fs.FileSystem.from_uri(uri)
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.path not in live:
            store.delete_file(f.path)
    return new


def media(docs: DataFrame) -> DataFrame:
    """Store ``docs`` as deduplicated media and return each document's figures from the stored bytes.

    A null or empty text is one block of padding. Long texts are many chunks, put together one document at a time,
    short ones a single one. Equal texts share all chunks and give equal values;
    rows with equal or null ids are stored one by one. An empty table gives no
    rows. Columns besides ``doc_id`` and ``text`` are ignored.
    """
    manifests, chunks = store(docs)
    return rebuild(manifests, materialize(index(chunks), "media-index"))
