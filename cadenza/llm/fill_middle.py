"""Fill-in-the-middle documents, cut at code points by succinct rank and select over UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: 64-bit words of a directory block, and bytes of text after which a bit vector, or a batch that is given out, ends.
BLOCK, SPAN = 8, 1 << 22


class Boundaries:
    """A bit for each byte, set where a code point begins, with the number of set bits before each block of words."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        per_block = 8 * BLOCK
        packed = np.zeros(-(-(len(bits) + 1) // per_block) * per_block, dtype=np.uint8)
        packed[: len(bits)] = bits
        self.words = packed.view("<u8").reshape(-1, BLOCK)
        self.inside = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.inside.sum(axis=1))])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each byte place."""
        block, word, bit = at // (64 * BLOCK), at // 64 % BLOCK, (at % 64).astype(np.uint64)
        earlier = np.cumsum(self.inside[block], axis=1) - self.inside[block]
        low = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + earlier[np.arange(len(at)), word] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that ``k`` others precede; the end of the bytes if there is none."""
        total = self.before[-1]
        found = k < total
        block = np.minimum(np.searchsorted(self.before, np.where(found, k, 0), side="right") - 1, len(self.inside) - 1)
        left = np.where(found, k, 0) - self.before[block]
        upto = np.cumsum(self.inside[block], axis=1)
        word = np.argmax(upto > left[:, None], axis=1) if len(k) else np.zeros(0, dtype=np.int64)
        rows = np.arange(len(k))
        left -= upto[rows, word] - self.inside[block, word]
        value, place = self.words[block, word], np.zeros(len(k), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the bit is in the lower or the upper half of what is left of the word
            low = np.bitwise_count(value & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, place = np.where(up, left - low, left), np.where(up, place + half, place)
            value = np.where(up, value >> np.uint64(half), value)
        return np.where(found, (block * BLOCK + word) * 64 + place, self.size)


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text of a binary array, and the two cut places in code points and in bytes, ``(rows, 2)``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    n, points, places = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), 2), dtype=np.int64), np.zeros((len(texts), 2), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SPAN, side="right")) - 1)
        start = offsets[lo]
        marks = Boundaries(data[start : offsets[hi]])
        ranks = marks.rank(offsets[lo : hi + 1] - start)
        n[lo:hi] = np.diff(ranks)
        for side, h in enumerate((h1, h2)):
            points[lo:hi, side] = h[lo:hi] % (n[lo:hi] + 1)
        points[lo:hi].sort(axis=1)
        for side in (0, 1):
            # the first code point after a text's last one begins where the next text does
            places[lo:hi, side] = marks.select(ranks[:-1] + points[lo:hi, side]) - (offsets[lo:hi] - start)
        lo = hi
    return n, points, places


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The document of a form; ``a`` and ``b`` are the byte places where the middle begins and ends."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    first = PREFIX + prefix + SUFFIX + suffix if form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return first + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that a document was made of. No marker can begin in a piece, so the first after each piece ends it."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at = output.index(second, len(PREFIX))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(PREFIX) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


Derive = Callable[[list[bytes], list[str]], list[pa.Array]]


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, text: str = "text", id_col: str = "doc_id", derive: Derive = lambda outputs, forms: [pa.array(outputs, pa.binary())], derived: str = "output binary") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``; ``output`` is binary UTF-8.

    The cuts, and whether a document stays plain or puts its suffix first, follow from the SHA-256 of
    ``seed:doc_id``, so that they are the same in every run and partitioning. A batch's text bytes get one
    packed bit vector of code point starts with a directory of counts: counts between two documents give
    ``n``, and two selects the byte cuts, without decoding a text. Null texts count as empty and stay
    plain, as do texts with a marker in them. A null id is hashed as no digits. Equal rows give equal rows;
    an empty table gives none; columns besides the two are ignored. Texts of any length are taken whole.
    ``derive`` makes other columns, named by ``derived``, of the outputs and forms in the same pass.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"), *hashes)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *(c.split()[0] for c in derived.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (h1, h2, h3, h4) = batch.column(1), (batch.column(2 + i).to_numpy() for i in range(4))
            n, points, places = cuts(texts, h1, h2)
            lo, forms, outputs, held = 0, [], [], 0
            for i, value in enumerate(texts):
                raw = value.as_py()
                plain = not raw or h3[i] % 100 >= 100 - plain_percent or PREFIX in raw or SUFFIX in raw or MIDDLE in raw
                forms.append("plain" if plain else "spm" if h4[i] % 100 < spm_percent else "psm")
                outputs.append(arranged(raw, forms[-1], *places[i].tolist()))
                held += len(raw)
                if held > SPAN or i + 1 == len(texts):
                    at, alone = slice(lo, i + 1), np.array([f == "plain" for f in forms])
                    sizes = [pa.array(points[at, 0], mask=alone), pa.array(points[at, 1] - points[at, 0], mask=alone)]
                    yield pa.record_batch([batch.column(0)[at], pa.array(n[at]), pa.array(forms), *sizes, *derive(outputs, forms)], names=names)
                    lo, forms, outputs, held = i + 1, [], [], 0

    return rows.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {derived}")


def digests(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``transformed`` with digests of the output, and of the text rebuilt from it, in its place."""

    def derive(outputs: list[bytes], forms: list[str]) -> list[pa.Array]:
        back = (restored(o, f) for o, f in zip(outputs, forms))
        return [pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()) for texts in (outputs, back)]

    return transformed(docs, derive=derive, derived="output_sha256 string, restored_sha256 string", **params)


ORACLE = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
b AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM d
"""
