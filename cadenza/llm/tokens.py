"""Exact, cached encoding with a public tokenizer."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np

#: The id appended to each document.
END_ID = 2
#: Words that an encoder keeps: about 170 MB.
MOST_WORDS = 1 << 20


#: The parts of a tokenizer file that make its ids word by word: NFC, white space, small letters; then runs
#: of letters, single digits and runs of other marks, none across white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(config: dict) -> bool:
    """Whether a tokenizer file is known to give a text the ids of its words in a row, whatever the case of A-Z."""
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in config.get("added_tokens") or [])
    return plain and config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == SPLITTER and not config.get("post_processor") and not config.get("truncation")


def folded(text: bytes) -> bytes:
    """``text`` with small letters where that changes no id.

    The tokenizer composes letters with combining marks before it lowers them, and
    some capitals have no composed form though their small letters have. ASCII
    letters compose only with marks of U+0300 to U+036F, whose UTF-8 begins with
    CC or CD. Names of special tokens stay too.
    """
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes UTF-8 texts exactly as the library does.

    Where the file of ``path`` is known to work word by word (``by_words``), a text
    is its words' ids in a row, and each word is encoded once until the cache of
    ``most_words`` is full and starts anew. With any other file the library gets
    whole texts.
    """

    def __init__(self, path: str, end_id: int = END_ID, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most_words = Tokenizer.from_file(path), end_id, most_words
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = defaultdict(count().__next__)
        self.known = 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self) -> None:
        """Encode the words that have a place but no ids yet."""
        n, more = self.known, len(self.place) - self.known
        words = [w.decode() for w in islice(reversed(self.place), more)][::-1]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=more)
        total = int(lengths.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + more + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=total)
        self.starts[n + 1 : n + 1 + more] = self.used + np.cumsum(lengths)
        self.used += total
        self.known += more

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a text and the end id, as uint32."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text; words that are new are encoded in one call."""
        if not self.by_words:
            got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return (np.array([*e.ids, self.end_id], dtype=np.uint32) for e in got)
        if self.known > self.most_words:
            self._clear()
        found = []
        for t in texts:
            words = folded(t).split()
            found.append(np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words)))
        if len(self.place) > self.known:
            self._learn()
        return map(self._gather, found)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(at) else 0
        out = np.empty(total + 1, dtype=np.uint32)
        out[:total] = self.flat[np.repeat(first - (ends - n), n) + np.arange(total)]
        out[total] = self.end_id
        return out


@lru_cache(maxsize=1)
def shared_encoder(path: str, end_id: int = END_ID, most_words: int = MOST_WORDS) -> Encoder:
    """The encoder of a Python worker, which keeps its words from task to task."""
    return Encoder(path, end_id, most_words)


def encoded(encoder: Encoder, batch, at_once: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of the rows of an Arrow batch of ids and UTF-8 texts, by about ``at_once`` bytes of text."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= at_once:
            yield from zip(ids, encoder.encode_all(texts))
            ids, texts, size = [], [], 0
    yield from zip(ids, encoder.encode_all(texts))
