"""Sorted runs of byte strings: front coding, and merging that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .common import compressor, decompressor

#: A record of a run: bytes shared with the record before it, string, and what travels along.
Item = tuple[int, bytes, tuple[int, ...]]

WIDEST = 255
#: Strings of a run that are compressed, and read, together.
BLOCK = 512


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """For each string of a sorted list, the length of the prefix it shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) < 2:
        return out
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    width = int(sizes.max()) + 1
    if width > WIDEST:
        raise ValueError(f"strings of more than {WIDEST - 1} bytes")
    step = max(1, (1 << 23) // width)
    for lo in range(0, len(keys) - 1, step):
        part = np.array(keys[lo : lo + step + 1], dtype=f"S{width}").view(np.uint8).reshape(-1, width)
        differ = part[1:] != part[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        near = sizes[lo : lo + step + 1]
        out[lo + 1 : lo + len(part)] = np.minimum(first, np.minimum(near[1:], near[:-1]))
    return out


def encode(keys: list[bytes], shared: np.ndarray, along: np.ndarray) -> bytes:
    """Front-code a sorted run, in blocks of BLOCK strings that are compressed one by one; ``along`` has a row of int64 per string."""
    shared = shared.astype(np.uint8).copy()
    if len(keys):
        shared[0] = 0
    out = []
    for lo in range(0, len(keys), BLOCK):
        part = shared[lo : lo + BLOCK]
        rest = [k[s:] for k, s in zip(keys[lo : lo + BLOCK], part.tolist())]
        sizes = np.fromiter(map(len, rest), dtype=np.uint8, count=len(rest))
        rows = along[lo : lo + BLOCK]
        head = np.array([len(rest), rows.shape[1]], dtype=np.int64)
        out.append(compressor(1).compress(b"".join([head.tobytes(), part.tobytes(), sizes.tobytes(), np.ascontiguousarray(rows.T, dtype=np.int64).tobytes(), *rest])))
    return b"".join([np.array([len(out), *map(len, out)], dtype=np.int64).tobytes(), *out])


def decode(blob: bytes) -> Iterator[Item]:
    """The records of a run; one block of it is open at a time."""
    blocks = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, blocks, 8).tolist()
    begin, key = 8 + 8 * blocks, b""
    for length in sizes:
        raw = decompressor().decompress(blob[begin : begin + length])
        begin += length
        n, width = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        shared, rests = (np.frombuffer(raw, np.uint8, n, at + i * n).tolist() for i in range(2))
        at += 2 * n
        along = np.frombuffer(raw, np.int64, n * width, at).reshape(width, n)
        at += 8 * n * width
        for s, size, row in zip(shared, rests, zip(*along.tolist())):
            key = key[:s] + raw[at : at + size]
            at += size
            yield s, key, row


class LoserTree:
    """Merges sorted runs; equal strings come in order of what travels along.

    Every run's head knows the prefix it shares with the last string given out.
    Of two heads the one that shares more is smaller, and no byte is looked at;
    only heads that share equally much are compared, from there on, and the loser
    keeps what it shares with the winner.
    """

    def __init__(self, runs: list[Iterable[Item]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.key: list[bytes | None] = [None] * self.size
        self.shared, self.along = [0] * self.size, [()] * self.size
        for i in range(len(runs)):
            self._advance(i)
            self.shared[i] = 0
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        self.shared[i], self.key[i], self.along[i] = next(self.runs[i], (0, None, ()))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, self.loser[node] = self._play(a, b)
        return first

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads."""
        x, y = self.key[a], self.key[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        s, t = self.shared[a], self.shared[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        n = min(len(x), len(y))
        bits = (int.from_bytes(x[s:n], "big") ^ int.from_bytes(y[s:n], "big")).bit_length()
        common = n - (bits + 7) // 8
        if common < n:
            a_first = x[common] < y[common]
        elif len(x) != len(y):
            a_first = len(x) < len(y)
        else:
            a_first = self.along[a] <= self.along[b]
        if a_first:
            self.shared[b] = common
            return a, b
        self.shared[a] = common
        return b, a

    def __iter__(self) -> Iterator[Item]:
        while self.key[w := self.winner] is not None:
            yield self.shared[w], self.key[w], self.along[w]
            self._advance(w)
            node = (w + self.size) >> 1
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node >>= 1
            self.winner = w
