"""License scans: exact base phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words after lower-casing A-Z stay; all other ASCII bytes become spaces.
WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256))

#: Phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices that the method looks for with edits: words, label.
NOTICES = (
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd 3 clause license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("all rights reserved", "proprietary"),
)


@dataclass(frozen=True)
class Found:
    label: str
    first: int
    last: int
    edits: int
    similarity: float


class Scanner:
    """``per_edit``: characters of a notice for each edit that it may differ by."""

    def __init__(self, notices=NOTICES, per_edit: int = 10):
        self.notices = [(p, label, max(1, len(p) // per_edit)) for p, label in notices]
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (p, _, k) in enumerate(self.notices):
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                places.setdefault(p[lo:hi], []).append((n, lo))
        for seed, where in places.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()
        self.patterns, self.first = ([regex.compile(rf"(?<= ){flag}(?:{regex.escape(p)}){{e<={k}}}(?= )") for p, _, k in self.notices] for flag in ("(?b)", ""))

    def matches(self, n: int, line: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """``(start, end, edits)`` of a notice's matches from left to right; each is the best around the first place that is left.

        The best match of a whole window would skip those before it, so it is
        sought near the first match only, and then again in what precedes it.
        """
        p, _, k = self.notices[n]
        while hi - lo >= len(p) - k and (m := self.first[n].search(line, lo, hi)):
            best = self.patterns[n].search(line, m.start(), min(hi, m.end() + len(p) + k + 1)) or m
            while before := self.patterns[n].search(line, m.start(), best.start()):
                best = before
            yield best.start(), best.end(), sum(best.fuzzy_counts)
            lo = best.end()

    def around_exact(self, n: int, line: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """The same matches: those without edits are found as plain strings, the others between them."""
        p = self.notices[n][0]
        while (at := line.find(f" {p} ", max(0, lo - 1), hi + 1)) >= 0:
            yield from self.matches(n, line, lo, at + 1)
            lo = at + 1 + len(p)
            yield at + 1, lo, 0
        yield from self.matches(n, line, lo, hi)

    def windows(self, line: str) -> dict[int, list[list[int]]]:
        """For each notice, where its matches can be.

        A match with k edits leaves one of k + 1 pieces of the notice untouched,
        so each piece found marks a window that must hold the match; windows
        that touch are one.
        """
        out: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(line):
            for n, at in where:
                p, _, k = self.notices[n]
                begin = end + 1 - size - at - k - 1
                stop = begin + len(p) + 2 * k + 2
                mine = out.setdefault(n, [])
                if mine and begin <= mine[-1][1]:
                    mine[-1] = [min(mine[-1][0], begin), max(mine[-1][1], stop)]
                else:
                    mine.append([begin, stop])
        return out

    def fuzzy(self, line: str) -> list[Found]:
        """Matches in a line of words with a space between, before and after; those of a notice do not overlap."""
        out: list[Found] = []
        spaces = None
        for n, spans in self.windows(line).items():
            p, label, _ = self.notices[n]
            hits = [m for begin, stop in spans for m in self.around_exact(n, line, max(0, begin), min(len(line), stop))]
            if not hits:
                continue
            spaces = _spaces(line) if spaces is None else spaces
            starts, ends, edits = np.array(hits).T
            first, after = np.searchsorted(spaces, starts) - 1, np.searchsorted(spaces, ends)
            out += [Found(label, *x, e, 1 - e / len(p)) for *x, e in zip(first.tolist(), (after - 1).tolist(), edits.tolist())]
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[Found]]:
        """Words, places of base phrases by first word, and matches with edits."""
        words = text.translate(WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        base = []
        spaces = None
        for phrase, label in BASE:
            starts, at = [], line.find(f" {phrase} ")
            while at >= 0:
                starts.append(at)
                at = line.find(f" {phrase} ", at + 1)
            if starts:
                spaces = _spaces(line) if spaces is None else spaces
                base += [(label, i) for i in np.searchsorted(spaces, starts).tolist()]
        return len(words), base, self.fuzzy(line)


def _spaces(line: str) -> np.ndarray:
    """Where the spaces of a line are: the word after a space has the space's number."""
    return np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts, labels, score and ``spans``.

    ``n_base`` counts all places of all base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest of their starts. ``labels`` adds
    those of notices matched with edits, at word bounds. ``spans`` has
    ``label:first word-last word:edits`` of each such match, semicolon-joined.
    ``score`` is 1 with a base phrase, else the best match's share of characters
    without edit, else 0. A text is scanned whole, in time that grows with its length
    and its matches alone. A null or empty text has no words and no labels; rows
    with equal or null ids are scanned one by one; an empty table gives no rows;
    columns besides ``doc_id`` and ``text`` are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(1):
                n, base, found = scanner.scan(text.as_py())
                starts = [s for _, s in base]
                labels = {label for label, _ in base}
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x.label for x in found})))
                row += (1.0 if base else max((x.similarity for x in found), default=0.0), ";".join(f"{x.label}:{x.first}-{x.last}:{x.edits}" for x in found))
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.record_batch([b.column(0), *(pa.array(c, type=t) for c, t in zip(cols, types))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
