"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

#: Elements without an end tag, and those whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Inline elements: a tag of any other element ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that starts closes an open one of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {k: {"p"} for k in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: An end tag or start tag does not close elements beyond these.
SCOPE = frozenset("html body article section main div td th table ul ol dl blockquote aside nav header footer form".split())

#: Kinds of element that hold no article text: menus, footers, sidebars, forms, scripts, styles and what is not text.
SKIP_TAGS = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg canvas object dialog menu map audio video".split())
ARTICLE = frozenset(("article", "main"))
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none""")
#: Names in class, id or role of the kinds of text that an article is without.
NAMED = frozenset(
    """menu menus nav navbar navigation header footer sidebar notice notices cookie cookies consent ad ads advert adverts advertisement advertisements sponsored promo promotion promotions form
    comment comments reply replies discussion discussions""".split()
)
#: Blocks of running text, and of lists and tables: the element around them is what they are part of.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th ul ol dl table thead tbody tfoot tr header hgroup figure".split())
PUNCTUATION = ".,;:!?¡¿。、，！？"
#: Weights of a path and its neighbours in page order.
KERNEL = np.array([0.05, 0.9, 0.05])
#: Factor of a path through an element with a name of NAMED.
BY_NAME = 1 / 16
#: What a path's own blocks count for in its score, against the best element around them.
OWN = 0.25
#: A path is content if its score is this share of the page's best, and this much.
SHARE, LEAST = 0.72, 0.6


@dataclass(slots=True)
class Leaf:
    """A text node: number of the tag path down to its block, decoded text, whether a block begins with it, and whether it is in a link."""

    path: int
    text: str
    begins: bool
    linked: bool


class Paths:
    """The tag paths of a page as a tree: each has its parent and a last step, so that a path costs the same at any depth.

    A parent has a smaller number than its children; 0 is the empty path.
    """

    def __init__(self):
        self.parent, self.step, self.known = [0], [""], {}

    def child(self, parent: int, step: str) -> int:
        if (parent, step) not in self.known:
            self.known[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
        return self.known[parent, step]

    def tag(self, path: int) -> str:
        return self.step[path].partition(".")[0]

    def factors(self) -> list[float]:
        """What the names of each path's elements say of its text.

        A name counts by the share of its words, inside an article only as a whole, and
        headers are the article's own there.
        """
        out, inside = [1.0], [False]
        for path in range(1, len(self.parent)):
            above = self.parent[path]
            tag, *names = self.step[path].split(".")
            factor, within = out[above], inside[above]
            if tag not in ("html", "body"):
                if within:
                    share = float(any(named(n) == 1 and n.lower() != "header" for n in names))
                else:
                    share = sum(map(named, names)) / max(len(names), 1)
                within = within or tag in ARTICLE
                factor *= BY_NAME**share
            out.append(factor)
            inside.append(within)
        return out

    def whole(self, sums: dict[int, np.ndarray]) -> list[np.ndarray]:
        """The sums of all paths that begin with each path."""
        out = [np.zeros(4) for _ in self.parent]
        for path, x in sums.items():
            out[path] += x
        for path in range(len(out) - 1, 0, -1):
            out[self.parent[path]] += out[path]
        return out

    def around(self, value: list[float]) -> list[float | None]:
        """For each path of a block of running text, the best value of what it is part of: all elements around it
        that are no running text, up to the body, or else the body. For other paths nothing."""
        best: list[float | None] = [None]  # of the elements on a path
        body = [0]
        out: list[float | None] = [None]
        for path in range(1, len(self.parent)):
            above, tag = self.parent[path], self.tag(path)
            outer, frame = best[above], body[above]
            out.append((outer if outer is not None else value[frame]) if tag in RUNNING else None)
            if tag not in RUNNING and tag not in ("html", "body"):
                outer = value[path] if outer is None else max(outer, value[path])
            best.append(outer)
            body.append(path if tag == "body" else frame)
        return out


def step(tag: str, attributes: str) -> str:
    """An element's part of a tag path: its tag, and its class, id and role names."""
    given = [x[2] or x[3] or x[4] or "" for x in NAMES.finditer(attributes)] if "=" in attributes else []
    return ".".join([tag, *sorted({n for v in given for n in v.split()})])


def leaves(html: str, paths: Paths) -> Iterator[Leaf]:
    """Text nodes in page order, without those in elements of SKIP_TAGS, hidden ones and headers of the page."""
    names: list[str] = []
    where: dict[str, list[int]] = {}  # places of the open elements of each name
    #: Of each open element, and of none: path down to the block, in a link or not, without text or not, in an article or not.
    blocks, linked, skips, inside = [0], [False], [False], [False]
    begins, at, end = True, 0, len(html)

    def text(lo: int, hi: int) -> Iterator[Leaf]:
        nonlocal begins
        if hi > lo and not skips[-1] and (s := unescape(html[lo:hi]) if html.find("&", lo, hi) >= 0 else html[lo:hi]):
            yield Leaf(blocks[-1], s, begins, linked[-1])
            begins = False

    def last(kinds: set[str] | frozenset[str]) -> int:
        return max((where[k][-1] for k in kinds if where.get(k)), default=-1)

    def close(kinds: set[str] | frozenset[str], bound: frozenset[str]) -> None:
        """Close the last open element of a kind and all in it, unless one of ``bound`` is open in it."""
        i = last(kinds)
        if i >= 0 and i >= last(bound):
            for name in names[i:]:
                where[name].pop()
            del names[i:], blocks[i + 1 :], linked[i + 1 :], skips[i + 1 :], inside[i + 1 :]

    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            yield from text(at, end)
            return
        yield from text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            begins = True
        if m[1] or m[4]:
            close({tag}, SCOPE - {tag} if tag in CLOSES or tag in INLINE else frozenset(("html", "body")) - {tag})
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not attributes.rstrip().endswith("/"):
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - CLOSES[tag])
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        where.setdefault(tag, []).append(len(names))
        names.append(tag)
        skips.append(skips[-1] or tag in SKIP_TAGS or (tag == "header" and not inside[-1]) or bool(HIDDEN.search(attributes)))
        inside.append(inside[-1] or tag in ARTICLE)
        if tag in INLINE:
            blocks.append(blocks[-1])
            linked.append(linked[-1] or tag == "a")
        else:
            blocks.append(paths.child(blocks[-1], step(tag, attributes)))
            linked.append(False)


@lru_cache(maxsize=1 << 14)
def named(name: str) -> float:
    """How far a class, id or role names something of NAMED: the share of its words."""
    words = [w.lower() for w in re.split(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])", name) if w]
    return 1.0 if "".join(words) in NAMED else sum(w in NAMED for w in words) / max(len(words), 1)


def path_sums(nodes: list[Leaf]) -> dict[int, np.ndarray]:
    """Characters, punctuation marks, blocks and linked characters of each tag path with text, in page order."""
    sums: dict[int, np.ndarray] = {}
    blank = False  # a block began with white space
    for x in nodes:
        blank = x.begins or blank
        if n := len("".join(x.text.split())):
            sums.setdefault(x.path, np.zeros(4))
            sums[x.path] += (n, sum(map(x.text.count, PUNCTUATION)), blank, n if x.linked else 0)
            blank = False
    for v in sums.values():
        v[2] = max(v[2], 1)
    return sums


def path_scores(nodes: list[Leaf], paths: Paths) -> dict[int, float]:
    """The score of each tag path.

    Characters and punctuation marks per block are smoothed over the paths in page
    order and fused as logarithms with the characters of the path in all. The same of all text in the best element around
    it counts too: titles and short paragraphs have paths of their own. Times
    the factor of its elements, and next to nothing where nearly all text is links, it is the path's.
    """
    sums = path_sums(nodes)
    if not sums:
        return {}
    chars, marks, blocks, linked = np.array(list(sums.values())).T
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), KERNEL, mode="valid")
    own = np.log1p(smooth(chars / blocks)) + np.log1p(smooth(marks / blocks)) + np.log1p(chars)
    total = np.array(paths.whole(sums))
    each = np.maximum(total[:, 2], 1)
    around = paths.around((np.log1p(total[:, 0] / each) + np.log1p(total[:, 1] / each) + np.log1p(total[:, 0])).tolist())
    factors = paths.factors()
    out = {}
    for path, x, unlinked in zip(sums, own.tolist(), (1 - (linked / chars) ** 4).tolist()):
        best = x if around[path] is None else around[path]
        out[path] = (OWN * x + (1 - OWN) * best) * unlinked * factors[path]
    return out


def content(nodes: list[Leaf], paths: Paths) -> list[bool]:
    """Which nodes are content: those whose path's score is SHARE of the best, and LEAST."""
    scores = path_scores(nodes, paths)
    least = max(LEAST, SHARE * max(scores.values(), default=0))
    return [scores.get(x.path, 0.0) >= least for x in nodes]


def extract(html: str) -> str:
    """The article's blocks in page order, with single spaces."""
    paths = Paths()
    nodes = list(leaves(html, paths))
    out: list[str] = []
    for x, keep in zip(nodes, content(nodes, paths)):
        if x.begins:
            out.append(" ")
        if keep:
            out.append(x.text)
        elif not x.text.isspace():
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row of ``pages``.

    Null, empty and text-free pages give an empty text. Unclosed and cut-off
    markup is read as far as it goes. Rows with equal or null ids are read one by
    one; an empty table gives no rows; columns besides ``page_id, url, html`` are
    ignored. Nothing is shuffled, and a page of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
