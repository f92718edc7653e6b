import math
import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pytest
from cadenza.llm import html_text
from cadenza.llm.html_text import extract, main_text
from pyspark.sql import Row

BODY = "<p>First, a long sentence of the article, with commas.</p><p>Then <b>bold</b>ly more: words &amp; marks; and so on.</p>"
WANT = "First, a long sentence of the article, with commas. Then boldly more: words & marks; and so on."
PAGE = "<html><head><title>T</title><style>p{x}</style><script>var t='</p>';</script></head><body>{}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><ul><li><a href='/x'>Home, sweet home.</a></li></ul></nav><article><h1>Title</h1>{BODY}</article><footer>&copy; me.</footer>", "Title " + WANT),
        (f"<header><h1>Site</h1></header><main>{BODY}</main><aside>Side, bar.</aside>", WANT),
        (f"<div class='content'><h2>Head</h2>{BODY}</div><div id='comments'><p>I, too, think so. Very much so, indeed, my friends.</p></div>", "Head " + WANT),
        (f"<div class=\"cookie-notice\">We use cookies, a lot, of all kinds, and more.</div><div>{BODY}</div><form><p>Sign, up, now.</p><input></form>", WANT),
        (f"<article>{BODY}<div class='ad'>Buy, now, all of it.</div><p>End.</p></article>", WANT + " End."),
        ("<article><h1>Only</h1></article><div class='ad'>Much, longer, advert, text, than, that.</div>", "Only"),
        ("<article><p><b>Open.<br><p>Next one.</p><p>Cut off &am", "Open. Next one. Cut off &am"),
        (f"{BODY}<!-- no --><p>x &lt; y &#233; a\n\t b</p>", WANT + " x < y é a b"),
        ("<article><p>1 < 2 and 3 > 2, yes.</p></article>", "1 < 2 and 3 > 2, yes."),
        (f"<article><header class='entry-header'><h1>Title</h1></header>{BODY}</article><section id='commentList'><article class='comment'><p>Nice, very, nice, text, of yours.</p></article></section>", "Title " + WANT),
        (f"<div class='page has-sidebar'><article>{BODY}</article><div class='sideBar'><p>More, of, this, and, that.</p></div></div>", WANT),
        (f"<div class='siteHeader'>Site, of, words.</div><div class='post'><h1>Head</h1>{BODY}</div><div hidden><p>Not, seen, by, anyone.</p></div>", "Head " + WANT),
        ("", ""),
        ("<nav>menu</nav>", ""),
    ],
)
def test_pages(body, want):
    assert extract(PAGE.replace("{}", body)) == want


def test_plain_and_deep():
    assert extract("just, words.") == "just, words."
    assert extract("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    assert extract("<a title=\"open>x</a> y.") is not None
    assert extract("<article><p>" + "long, text. " * 50000) == ("long, text. " * 50000).strip()


def brute(html):
    """For the synthetic pages: what the article element holds."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", html, re.S)[1]
    body = re.sub(r"</?(b|i|em|a|span|strong)\b[^>]*>", "", body)
    body = re.sub(r"<[^>]*(>|\Z)", " ", body)
    return " ".join(unescape(body).split())


def test_query_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        assert r.text == brute(html[r.page_id]) and r.n_chars == len(r.text)


def test_edge_rows(spark):
    df = spark.createDataFrame([Row(page_id=1, url=None, html=None, text=1), Row(page_id=None, url="u", html="", text=2), Row(page_id=1, url="u", html="<p>x, y.", text=3)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in main_text(df).collect()) == [("", 0), ("", 0), ("x, y.", 5)]
    assert main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article>{BODY}<ul><li>See the <a href='/t'>transformer</a> paper</li></ul></article>", WANT + " See the transformer paper"),
        (f"<article>{BODY}<ul><li><a href='/t'>One more</a></li><li><a href='/u'>Other text</a></li></ul></article>", WANT),
        (f"<article><section id='related-work'><h2 id='search-algorithms'>Search</h2>{BODY}</section></article>", "Search " + WANT),
        (f"<article><h2 id='legal-basis'>Basis</h2>{BODY}<p class='notice-period'>A month, or two, of notice, at least, for all of them.</p></article>", "Basis " + WANT + " A month, or two, of notice, at least, for all of them."),
        (f"<div class='content no-sidebar'><h1>Head</h1>{BODY}</div>", "Head " + WANT),
        (f"<article>{BODY}<div class='share-buttons'>Send</div><div class='sidebar'>Much, more, text, of, others, here.</div></article>", WANT),
    ],
)
def test_article_text_stays(body, want):
    assert extract(PAGE.replace("{}", body)) == want


LONG = "<p>A long paragraph of running text, with clauses, names, and numbers; it goes on for a while, as articles do, and ends here.</p><p>Another one follows, of much the same kind, though it is shorter, and it ends too.</p>"
PLAIN = " ".join(re.sub("<[^>]*>", " ", LONG).split())


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div><div>Home</div><div>About us</div><div><h2>Head</h2>{LONG}</div><div>2024 me</div></div>", f"Head {PLAIN}"),
        (f"<table><tr><td><a href='/a'>One</a></td><td><a href='/b'>Two</a></td></tr></table><div><h1>Head</h1>{LONG}</div>", f"Head {PLAIN}"),
        (f"<ul><li><a href='/a'>One link</a></li><li><a href='/b'>Other link</a></li></ul><h1>Head</h1>{LONG}<ul><li><a href='/c'>More, of it</a></li></ul>", f"Head {PLAIN}"),
        (f"<div>{LONG}<ul><li>first, second</li><li>a <a href='/c'>third</a> one</li></ul></div><span>menu</span>", f"{PLAIN} first, second a third one"),
    ],
)
def test_pages_without_article_class_or_id(body, want):
    assert extract(PAGE.replace("{}", body)) == want


class Paths(HTMLParser):
    """Blocks of well-formed pages: tag path and text, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.new = [], [], True

    def handle_starttag(self, tag, attrs):
        names = sorted({n for k, v in attrs if k in ("class", "id", "role") for n in v.split()})
        if tag in html_text.VOID:
            self.new = True
            return
        self.open.append(".".join([tag, *names]))
        self.new |= tag not in html_text.INLINE

    def handle_endtag(self, tag):
        if tag not in html_text.VOID:
            self.open.pop()
        self.new |= tag not in html_text.INLINE

    def handle_data(self, text):
        tags = [x.split(".")[0] for x in self.open]
        if set(tags) & html_text.SKIP_TAGS or ("header" in tags and not {"article", "main"} & set(tags[: tags.index("header")])) or not text.strip():
            return
        n = max((i + 1 for i, t in enumerate(tags) if t not in html_text.INLINE), default=0)
        if self.new or not self.blocks:
            self.blocks.append((tuple(self.open[:n]), []))
        self.blocks[-1][1].append((text, "a" in tags[n:]))
        self.new = False


def around(path):
    """Prefixes of a path of running text that end in other elements, up to the body; else the body."""
    tags = [x.split(".")[0] for x in path]
    if not path or tags[-1] not in html_text.RUNNING:
        return []
    outer = [path[:i] for i in range(1, len(path)) if tags[i - 1] not in html_text.RUNNING and tags[i - 1] not in ("html", "body")]
    return outer or [path[: tags.index("body") + 1 if "body" in tags else 0]]


def factor(path):
    """A sixteenth for a name of unwanted text, by the share of its words before an article."""
    out, inside = 1.0, False
    for x in path:
        tag, *names = x.split(".")
        shares = [html_text.named(n) for n in names]
        if inside:
            out *= (1 / 16) ** any(h == 1 and n.lower() != "header" for n, h in zip(names, shares))
        elif names and tag not in ("html", "body"):
            out *= (1 / 16) ** (sum(shares) / len(names))
        inside = inside or tag in ("article", "main")
    return out


def brute_paths(html):
    """Text of the blocks whose path's score is high enough; every sum is taken by looking at all blocks."""
    parser = Paths()
    parser.feed(html)
    blocks = parser.blocks
    size = lambda s: len("".join(s.split()))
    paths = list(dict.fromkeys(p for p, _ in blocks))

    def ratios(prefix, whole=False):
        mine = [ts for p, ts in blocks if (p[: len(prefix)] if whole else p) == prefix]
        texts = [x for ts in mine for x in ts]
        return sum(size(t) for t, _ in texts) / len(mine), sum(c in html_text.PUNCTUATION for t, _ in texts for c in t) / len(mine), sum(size(t) for t, a in texts if a) / max(1, sum(size(t) for t, _ in texts)), sum(size(t) for t, _ in texts)

    own = [ratios(p) for p in paths]
    score = {}
    for i, p in enumerate(paths):
        near = [own[max(i - 1, 0)], own[i], own[min(i + 1, len(paths) - 1)]]
        x = sum(math.log(1 + sum(w * r[k] for w, r in zip(html_text.KERNEL, near))) for k in (0, 1)) + math.log(1 + own[i][3])
        outside = [math.log(1 + r[0]) + math.log(1 + r[1]) + math.log(1 + r[3]) for q in around(p) for r in [ratios(q, True)]]
        score[p] = (html_text.OWN * x + (1 - html_text.OWN) * max(outside, default=x)) * (1 - own[i][2] ** 4) * factor(p)
    least = max(html_text.LEAST, html_text.SHARE * max(score.values(), default=0))
    return " ".join(" ".join("".join(t for t, _ in ts).split()) for p, ts in blocks if score[p] >= least)


WELL_FORMED = [
    f"<nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>Buy this, now.</div><article><h1>Title</h1>{BODY}{LONG}</article><footer>me</footer>",
    f"<div class='page'><div>Menu</div><div class='text'><h2>Head</h2>{LONG}<ul><li>one, <a href='/o'>two</a></li></ul></div><div id='comments'><p>Nice, very, nice.</p></div></div>",
    f"<header><p>Site name, here.</p></header><main><header><h1>Big</h1></header>{LONG}<blockquote>Said, and done.</blockquote></main><aside>Side.</aside>",
    "<p>x</p>",
    "<div><p>One, two.</p><div>three</div></div><div class='cookie-notice'>We use cookies, and more, of all kinds.</div>",
]


@pytest.mark.parametrize("body", WELL_FORMED)
def test_paths_equal_brute_force(body):
    html = f"<html><head><title>T</title></head><body>{body}</body></html>"
    assert extract(html) == brute_paths(html)


def word_f1(got, want):
    got, want = got.split(), want.split()
    return 2 * sum((Counter(got) & Counter(want)).values()) / max(1, len(got) + len(want))


def without_names(html):
    """A page whose elements tell nothing: no article or main, no class, id or role."""
    html = re.sub(r"<(/?)(article|main)\b", r"<\1div", html)
    return re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def test_ratios_decide(spark, monkeypatch):
    """On pages without telling tags or names the ratios find nearly all texts; the factors of names alone find none that keeping all does not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = [brute(h) for h in pages]
    bare = [without_names(h) for h in pages]

    def score(htmls):
        got = [extract(h) for h in htmls]
        return sum(map(word_f1, got, want)) / len(want), sum(g == w for g, w in zip(got, want))

    full, equal = score(bare)
    assert full >= 0.985 and equal >= 0.88 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "BY_NAME", 1.0)
        named, _ = score(pages)
        assert named >= 0.985, "nor are names needed where there are some"
    monkeypatch.setattr(html_text, "path_scores", lambda nodes, paths: dict(enumerate(paths.factors())))
    alone, same = score(bare)
    assert alone <= full - 0.008 and same < 0.1 * len(pages)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<main>" + LONG + "<section><h2>Sub</h2><p>ok</p></section></main>", PLAIN + " Sub ok"),
        (f"<article>{LONG}<div class='promo'>Buy two, and get one, for free.</div></article>", PLAIN),
        (f"<div>{LONG}</div><section id='discussion'><p>Nice, very, nice, text, of yours. I like it, all of it.</p></section>", PLAIN),
        (f"<div>{LONG}<div>Read more</div></div><div>About us, and all</div>", PLAIN),
    ],
)
def test_short_blocks_of_an_article_stay_and_others_go(body, want):
    assert extract(PAGE.replace("{}", body)) == want


def test_many_short_paragraphs_outweigh_a_long_notice():
    lines = [f"Line {i} of the story, and on." for i in range(20)]
    page = "<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div><div>" + "We store data of yours, for all kinds of ends, and we share it. " * 6 + "</div>"
    got = extract(PAGE.replace("{}", page))
    assert got.startswith(" ".join(lines))


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "x, y." + "</i>" * 40_000, "<i><div>" + "<b>" * 40_000 + "x, y." + "</i>" * 40_000, "<p>x, y." + "<li>" * 40_000 + "</ul>" * 40_000])
def test_unmatched_tags_take_linear_time(page):
    import time

    began = time.process_time()
    assert extract(page) == "x, y."
    assert time.process_time() - began < 10


def test_deep_pages_take_linear_time():
    """Text at every depth of thousands of open elements."""
    import time

    times = []
    for n in (2000, 20_000):
        began = time.process_time()
        got = extract("<article>" + "".join(f"<div>some words, {i}. " for i in range(n)))
        times.append(time.process_time() - began)
        assert got.startswith("some words, 0. some words, 1.") and got.endswith(f", {n - 1}.")
    assert times[1] < 60 * times[0]
