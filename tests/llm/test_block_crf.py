import html.parser
import itertools
import re
import time

import numpy as np
import pytest

from tailglass.llm.block_crf import Crf, extract, fit, likelihood, main_text, trained
from tailglass.llm.labelled_pages import LABELS, labelled
from tailglass.llm.page_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<p>d<br>e</p>f<div>g</div>") == ["a b c", "d e", "f", "g"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert texts("<script>if (a<b) '<p>x</p>'</script>y<!-- <p>z -->w<style>q") == ["yw"]
    assert texts("&eacute;&amp;lt;&nbsp;&#x41; <a title='>'>k</a> 1 < 2 &unknown;") == ["é&lt; A k 1 < 2 &unknown;"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert texts(None) == texts("") == texts(" <p> </p> ") == [] and texts("<<p>") == ["<"]
    assert texts("<p>unclosed <a href='x'") == ["unclosed <a href='x'"]
    path = blocks('<div class="Post-Body x" ID=main><p hidden>t</p></div>')[0].path
    assert path == (("div", ("post", "body", "x", "main")), ("p", ("hidden",)))
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1
    # closed and unclosed elements without text of their own; content that is text; quotes anywhere in a tag
    assert texts("<p>a<svg/>b</p><p>c</p>") == ["ab", "c"] and texts("<p>a<svg>b</p><p>c") == ["a", "c"] and texts("a<script>x<p>") == ["a"]
    # a drawing holds drawings and ends with its own end tag; one without an end ends where the page goes on
    assert texts("<p>a<svg><svg>i</svg>x</svg>b</p>") == ["ab"] and texts("<p>a<svg>icon<div>c") == ["a", "c"] and texts("a<svg>icon") == ["a"]
    # a comment ends with --!> too, but not at once
    assert texts("<p>a<!-- b --!>c</p><p>d</p>") == ["ac", "d"] and texts("a<!--!>b-->c") == ["ac"] and texts("a<!--x--!>b-->c") == ["ab-->c"]
    assert texts('<script src="a"/>b<p>c') == ["b", "c"] and texts("<script/>a</script>b<style/>c") == ["bc"]
    assert texts("<math>x+1</math> <object>alt</object><textarea>t<b></textarea>") == ["x+1 alt", "t<b>"]
    assert texts("<p title=it's>hello") == texts("<p 'x\" y>hello") == texts("<p a='>' b=\"'>\" c>hello") == ["hello"]
    assert [t for t, _ in blocks("<div data-u=/x/><p>in</p></div>")[0].path] == ["div", "p"] and not blocks("<div class=x />t")[0].path
    assert texts("<p>a</>b<!-->c--><!--d-->e</ p>") == ["abc-->e"]


@pytest.mark.parametrize("piece", ["<p title=it's>hello ", '<p a=" ', "<svg>", "<p ", "<!-- ", "</ ", "<textarea>", "<!--x", "<svg><svg></svg>", "<div>a", "<p 'x' \"y> ", "</b>", "<li>"])
def test_a_long_page_takes_linear_time(piece):
    def seconds(size):
        start = time.process_time()
        for tail in ("", "'>", '">'):
            blocks(piece * (size // len(piece)) + tail)
        return time.process_time() - start

    assert seconds(1 << 20) < 12 * max(0.5, seconds(1 << 17))


class Reader(html.parser.HTMLParser):
    """Another reading of well-formed pages, by the standard library: text between tags that are not inline."""

    def __init__(self):
        super().__init__()
        self.found, self.here = [], []

    def end(self):
        self.found += [x] if (x := " ".join("".join(self.here).split())) else []
        self.here = []

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.here.append(" ")
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "img"):
            self.end()

    def handle_endtag(self, tag):
        self.handle_starttag(tag, [])

    def handle_data(self, data):
        self.here.append(data)


def test_gradient_and_decoding():
    rng = np.random.default_rng(0)
    k, n, sizes = len(LABELS), 5, np.array([3, 1, 4])
    page_of, place = np.repeat(np.arange(3), sizes), np.concatenate([np.arange(s) for s in sizes])
    flat, begins, truth = rng.integers(0, n, 16), np.arange(0, 16, 2), rng.integers(0, k, 8)
    w = rng.normal(size=n * k + k * k + 2 * k)
    args = (n, flat, begins, page_of, place, truth, sizes)
    worth, up = likelihood(w, *args)
    for i in range(0, len(w), 3):
        e = np.zeros_like(w)
        e[i] = 1e-5
        assert abs((likelihood(w + e, *args)[0] - likelihood(w - e, *args)[0]) / 2e-5 - up[i]) < 1e-5
    assert worth < 0
    model = fit(labelled(20), 5)
    pages = [p[:5] for p, _ in labelled(12, 9)]
    for page, got in zip(pages, model.decode(pages), strict=True):
        s = model.scores([page])
        value = lambda y: model.start[y[0]] + model.stop[y[-1]] + sum(s[i, c] for i, c in enumerate(y)) + sum(model.step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert abs(value(got) - max(map(value, itertools.product(range(k), repeat=len(page))))) < 1e-9


def test_held_out_pages():
    model, right, every = trained(), 0, 0
    for (page, labels), got in zip(test := labelled(200, 5), model.decode([p for p, _ in test]), strict=True):
        right += ((np.array(labels) == 0) == (got == 0)).sum()
        every += len(page)
    assert right / every > 0.99 and isinstance(model, Crf)


PAGE = """<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies. <button>OK</button></div><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id="sidebar"><h3>Related</h3><ul><li><a href=/a>A story</a></li></ul></div>
<article><h1>A  head</h1><p>One &amp; two,\n three.</p><div class="ad">Buy now.</div><p>Four<br>five.</p><section id="comments"><div class="comment"><p>I liked this.</p></div></section></article>
<form><label>Search</label><input></form><footer>&copy; 2024 Site</footer>"""


def test_extract(spark, sf_dir):
    made = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", "just some words here.", 0), (3, "w", "<p>x", 0)], "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extract(made).collect()]
    main = "A head\nOne & two, three.\nFour five."
    assert got[:4] == [(1, "u", main, len(main)), (2, None, "", 0), (None, "v", "", 0), (3, "w", "just some words here.", 21)]
    assert extract(made.limit(0)).count() == 0


def test_pages_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    for r in frame.collect():
        reader = Reader()
        reader.feed(re.search("<article>(.*?)</article>", r.html, re.S)[0])
        reader.end()
        assert got[r.page_id] == "\n".join(reader.found)


@pytest.mark.parametrize("n", [0, 1])
def test_few_pages(n):
    assert main_text([None] * n, trained()) == [("", 0)] * n
