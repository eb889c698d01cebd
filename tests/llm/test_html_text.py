"""Blocks, the labeller's gradients, and the extracted text."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import html_text as h
from partloom.llm.html_blocks import SIZE, blocks


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return h.trained(pages)


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br|ul|li)>", inside)
    text = " ".join(html.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", p)) for p in parts)
    return " ".join(text.split())


def test_the_article_and_nothing_else(pages, weights):
    got = {r.page_id: r for r in h.main_text(pages, weights).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(article(r.html))


PROSE = (
    "This is a sentence of the main text, with words and commas. It goes on for a while, so "
    "that it looks like prose to everyone who reads it, and then it ends."
)
LAYOUT = """<html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href="/">Home</a> <a href="/b">Blog</a></header>
<div class="cookie-notice">We use cookies. Accept</div>
<div class="sidebar"><ul><li><a href="/x">Other story</a></li></ul></div>
<{tag}><h1>Title of it</h1><p>{prose} One.</p><div class="advert">Buy this now</div><p>{prose} Two.</p>
</{end}><div id="comments"><p>First! Nice post, thanks.</p></div>
<form><label>Mail</label><button>Send</button></form>
<footer>&copy; 2020 Company</footer><script>var a = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize(
    "tag, end", [("article", "article"), ("main", "main"), ('div class="post-content"', "div")]
)
def test_other_layouts(weights, tag, end):
    """Containers that the sample of pages does not have."""
    page = LAYOUT.format(tag=tag, end=end, prose=PROSE)
    found = blocks(page)
    model = h.Labeller().load(weights)
    kept = [
        b.text for b, p in zip(found, model.probabilities([h.Features().of(found)])[0]) if p >= 0.5
    ]
    assert kept == ["Title of it", f"{PROSE} One.", f"{PROSE} Two."]


def test_blocks():
    page = (
        "a<p>b <b>c</b>d<br>e&amp;f &lt;x&gt;<p>g<ul><li>h<li>i</ul><!-- no <p> --><script>x</p>"
        "</script>j < k<td title='a>b'>l\n\t m</td><div>n"
    )
    assert [b.text for b in blocks(page)] == "a|b cd|e&f <x>|g|h|i|j < k|l m|n".split("|")
    assert blocks("") == [] and blocks("<p> </p><") != []


@pytest.mark.parametrize("tag", ['<svg class="logo"/>', "<svg/>", "<object data='x' />"])
def test_self_closed_elements_swallow_nothing(tag):
    found = blocks(f"<header>{tag} Home</header><article><p>Text</p></article><svg><text>no</text></svg><p>End")
    assert [b.text for b in found] == ["Home", "Text", "End"]
    assert found[1].path == ["article", "p"]


def test_custom_elements_are_not_raw():
    page = "<template-card>a</template-card><object-list><p>b</object-list><style-x>c</style-x><style\n>no</style>d"
    assert [b.text for b in blocks(page)] == ["a", "b", "c", "d"]


def test_gradients():
    rng = np.random.default_rng(0)
    lstm = h.Lstm(rng, 5, 3)
    lstm.w, lstm.u, lstm.b = (p.astype(np.float64) for p in lstm.parameters())
    x = rng.normal(size=(4, 2, 5))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)
    target = rng.normal(size=(4, 2, 3)) * mask[:, :, None]

    def loss():
        return float((lstm.forward(x, mask)[0] * target).sum())

    trace = lstm.forward(x, mask, keep=True)[1]
    for p, g in zip(lstm.parameters(), lstm.backward(x, trace, target)):
        for at in [tuple(rng.integers(n) for n in p.shape) for _ in range(6)]:
            p[at] += 1e-3
            high = loss()
            p[at] -= 2e-3
            low = loss()
            p[at] += 1e-3
            assert (high - low) / 2e-3 == pytest.approx(g[at], rel=0.02, abs=2e-3)


def test_edges(spark, weights):
    long_page = "<article>" + "<p>word and more words here.</p>" * 20_000 + "</article>"
    rows = [
        (1, "u", None, "x"),
        (2, None, "", "x"),
        (None, "u", "<article><p>Some text in an article here.</p></article>", "x"),
        (3, "u", "<nav><a href=x>y</a></nav>", "x"),
        (4, "u", long_page, "x"),
        (4, "u", long_page, "x"),
        (5, "u", "<" * 2000 + "<p class=\"unclosed", "x"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.main_text(frame, weights).orderBy("page_id").collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == ""
    assert by_id[4].count("word and more words here.") == 20_000
    empty = frame.limit(0)
    assert len(np.frombuffer(h.trained(empty), np.float32)) == len(np.frombuffer(weights, np.float32))
    assert h.main_text(empty, weights).count() == 0
    assert frame.select(F.count("html")).first()[0] == 6
