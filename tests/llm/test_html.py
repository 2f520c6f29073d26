import html
import itertools
import math
import re

import numpy as np
import pytest

from tabeval.llm import html_pages, page_text
from tabeval.llm.queries import op4_html


@pytest.fixture(scope="module")
def model():
    return page_text.train()


def test_messages_give_the_marginals_of_the_tree():
    """Against the sum over all states of a small tree."""
    pick = np.random.default_rng(5)
    parent, kinds = [-1, 0, 0, 1, 1, 3], [2, 2, 1, 0, 2, 0]
    own, edges = pick.normal(size=6).tolist(), pick.normal(size=(3, 2, 2))
    weight = np.zeros((6, 2))
    for state in itertools.product((0, 1), repeat=6):
        s = sum(own[i] * state[i] for i in range(6)) + sum(edges[kinds[i], state[parent[i]], state[i]] for i in range(1, 6))
        for i in range(6):
            weight[i, state[i]] += math.exp(s)
    got, _ = page_text.sum_product(parent, kinds, own, edges)
    assert np.allclose(got, weight[:, 1] / weight.sum(axis=1))


def test_unseen_labelled_pages(model):
    right = total = 0
    for source in html_pages.pages(30, seed=123):
        page = page_text.read(source, labelled=True)
        y = page_text.labels(page)
        p, _ = page_text.sum_product(page.parent, [page_text.kind(page, i) for i in range(len(y))], model.own(page), model.edges)
        for i, tag in enumerate(page.tag):
            if not tag and page.text[i].strip():
                total, right = total + 1, right + ((p[i] >= 0.5) == (y[i] == 1))
    assert right / total > 0.93


def test_a_page_with_everything_around_its_article(model):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie notice"><p>We use cookies here.</p></div><div class="ad">Buy now.</div>
    <article><h1>Cats &amp; dogs</h1><p>First <b>bold</b>ly\n said&nbsp;it.<p>Second paragraph &#233;t&eacute; is here.<br>And a line.
    <ul><li>One item of it.</li><li>Two items of it.</li></ul></article>
    <aside><p>Other stories of the week.</p></aside>
    <section id="comments"><div class="comment"><p>I liked this one a lot.</p></div></section>
    <form><input><button>Send</button></form><footer>&copy; somebody</footer>"""
    assert page_text.main_text(page, model) == (
        "Cats & dogs First boldly said it. Second paragraph été is here. And a line. One item of it. Two items of it.")


@pytest.mark.parametrize(("start", "end"), [
    ("<table><tr><td data-label=\"Price\">", "</td></tr></table>"), ("<p class=o'neil>", ""), ("<p title='x>", ""), ('<p title="x>', ""),
    ("<p title = 'a > b'>", ""), ("<p data-x='1' y>", "</p>"), ('<p a="<b>" title=\'"\'>', ""), ("<p ' \" >", "")])
def test_markup_is_no_text(start, end, model):
    """Attributes of any form: labels that aren't numbers, quotes inside values, quotes that are never closed."""
    page = f"<article><p>The first of many words is here.</p>{start}Second part of the words is here.{end}</article>"
    assert page_text.main_text(page, model) == "The first of many words is here. Second part of the words is here."


@pytest.mark.parametrize("source", [None, "", "plain text only", "<p>", "</div></p></x>", "<" * 1000, "<div>" * 3000 + "x" + "</div>" * 10,
                                    "<!-- open", "<script>never closed", "a < b > c & d", "<p " + "a=" * 2000, "\x00<p>\ud800</p>"])
def test_broken_pages(source, model):
    assert isinstance(page_text.main_text(source, model), str)


def test_awkward_rows(spark, model):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<article><p>Some words of an article.</p></article>", "x"),
            (2, "u", "<article><p>Some words of an article.</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text_ string")
    got = page_text.extract(df, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 25), (2, 25)]
    assert page_text.extract(df.where("false"), model).count() == 0


def test_query_keeps_the_article_of_every_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|br)>", "\n", inside))
        assert r.text == " ".join(html.unescape(inside).split()) and r.n_chars == len(r.text)
