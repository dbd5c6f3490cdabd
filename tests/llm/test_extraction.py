import html
import itertools
import re
import time

import numpy as np
import pytest

from seriesmend.llm import extraction as X
from seriesmend.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
PROSE = [
    "A first paragraph that says something about the matter, at some length, so that it looks like prose.",
    "Short one.",
    "Another longer paragraph follows here and it has a <a href='/x'>link to a place</a> within its text; nothing else.",
    "Third: the end of the story is near, said the teller to all who still listened.",
]
TITLE = "Big title here"
PARAS = "".join(f"<p>{p}</p>" for p in PROSE)
WANT = "\n".join([TITLE, *(re.sub("<[^>]*>", "", p) for p in PROSE)])

# layouts the model has not seen, with other words than its own
UNSEEN = {
    "news": f"<body><header><a href=/>Site</a><p>Your daily source of truth</p></header><nav><a href=1>One</a><a href=2>Two</a></nav><article><h1>{TITLE}</h1>{PARAS}<aside><h3>See also</h3><p>Another story that you may like to read today.</p></aside></article><section class=comments><h3>3 comments</h3><div class=comment><p>I think this is a wonderful article, thank you so much for writing it.</p></div></section><footer><p>Some address. All rights reserved.</p></footer>",
    "forms": f"<div class=notice>This site uses cookies to improve your experience and for other things.</div><article><h1>{TITLE}</h1>{PARAS}<form action=x><p>Write to us, we answer soon.</p><input><button>Send</button></form></article><div id=comments><article class=comment><p>A reader wrote this long comment about the article and it goes on.</p></article></div>",
    "ids": f"<div id=top><a href=/>Home</a> | <a href=/a>About</a></div><div id=story><h1>{TITLE}</h1>{PARAS}</div><div id=bottom>&copy; 2024 A company. <a href=p>Privacy policy</a></div>",
    "sidebar": f"<div class=sidebar><h4>Archive</h4><ul><li><a href=1>January</a><li><a href=2>February</a></ul><p>About this blog: it is written by a person who lives somewhere.</p></div><main><h1>{TITLE}</h1>{PARAS}</main><div class=advertisement><p>Buy the best product of the year now, and save a lot of money with us.</p></div>",
    "alert": f"<div class=banner role=alert><p>Service notice: the site will be down for maintenance on Sunday at noon.</p></div><div class=wrapper><div class=menu>Menu: <a href=1>x</a></div><div class=article><h1>{TITLE}</h1>{PARAS}</div><div class=comments><p>First!</p><p>I do not agree with the second paragraph at all, since it is wrong.</p></div></div><div class=footer><p>Contact us at the address below.</p></div>",
    "inside": f"<article><header><h1>{TITLE}</h1></header><div class=ad>Buy now and save, only today.</div>{PARAS}<div class=comments><p>Nice text, I have read it all in one go yesterday evening.</p></div><footer>Filed under: things</footer></article><div class=cookie-banner><p>We use cookies. By using this site you agree to all of it.</p><button>OK</button></div>",
}


def by_markup(page):
    """The text of the only article element, by patterns."""
    found = re.search("<article>(.*)</article>", page, re.S)
    parts = [re.sub("<[^>]*>", " ", re.sub("</?b>", "", p)) for p in re.split("</?(?:p|h1)>", found[1])]
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.fixture(scope="module")
def model(spark, small):
    return X.train(spark.read.parquet(f"{small}/pages.parquet")).tolist()


def test_query_extracts_every_article(spark, small):
    got = {r["page_id"]: r for r in QUERIES["op11_html_extraction"](spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        row = got[page["page_id"]]
        assert (row["url"], row["text"], row["n_chars"]) == (page["url"], by_markup(page["html"]), len(row["text"]))


def test_held_out_pages_without_article_elements(spark, model):
    """Pages of another table whose landmarks are taken away: links, classes and prose must do."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = sum(X.main_text(X.LANDMARK_TAG.sub(r"<\1div", p), model) == by_markup(p) for p in pages)
    assert right >= 0.9 * len(pages)


@pytest.mark.parametrize("name", UNSEEN)
def test_unseen_layouts(model, name):
    assert X.main_text(UNSEEN[name], model) == WANT


def texts(page):
    return [b.text for b in X.leaf_blocks(page)]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain text", ["plain text"]), ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p>a &amp; b&nbsp;\n c&eacute;&#33; &unknown; &am</p>", ["a & b cé! &unknown; &am"]),
    ("<P>A<B>b</P>c</B>", ["Ab", "c"]), ("<li>1<li>2<ul><li>3</ul>4", ["1", "2", "3", "4"]),
    ("<script>var a='<p>x</p>';</SCRIPT><p>y<style>z</style></p>", ["y"]), ("<p>a<!-- <p>b --> c</p>", ["a c"]),
    ("<p>a</p><!-- open <p>b", ["a"]), ("<script>open <p>b</p>", []), ("a < b <3 c", ["a < b <3 c"]),
    ("<a title='x>y'>t</a><img alt=\"</p>\">u", ["tu"]), ("x<br>y", ["x y"]), ("<p>cut<p class", ["cut"]),
    ("<title>İ</TITLE><p>ok", ["ok"]), ("</><p>q</ p>", ["q"]), ("<p>\x00\ud800</p>", ["\x00\ud800"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<u><div><i>x</u>y</div>z", ["xy", "z"]),
])
def test_leaf_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 200_000, "<title>" * 200_000, "<" * 300_000, '<a href="' * 200_000, "<!--" * 200_000,
    "<b>" * 100_000 + "</u>" * 100_000, "<u><div>" + "<i>" * 100_000 + "</u>" * 100_000, "<a " + '="' * 300_001 + ">x",
    "<p>x" * 100_000, "<li>" * 100_000 + "</p>" * 100_000,
    "".join(f'<div class="c{i}">t' for i in range(20_000)),
], ids=range(11))
def test_hostile_pages_take_linear_time(model, page):
    started = time.time()
    X.main_text(page, model)
    assert time.time() - started < 20


def test_a_block_is_scored_as_it_was_learned(small, spark, model):
    weights = np.array(model)
    for page in [*UNSEEN.values(), "<div class='a b'><i class=c>x</i> <a id=c>y</a></div>"]:
        learned, scored = X.leaf_blocks(page), X.leaf_blocks(page, model)
        assert [b.text for b in learned] == [b.text for b in scored]
        assert np.allclose([weights[b.features].sum() for b in learned], [b.score for b in scored])


def chain_score(scores, states, w):
    start, trans = w[X.FEATURES: X.FEATURES + 2], np.reshape(w[X.FEATURES + 2:], (2, 2))
    return start[states[0]] + sum(s for s, y in zip(scores, states) if y) + sum(trans[a, b] for a, b in itertools.pairwise(states))


def test_viterbi_is_the_best_of_all_chains():
    draw = np.random.default_rng(3)
    for n in range(1, 9):
        w = draw.normal(size=X.SIZE)
        scores = draw.normal(size=n).tolist()
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: chain_score(scores, y, w))
        assert tuple(X.viterbi(scores, w.tolist())) == best
    assert X.viterbi([], [0.0] * X.SIZE) == []


def test_loss_is_the_likelihood_and_has_the_right_gradient():
    draw = np.random.default_rng(4)
    pages = [([draw.integers(0, X.FEATURES, 3).tolist() for _ in range(n)], draw.integers(0, 2, n).tolist()) for n in (4, 1, 6, 2)]
    w = draw.normal(size=X.SIZE) / 2
    data = X.Pages(pages)
    loss, gradient = data.loss_and_gradient(w)
    want = 0.0
    for blocks, labels in pages:
        scores = [w[b].sum() for b in blocks]
        every = [chain_score(scores, y, w) for y in itertools.product((0, 1), repeat=len(blocks))]
        want += np.logaddexp.reduce(every) - chain_score(scores, labels, w)
    assert loss == pytest.approx(want / 13 + X.L2 * (w**2).sum() / 2)
    for i in [*{f for blocks, _ in pages for b in blocks for f in b}, *range(X.FEATURES, X.SIZE)][:30]:
        step = np.zeros(X.SIZE)
        step[i] = 1e-5
        slope = (data.loss_and_gradient(w + step)[0] - data.loss_and_gradient(w - step)[0]) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_nulls_repeats_clashing_names_and_an_empty_table(spark, small):
    rows = [(1, "u", UNSEEN["ids"]), (1, "u", UNSEEN["ids"]), (None, None, UNSEEN["ids"]), (2, None, None), (3, "v", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS N_CHARS", "3 AS weights", "4 AS k", "5 AS `order`")
    got = sorted(map(tuple, X.extract(df).collect()), key=str)
    full = (WANT, len(WANT))
    assert got == sorted([(1, "u", *full), (1, "u", *full), (None, None, *full), (2, None, "", 0), (3, "v", "", 0)], key=str)
    assert X.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_a_very_long_page_is_read_whole(model):
    page = "<article>" + "".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(50_000)) + "</article>"
    assert X.main_text(page, model).count("\n") == 49_999
