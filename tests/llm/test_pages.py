"""Pages that are hard to read: many attributes, end tags without a start, no article, no marks."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from modlake.llm import pages


def text_of(html: str) -> str:
    nodes, runs = pages.parse(html)
    x = pages.features(nodes)
    return pages.article(nodes, runs, x, np.asarray(pages.by_marks(x)))


def test_a_tag_may_have_any_number_of_attributes():
    many = " ".join(f'data-x{k}="v>{k}"' for k in range(500))
    assert text_of(f"<article><div {many}><p>Some words, and more of them.</p></div></article>") == "Some words, and more of them."


def test_a_page_without_an_article_is_empty():
    assert text_of("<div><a>Home</a> <a>News</a></div><div><a>Sport</a></div>") == ""
    assert text_of("<nav>Home. News.</nav>") == text_of("") == ""
    assert text_of("<div>A sentence stands here.</div>") == "A sentence stands here."


def test_odd_tags_take_linear_time():
    began = time.perf_counter()
    for html in (
        "<div>" * 20_000 + "</span>" * 20_000 + "word. ",
        '<a "x' * 40_000,
        "<a 'x\" " * 30_000 + "<b>end. </b>",
        '<p title="' + "a' <b " * 50_000,
        "<" * 100_000 + "x",
    ):
        pages.parse(html)
    assert time.perf_counter() - began < 10
    assert text_of("<p>one two. </em></em><p>three four. ") == "one two.\nthree four."


def test_a_tag_ends_where_a_plain_scan_says():
    import random

    r = random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice("<>ab '\"") for _ in range(r.randint(1, 25)))
        lost: set[int] = set()
        for at in range(len(s)):
            plain, p = -1, at
            while p < len(s):
                if s[p] == ">":
                    plain = p
                    break
                if s[p] in "'\"" and (close := s.find(s[p], p + 1)) >= 0:
                    p = close
                p += 1
            assert pages._tag_end(s, at, lost) == plain, (s, at)


STORY = "<p>The harbour opened again on Monday, after a long winter of repairs.</p><p>Boats were back by noon; the market, said the mayor, was busy.</p><p>Cranes stay until spring, when the last pier is done.</p>"
MENU = '<div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div>'
REPLIES = "<div><h3>Readers say</h3>" + "".join(f"<div><p>Reply {k}: I was there too, and it was a great day for all of us, truly.</p></div>" for k in range(9)) + "</div>"
NOTICE = "<div><p>We use cookies to improve this site.</p></div>"


def without_marks(html: str) -> str:
    html = re.sub(r"<(/?)(nav|header|footer|aside|form|article|main|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r'\s(class|id|role)="[^"]*"', "", html)


def read(model: dict, html: str) -> str:
    nodes, runs = pages.parse(html)
    x = pages.features(nodes)
    return pages.article(nodes, runs, x, pages.log_odds(model, x))


def fitted(htmls: list[str]) -> dict:
    return pages.fit(np.concatenate([pages.features(pages.parse(h)[0]) for h in htmls]))


@pytest.fixture(scope="module")
def both(spark, data):
    """Pages, and models of other pages: one that saw marks, one that never did."""
    htmls = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect() if r.html]
    own = htmls[::2]
    return htmls[1::2], fitted(own), fitted([without_marks(h) for h in own])


def test_a_table_without_any_marks(both):
    """Marks go before training; measured on pages that no model saw."""
    held, marked, bare = both
    assert bare["trees"] and held
    for h in held:
        want, got = Counter(read(marked, h).split()), Counter(read(bare, without_marks(h)).split())
        assert 2 * (want & got).total() >= 0.9 * (want.total() + got.total())


def test_shape_outweighs_a_token_and_replies_are_left_out(both):
    text = "\n".join(["Harbour open", *re.findall("<p>(.*?)</p>", STORY)])
    for model in both[1:]:
        for name in ("plain", "post-header-body", "legal", "share side"):
            assert read(model, f'{MENU}<div class="{name}"><h1>Harbour open</h1>{STORY}</div>{REPLIES}{NOTICE}') == text
        assert read(model, f"{MENU}<div><h1>Harbour open</h1><div>{STORY}</div></div>{REPLIES}{NOTICE}") == text
        assert read(model, f'{MENU}<main><h1>Harbour open</h1><div class="legal">{STORY}</div></main>{NOTICE}') == text
        parts = f"<div><h2>One</h2>{STORY}</div><div><h2>Two</h2>{STORY}</div>"
        assert read(model, f"{MENU}<div><h1>Harbour open</h1>{parts}</div>{REPLIES}{NOTICE}").split("\n")[:6] == text.split("\n")[:1] + ["One"] + text.split("\n")[1:] + ["Two"]


def test_no_prose_saves_what_is_marked_as_discussion_or_adverts(both):
    model = both[1]
    for name in ("comments", "ad", "cookie-consent"):
        assert read(model, f'<article><h1>Short</h1><p>One line, no more.</p></article><div class="{name}"><h2>More</h2>{STORY}</div>') == "Short\nOne line, no more."


def test_flow_of_odd_trees():
    for html in ("", "<p>", "<div></div>", "<div>" * 500 + "x", "<a>all link</a>", "<h1></h1>"):
        assert pages.features(pages.parse(html)[0]).shape[1] == len(pages.FEATURES)
