"""Main text of small pages, the linear scan against all ranges, and the article of every given page."""

import html
import itertools
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from amberline.llm import html_extract as h
from amberline.llm.common import read

WEIGHTS = {"word:p": 3.0, "word:h1": 3.0, "word:li": 0.3, "word:a": 0.1, "tag:p": -0.1, "tag:li": -3.0, "tag:a": -3.0, "tag:nav": -6.0, "tag:div": -3.0}


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_region_has_the_largest_sum(scores):
    begin, end = h.best_region(scores)
    sums = [sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)]
    assert sum(scores[begin:end]) == max([0, *sums])


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<nav><a>Home</a> <a>More</a></nav>", ""),
    ("<article><h1>T &amp; U</h1><p>one\n two&nbsp;three<p>four <b>fi</b>ve</article><footer>end</footer>", "T & U\none two three\nfour five"),
    ("<body><header>Site</header><div id=main><p>a b c d</p><p>e f g</p></div><div class='ad'>buy now</div></body>", "a b c d\ne f g"),
    ("<article><p>a b c</p><div class=\"ad-box\">buy</div><p>d</p><section id='comments'><p>nice</p></section></article>", "a b c\nd"),
    ("<article><p>x < y</p><script>if (a</p>) {}</script><style>p{}</style><!-- <p>no</p> --><form><p>Name</p><input></form></article>", "x < y"),
    ("<article><p title='a>b'>t</p><br><p>u<br>v</p>", "t\nu v"), ("<p>&#72;&#x69; &lt;b&gt; &quo</p>", "Hi <b> &quo"), ("<article><p>cut off <b", "cut off"),
])
def test_small_pages(page, text):
    assert h.main_text(page, WEIGHTS) == text


def test_extract_handles_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a b", "x"), (None, "u", "<p>a b", "x"), (4, "u", "<p>" + "long text " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(h.extract(pages).collect(), key=str)
    assert [(r["page_id"], r["n_chars"]) for r in got] == sorted([(1, 0), (2, 0), (None, 3), (None, 3), (4, 499_999)], key=str)
    assert h.extract(pages.limit(0)).count() == 0


def test_given_pages_give_their_article_and_nothing_else(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    texts = {r["page_id"]: r["text"] for r in h.extract(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")))
        assert texts[r["page_id"]] == "\n".join(line for line in lines if line)


def test_menu_words_weigh_less_than_article_words(spark):
    weights = h.learn_weights(read(spark, "/root/testdata/sf0.001", "pages"))
    assert weights["word:p"] > weights["apart:a"] > 0 > weights["tag:p"] > weights["tag:nav"]


@pytest.mark.parametrize("page, text", [
    ("<nav><a>Home</a></nav><main><h1>Head</h1><p>first words</p><article><p>a b c d e f</p></article><p>last words</p></main><footer>end</footer>",
     "Head\nfirst words\na b c d e f\nlast words"),
    ("<article><p>a b c d</p><article><p>quoted e f</p></article><p>g h</p></article>", "a b c d\nquoted e f\ng h"),
    ("<nav><a>Home</a></nav><article><p>a b c d</p></article><article><p>e f g</p></article><footer>end</footer>", "a b c d\ne f g"),
    ("<p>intro words here</p><article><p>a b c d</p></article>", "intro words here\na b c d"),
    ("<nav><a>Home</a></nav><div><p>a b c</p><div><p>d e f</p></div></div><footer>end</footer>", "a b c\nd e f"),
])
def test_the_region_bounds_the_text(page, text):
    assert h.main_text(page, WEIGHTS) == text


ARTICLE = "<article><h1>Head</h1><p>a b c d e</p><p>f g h</p></article>"
SHOWN = "Head\na b c d e\nf g h"


@pytest.mark.parametrize("page", [
    f'<nav><a>Home</a></nav><svg class="i"/>{ARTICLE}', f"<svg/><math />{ARTICLE}", f"<nav><a>x</a></nav><button>Menu{ARTICLE}", f"<div><select><option>a{ARTICLE}</div>",
    f"<button>Menu{ARTICLE}<button>Share</button>", f"<noscript>off{ARTICLE}<footer>end</footer>", f"<script>if (a < b) {{}}{ARTICLE}", f"<svg><path d='M0'/><title>t</title></svg>{ARTICLE}",
    f"<audio src=x>{ARTICLE}", f"<object><p>no player</p></object>{ARTICLE}", f"<title>t{ARTICLE}", f"<main>{ARTICLE}<article class='comment'><p>so nice</p></article></main>",
    f"<main>{ARTICLE}<article class='comment-12 odd'><p>so nice</p></article></main>", f"<main>{ARTICLE}<ol class=commentlist><li>so nice</ol></main>",
    f'<main>{ARTICLE}<div id="user-comments-list"><p>so nice</p></div></main>', f'<main>{ARTICLE}<p style="display: none">hidden words</p></main>',
    f"<main>{ARTICLE}<div class=privacy>We use cookies</div></main>", f"<main>{ARTICLE}<div>© 2024 Someone. All rights reserved.</div></main>",
    f"<main class='no-sidebar'><div class='content-with-ads'>{ARTICLE}</div></main>", f"<main>{ARTICLE}<article class=related-post><p>read this too</p></article></main>",
])
def test_nothing_of_the_article_is_lost_and_nothing_is_added(page):
    assert h.main_text(page, WEIGHTS) == SHOWN


@pytest.mark.parametrize("page", ["<button>" * 100_000, "<script>" * 100_000, "<svg/>" * 100_000, "<button>a</button>" * 50_000, "<p>a<select>" * 50_000, "<" * 300_000, "<a " * 200_000,
                                  "<svg>" * 50_000 + "</svg>"], ids=lambda page: page[:12])
def test_long_pages_take_linear_time(page):
    begin = time.process_time()
    list(h.tokens(page))
    assert time.process_time() - begin < 5
