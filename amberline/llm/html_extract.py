"""Main text of raw web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above zero and tags below, and how
much is learned from labelled pages: those whose markup itself says where the article
is. For every kind of word (by the element it stands in) and every tag the weight is the
log-odds of lying inside rather than outside the article, counted over all labelled
pages in Spark. One linear scan then finds the best contiguous region of any page. The
region is completed to the outermost article elements it reaches into, with all that is
nested in them, and text inside it that belongs to menus, adverts, forms, notices or
comments is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows

# Element names of the HTML standard by their role.
RAW = frozenset("script style title textarea iframe noframes xmp".split())  # what they hold is no markup
SKIPPED = frozenset("noscript template svg math select button canvas object audio video".split())  # what they hold is not shown as text
FOREIGN = frozenset(("svg", "math"))  # these alone may close themselves
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
                  "thead tr ul".split())
PARAGRAPH_ENDS = BLOCK - {"html", "body"}
APART = frozenset("nav footer aside form menu dialog head fieldset search".split())
APART_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion sidebar comment comments "
                        "disqus respond replies cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe "
                        "share sharing social related recommended breadcrumb breadcrumbs nav navbar navigation menu footer header masthead "
                        "pagination pager toolbar skip widget privacy legal disclaimer imprint copyright reply feedback sharebar".split())
NAME_ENDS = ("list", "form", "box", "area", "section", "wrap", "wrapper", "container", "bar", "block", "widget", "panel", "thread", "item")
QUALIFIED = frozenset("no not has have with without free less enabled disabled open closed layout".split())
# of an article's own names: those of comments, adverts and teasers only
ARTICLE_NAMES = frozenset("comment comments reply replies respond disqus ad ads advert adverts advertisement sponsored sponsor promo related recommended".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
LABELLED = frozenset(("article", "main"))
INLINE_KINDS = frozenset(("a", "li", "p", "td", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dd", "dt", "figcaption"))
KNOWN_TAGS = BLOCK | VOID | RAW | SKIPPED | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                                                         "samp small span strike strong sub sup time tt u var head".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.DOTALL | re.IGNORECASE)
SAME = {tag: re.compile(rf"<(/?){tag}(?![a-z0-9:-])[^>]*>?", re.IGNORECASE) for tag in RAW | SKIPPED}
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK, key=len, reverse=True))})(?![a-z0-9:-])", re.IGNORECASE)
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
RIGHTS = re.compile(r"\W*(?:copyright\s*)?(?:©|\(c\)|copyright)\s*(?:19|20)\d\d\b.{0,300}", re.IGNORECASE)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
PARTS = re.compile(r"[^a-z0-9]+")
DEFAULT_WORD, DEFAULT_TAG, LIMIT, LEAST = 1.0, -2.0, 8.0, 0.02


@dataclass
class Run:
    """A tag (text None) or a stretch of text between two tags."""

    feature: str
    text: str | None
    block: int
    apart: bool  # in a menu, advert, form, notice, comment list or the like
    article: int  # number of the outermost article around it, 0 outside


def _names_apart(name: str, known: frozenset[str]) -> bool:
    """Whether a class or id names something apart; "no-sidebar" or "content-with-ads" do not."""
    parts = [p for p in PARTS.split(name) if p]
    if len(parts) > 1 and QUALIFIED.intersection(parts) and not {"comment", "comments"}.intersection(parts):
        return False
    return any(part in known or any(part.endswith(e) and part.removesuffix(e) in known for e in NAME_ENDS) for part in parts)


def _is_apart(tag: str, rest: str, in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article):
        return True
    if tag in ("body", "html") or not rest:
        return False
    known = ARTICLE_NAMES if tag in LABELLED else APART_NAMES - {"header", "masthead"} if in_article else APART_NAMES
    for name, *values in NAMED.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return True
        if name == "role" and value in APART_ROLES:
            return True
        if name in ("class", "id") and tag != "main" and any(_names_apart(word, known) for word in value.split()):
            return True
    return False


def tokens(page: str) -> Iterator[re.Match]:
    """Tags and stretches of text in order, without what is never shown.

    An element of RAW or SKIPPED is left out up to its end tag. One that has none before
    the next of its name ends at the next block, so a forgotten end loses no page.
    """
    at, ended = 0, set()  # names that have no further end tag are not looked for again
    while at < len(page) and (m := TOKEN.match(page, at)):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["close"] or tag not in SAME or (tag in FOREIGN and m["rest"].rstrip().endswith("/")):
            yield m
            continue
        if tag not in ended:
            found = next((f for f in SAME[tag].finditer(page, at) if f[1] or tag in SKIPPED), None)
            if found is not None and found[1]:
                at = found.end()
                continue
            if found is None:
                ended.add(tag)
            limit = len(page) if found is None else found.start()
        else:
            limit = len(page)
        block = NEXT_BLOCK.search(page, at, limit)
        at = block.start() if block else limit


def runs(page: str) -> Iterator[Run]:
    """The page's words and tags in order; open elements end where the standard says or their parent does."""
    stack: list[tuple[str, bool, int]] = []  # (tag, apart, article)
    block, articles = 0, 0
    for m in tokens(page):
        text, tag = m["text"], m["tag"]
        _, apart, article = stack[-1] if stack else ("", False, 0)
        if text is not None:
            kind = next((t for t, _, _ in reversed(stack) if t in INLINE_KINDS), "other")
            yield Run(("apart" if apart else "word") + ":" + kind, html.unescape(text), block, apart, article)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            yield Run("space", " ", block, apart, article)
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in PARAGRAPH_ENDS or tag in ("li", "dd", "dt", "tr", "td", "th"):
            closes = {"p"} if tag not in ("li", "dd", "dt", "tr", "td", "th") else {"p", tag}
            depth = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 8), -1) if stack[i][0] in closes), None)
            if depth is not None and not any(t in ("ul", "ol", "table", "div", "section", "article") for t, _, _ in stack[depth + 1:]):
                del stack[depth:]
                _, apart, article = stack[-1] if stack else ("", False, 0)
        apart = apart or _is_apart(tag, m["rest"], bool(article))
        if tag in LABELLED and not apart and not article:
            articles += 1
            article = articles
        yield Run(f"tag:{tag if tag in KNOWN_TAGS else 'unknown'}", None, block, apart, article)
        if tag not in VOID and tag not in SAME and not m["rest"].endswith("/"):
            stack.append((tag, apart, article))


def feature_counts(pages: DataFrame) -> DataFrame:
    """(feature, inside, outside) over all pages whose markup names their article."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for page, in rows:
            found = list(runs(page))
            if not any(r.article for r in found):
                continue
            for r in found:
                if r.feature != "space":
                    n = 1 if r.text is None else len(r.text.split())
                    # what the article holds apart from its text is no example of it
                    (inside if r.article and not r.apart else outside)[r.feature] += n
        for feature in inside.keys() | outside.keys():
            yield feature, inside[feature], outside[feature]

    found = map_rows(pages.where(F.col("html").isNotNull()).select("html"), run, "feature string, inside long, outside long")
    return found.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Log-odds of lying inside the article, above zero for words and below it for tags.

    The features are element names of the standard, so there are at most a few hundred.
    Without labelled pages the table is empty and the defaults hold.
    """
    rows = [r for r in feature_counts(pages).collect() if r["inside"] + r["outside"]]
    total_in, total_out = sum(r["inside"] for r in rows) + 1, sum(r["outside"] for r in rows) + 1
    weights = {}
    for r in rows:
        odds = math.log((r["inside"] + 0.5) / total_in) - math.log((r["outside"] + 0.5) / total_out)
        is_tag = r["feature"].startswith("tag:")
        weights[r["feature"]] = -min(max(-odds, LEAST), LIMIT) if is_tag else min(max(odds, LEAST), LIMIT)
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open range with the largest sum, the first of equals; (0, 0) where nothing is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, region = total, (start, at + 1)
    return region


def main_text(page: str, weights: dict[str, float]) -> str:
    found = list(runs(page))
    scores = [0.0 if r.feature == "space" else weights.get(r.feature, DEFAULT_TAG) if r.text is None
              else len(r.text.split()) * weights.get(r.feature, LEAST if r.apart else DEFAULT_WORD) for r in found]
    begin, end = best_region(scores)
    reached = {r.article for r in found[begin:end] if r.article and r.text is not None and r.text.strip() and not r.apart}
    places = [at for at, r in enumerate(found) if r.article in reached]
    if places:
        begin, end = min(begin, places[0]), max(end, places[-1] + 1)
    blocks: dict[int, list[str]] = {}
    for r in found[begin:end]:
        # a rights line outside paragraphs and headings is a notice
        if r.text is not None and not r.apart and not (r.feature == "word:other" and RIGHTS.fullmatch(r.text.strip())):
            blocks.setdefault(r.block, []).append(r.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; ``weights`` default to those learned from ``pages``.

    Character references are decoded, white space inside a block (a line break too)
    becomes one blank, and blocks are joined by one newline in page order. A null or
    empty page, or one without words outside menus and the like, has the empty text.
    Unclosed and misnested elements are closed by their parents. Each row is judged by
    itself, so repeated rows give repeated results, and an empty table gives none.
    """
    weights = learn_weights(pages) if weights is None else weights

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = main_text(page or "", weights)
            yield page_id, url, text, len(text)

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run,
                    "page_id long, url string, text string, n_chars long")
