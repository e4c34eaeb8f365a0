"""Ranked search against a plain count of every term in every document."""

import math
import random
import re
from collections import Counter

import pytest

from amberline.llm import lexical_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -minus) for rank, (minus, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    pool = ["The", "tHe", "né", "NÉ", "你好", "a1", "1", "x", "xx", "xxx", "to-do", "it's", "éa", "É", " ", "q\x85q", "zz_top"] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice(["", " ", "."]).join(rng.choice([" ", ".", "\n", "  ", "_"]) + rng.choice(pool) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 80))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,\n"), (None, docs[3][1]), (None, docs[4][1]), (4, docs[4][1]), (4, docs[5][1]), (203, "w1 " * 20_000), (7, docs[7][1])]
    items = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(31, None), (32, ""), (33, "unseen words"), (5, "w1 w2 another"), (None, "w3 né"), (None, "xx")]
    return docs, items


@pytest.mark.parametrize("seed, top, most", [(1, 10, 1_000_000), (2, 3, 200), (3, 1, 120)])
def test_made_texts(spark, seed, top, most):
    docs, items = made(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS term", "2 AS score").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS term", "3 AS doc_id")
    got = sorted((tuple(r) for r in s.search(frame, asked, top, most_pairs=most).collect()), key=str)
    assert got == plainly(docs, items, top)


def test_shards_stay_within_the_bound(spark):
    pairs = spark.createDataFrame([(i, bytes([65 + t])) for i in range(40) for t in range(i % 5)] + [(99, bytes([t])) for t in range(50)], "item_id long, term binary")
    dealt, shards = s._shards(pairs, 20)
    rows = dealt.collect()
    assert len(rows) == pairs.count() and max(r["shard"] for r in rows) < shards
    for shard in range(shards):
        own = [r for r in rows if r["shard"] == shard]
        assert len(own) <= 20 or len({r["item_id"] for r in own}) == 1


def test_a_term_is_found_between_boundaries_only():
    automaton = s.guarded_automaton([b"a", b"ab", b"b"])
    assert s.frequencies(automaton, s.plain("ab a.b aab ABB b")) == Counter({0: 1, 1: 1, 2: 2})


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert s.search(docs, asked).count() == s.search(some, items).count() == s.search(docs, items).count() == 0
    assert s.search(some, asked).count() == 1
