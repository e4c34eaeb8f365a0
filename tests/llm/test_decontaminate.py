"""Benchmark windows in documents against a plain look at every place."""

import hashlib
import random
import re

import pytest

from amberline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, window):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, held = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if (key := tuple(own[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    held |= windows[key] - {None}
        names = ",".join(sorted(map(str, held)))
        out.append((doc, len(own), len(hit), len(held), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, window):
    rng = random.Random(seed)
    pool = ["The", "né", "NÉ", "你好", "a1", "1", "x", "xx", "to-do", "q\x85q", "_", "[", "`", " b"]
    text = lambda n: "".join(rng.choice([" ", ".", "\n", "  ", "_"]) + rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randrange(1, 4 * window))) for i in range(25)]
    items += [(30, None), (31, " ."), (3, text(window + 2)), (None, text(window)), (32, items[4][1]), (33, "x " * 3 * window), (34, "one only")]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(0, 20)) for _ in range(3)]
        inside = items[rng.randrange(len(items))][1] or ""
        at = rng.randrange(0, max(1, len(inside)))
        docs.append((i, parts[0] + " " + inside[:at].upper() + parts[1] + inside[at:] + parts[2]))
    docs += [(200, None), (201, ""), (202, ". -"), (None, docs[2][1]), (4, docs[4][1]), (4, docs[9][1]), (203, "x " * 3_000), (204, "one"), (205, "one only")]
    return docs, items


@pytest.mark.parametrize("seed, window, shingle, bits", [(1, 4, 2, 1 << 24), (2, 6, 5, 1 << 15), (3, 3, 3, 1 << 24), (4, 5, 1, 1 << 15)])
def test_made_texts(spark, seed, window, shingle, bits):
    docs, items = made(seed, window)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "'x' AS shingle", "2 AS `row`").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS words", "3 AS doc_id")
    found = d.contaminated(frame, asked, window, shingle, bits=bits).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == plainly(docs, items, window)
    for r in found:
        assert sum(x["end"] - x["start"] for x in r["spans"]) == r["n_hit"] and len(r["item_ids"]) == r["n_items"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.contaminated(docs, items).count() == 0
    assert [tuple(r)[:4] for r in d.contaminated(some, items).collect()] == [(1, 2, 0, 0)]


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        d.contaminated(None, None, window=3, shingle=4)
