"""Segments against all ranges, the tail, odd tables, and held-out accuracy on the given labels."""

import itertools
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from amberline.llm import toxicity as t
from amberline.llm.common import read


def all_maximal(scores):
    """By definition: the best range (shortest, then first), then the same left and right of it."""
    ranges = [(sum(scores[a:b]), a - b, -a) for a, b in itertools.combinations(range(len(scores) + 1), 2)]
    best = max(ranges, default=(0, 0, 0))
    if best[0] <= 0:
        return []
    begin = -best[2]
    end = begin - best[1]
    right = [(b + end, e + end, s) for b, e, s in all_maximal(scores[end:])]
    return [*all_maximal(scores[:begin]), (begin, end, best[0]), *right]


@given(st.lists(st.integers(-40, 40).map(lambda v: v + 1 / 1024 * (abs(v) % 7)), max_size=11))
def test_segments_are_the_maximal_ones(scores):
    got = t.maximal_segments(scores)
    assert sorted(round(s, 9) for _, _, s in got) == sorted(round(s, 9) for _, _, s in all_maximal(scores))
    assert all(abs(sum(scores[b:e]) - s) < 1e-9 for b, e, s in got)


def test_logistic_fit_recovers_a_curve():
    x = np.arange(0, 10, 0.25)
    p = 1 / (1 + np.exp(-(-3 + 1.2 * x)))
    a, b = t.fit_logistic(x, 1000 * p, 1000 * (1 - p))
    assert abs(a + 3) < 0.05 and abs(b - 1.2) < 0.02


def test_more_and_better_passages_surprise_more():
    tail = t.Tail(rate=0.001, decay=1.5)
    values = [tail.surprise(s, 1000) for s in ([], [1.0], [3.0], [3.0, 3.0], [3.0] * 4)]
    assert values == sorted(values) and values[0] == 0 and values[4] > values[2] + 3
    assert tail.surprise([3.0], 100_000) < tail.surprise([3.0], 100)


def test_odd_rows_and_tables(spark):
    rows = [(1, None), (2, ""), (3, "vile vile words"), (3, "vile vile words"), (None, "vile"), (5, "plain " * 50_000), (6, "İVile vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS toxic", "1 AS score")
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = t.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] is None for r in got) == 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"])
    assert {r["score"] for r in t.score(docs, labels.limit(0)).collect()} == {0.5}
    assert t.score(docs.limit(0), labels).count() == 0


def test_passages_cover_the_toxic_words(spark):
    docs = spark.createDataFrame([(1, "Fine words. You IDIOT scum scum scum! " + "calm still " * 40 + "moronic.")], "doc_id long, text string")
    row = t.passages(docs, {"idiot": 4.0, "scum": 3.0, "moron*": 5.0, "fine": -2.0}).first()
    text = docs.first()["text"]
    assert [text[p["start"]:p["end"]] for p in row["passages"]] == ["IDIOT scum", "moronic"]
    assert [round(p["score"], 6) for p in row["passages"]] == [7.0, 5.0]


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    rows = t.score(read(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_every_scoring_token_has_a_place(spark):
    rows = [("", 300, 3000), *[(f"common{i}", 200, 2000) for i in range(30)], *[(w, 60, 2) for w in ("vile", "scum", "rotten")]]
    rows += [("grimy" + e, 5, 0) for e in "abcdefgh"] + [("grimyness", 4, 40), ("plainly", 4, 40)]
    counts = spark.createDataFrame(rows, "token string, toxic long, clean long")
    tokens = t.token_scores(counts, lexicon_size=2)
    known = t.WordScores(tokens, 0.2)
    assert all(known[w] > 0 for w in ("vile", "scum", "rotten", "grimya", "grimyx"))
    assert known["grimyness"] == known["plainly"] == known["common3"] == -0.2 and "plainly" not in tokens
    assert tokens == t.token_scores(counts, lexicon_size=1000)
