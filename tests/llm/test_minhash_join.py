"""Components against all pairs of small tables, long lists in blocks, and odd rows."""

import random

import numpy as np
import pytest

from amberline.llm import minhash_join as m
from amberline.llm.common import read
from amberline.llm.components import components


def brute(rows, k, percent):
    """{doc_id: (n, component)} by comparing every pair."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    for a, b in {(a, b) for group in by_shingle.values() for a in group for b in group if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def drifting(n, length, seed):
    """A chain of texts, each a small change of one before it."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(length)]]
    for _ in range(n - 1):
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(length)] = f"w{rng.randrange(5000)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_given_documents_and_drifting_copies(spark, k, percent):
    given = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    rows = given + [(10_000 + i, t) for i, t in enumerate(drifting(150, 90, 1) + drifting(40, 12, 2))]
    got = {r["doc_id"]: r for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    for i, (n, component) in brute(rows, k, percent).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component), i


def test_blocks_of_a_long_list_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    rows = list(enumerate(drifting(120, 60, 3)))
    got = {r["doc_id"]: r["component_id"] for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_odd_rows(spark):
    long = "very long text " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "two one"), (7, long), (8, long), (None, "one two"), (4, "One two"),
            (9, "É é"), (10, "é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS set_key", "1 AS token", "2 AS component_id")
    got = sorted([(r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in m.classes(docs, 3, 85).collect()], key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 3, 7, True),
                          (8, 3, 7, False), (0, 1, None, True), (4, 1, 4, True), (9, 1, 9, True), (10, 1, 10, True)], key=str)
    kept = m.deduplicate(docs, 3, 85)
    assert kept.columns == docs.columns and kept.count() == 10
    assert m.classes(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


def test_forest_links_all_that_match():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, m.COUNTED, dtype=np.uint8)
    rows = [base.copy() for _ in range(5)] + [rng.integers(0, 256, m.COUNTED, dtype=np.uint8)]
    assert len(list(m._forest([(1, 0, 0, i, r.tobytes()) for i, r in enumerate(rows)], 200))) == 4
