"""Exact duplicates against a dictionary, and the rows that deduplicate keeps."""

import hashlib

import pytest

from amberline.llm import exact_dedup, minhash_join
from amberline.llm.common import sha256

LONG = "tail differs " * 40_000
ROWS = [(1, "a"), (2, "a"), (1, "b"), (3, None), (4, ""), (None, "c"), (None, "c"), (5, "c"), (None, "only here"), (6, LONG + "x"), (7, LONG + "y"),
        (8, LONG + "x"), (9, "a "), (10, "A"), (11, "é"), (12, "é"), (2, "a")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], "doc_id long, text string, full_hash string, group_size int, kept boolean").repartition(3)


@pytest.mark.parametrize("prefix, bits", [(256, 1 << 23), (1, 1 << 15)])
def test_groups(spark, prefix, bits):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    right = []
    for i, t in ROWS:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        right.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    found = exact_dedup.exact_groups(frame(spark, ROWS), prefix, bits, carry={"text_sha256": sha256("text")})
    assert sorted(map(tuple, found.collect()), key=str) == sorted(right, key=str)


def test_no_text_is_lost(spark):
    kept = exact_dedup.deduplicate(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "full_hash", "group_size", "kept"]
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {t or "" for _, t in rows} == {t or "" for _, t in ROWS}
    assert (1, "b") in rows and (1, "a") not in rows and (5, "c") in rows and (4, "") in rows and (3, None) not in rows


def test_a_text_under_a_dropped_id_stays(spark):
    three = [(1, "a"), (2, "a"), (1, "b")]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(frame(spark, three)).collect()) == [(1, "b"), (2, "a")]
    words = {"A": "one two three four five six seven", "B": "other words that no one else has here"}
    near = [(0, words["A"]), (1, words["A"]), (1, words["B"])]
    assert sorted((r["doc_id"], r["text"]) for r in minhash_join.deduplicate(frame(spark, near)).collect()) == [(0, words["A"]), (1, words["B"])]


def test_texts_under_one_id_are_linked_by_themselves(spark):
    """Two texts under one id, each near another document: two components."""
    base = [[f"{c}{i}" for i in range(60)] for c in "xy"]
    near = [" ".join(b[:-1] + ["z"]) for b in base]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (7, near[0]), (3, near[1]), (9, "alone with a few words of its own")]
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_join.classes(frame(spark, rows)).collect()}
    assert found == {(5, 56, 5, True), (5, 56, 3, False), (7, 56, 5, False), (3, 56, 3, True), (9, 4, 9, True)}
    kept = sorted((r["doc_id"], r["text"]) for r in minhash_join.deduplicate(frame(spark, rows)).collect())
    assert kept == [(3, near[1]), (5, " ".join(base[0])), (9, "alone with a few words of its own")]


def test_empty_table(spark):
    assert exact_dedup.deduplicate(frame(spark, [])).count() == exact_dedup.exact_groups(frame(spark, [])).count() == 0
