"""Repeated byte strings against a plain count of all strings, by both ways, and the column-wise construction itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from amberline.llm import repeats as r
from amberline.llm.common import read


def plainly(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        seen.update(d[k:k + length] for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(n, seed):
    """Texts that share passages, and some with passages of their own again."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60))) for _ in range(3)]
        rows.append((i, parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[:rng.randrange(10, 60)] + parts[2]))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "ab" * 100), (n + 4, rows[0][1]), (n + 4, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("length, inner, block", [(40, 10, 6000), (40, 10, 5), (25, 3, 30)])
def test_made_texts(spark, monkeypatch, length, inner, block):
    monkeypatch.setattr(r, "BLOCK", block)
    rows = made(80, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS n_bytes", "2 AS spans").repartition(3)
    got = sorted((tuple(x)[:5] for x in r.removed(docs, length, inner).collect()), key=str)
    assert got == plainly(rows, length)


def test_given_documents(spark):
    rows = [(x["doc_id"], x["text"]) for x in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = sorted((tuple(x)[:5] for x in r.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plainly(rows, 400)


def test_kept_bytes_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "0123456789" * 5), (2, "0123456789" * 5 + "y")], "doc_id long, text string")
    got = {x["doc_id"]: bytes(x["kept"]) for x in r.removed(docs, 50, 20, keep_bytes=True).collect()}
    assert got == {1: b"x" * 50, 2: b"y"}
    assert r.removed(docs.limit(0)).count() == 0


def test_columns_are_inserted_in_order():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, (60, 14)).astype(np.uint16)
    symbols[rng.random(60) < 0.3, 10:] = r.ABSENT
    collection = np.sort(rng.integers(0, 4, 60))
    got = r.repeated_starts(collection, symbols, 5)
    for i in range(60):
        for c in range(14):
            own = symbols[i, c:c + 5]
            expected = len(own) == 5 and r.ABSENT not in own and any(
                (symbols[j, c:c + 5] == own).all() for j in range(60) if j != i and collection[j] == collection[i])
            assert got[i, c] == expected


def test_long_texts_go_in_steps(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    whole = {(k, p, s) for k, p, a, b in r.anchors(data, 50, r.Hasher(12)) for s in range(a, b + 1)}
    monkeypatch.setattr(r, "STEP", 300)
    assert {(k, p, s) for k, p, a, b in r.anchors(data, 50, r.Hasher(12)) for s in range(a, b + 1)} == whole
    assert sorted(s for _, _, s in whole) == list(range(5000 - 49))


def test_short_texts_are_looked_at_together():
    """op4: one pass over arrays for many texts gives each text's own anchors; no string crosses a text's end."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (300, 0, 49, 50, 51, 200, 10, 400)]
    ends = np.cumsum([len(t) for t in texts])
    joined = [c for found in r.anchor_runs(np.frombuffer(b"".join(texts), np.uint8), 50, r.Hasher(12), ends.tolist()) for c in zip(*found)]
    plain = [(k, e - len(t) + p, e - len(t) + a, e - len(t) + b) for t, e in zip(texts, ends) for k, p, a, b in r.anchors(np.frombuffer(t, np.uint8), 50, r.Hasher(12))]
    assert joined == plain and len({p for _, p, _, _ in plain}) > 20
    assert [g for _, g in r.grouped(texts)] == [texts] and [at for at, _ in r.grouped([b"x" * r.GROUP] * 2 + texts)] == [0, 1, 2]


def test_codes_of_words(monkeypatch):
    """op4: one number a word; a text's codes are the same whatever texts lie beside it."""
    texts = [b"", b" the  cat\tsat\n", "né e\x85f né".encode(), b"\x0b\x0c", b"cat", b"x" * 700 + b" the", b""]
    whole = r.word_codes(texts)
    assert [len(c) // r.WORD for c in whole] == [len(t.split()) for t in texts]
    names = {}
    for text, codes in zip(texts, whole):
        for word, code in zip(text.split(), np.frombuffer(codes, "<u4")):
            assert names.setdefault(word, code) == code
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(r, "STEP", 5)
    assert r.word_codes(texts) == whole == [r.word_codes([t])[0] for t in texts] and r.word_codes([]) == []


def passages(rows, size):
    """Words covered by a passage of ``size`` words that also starts elsewhere."""
    seen = Counter()
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in words:
        seen.update(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    return sorted(((i, len({p for k in range(len(w) - size + 1) if seen[tuple(w[k:k + size])] > 1 for p in range(k, k + size)})) for i, w in words), key=str)


@pytest.mark.parametrize("block", [6000, 4])
def test_passages_of_words(spark, monkeypatch, block):
    monkeypatch.setattr(r, "BLOCK", block)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "né", "bcd", "e\x85f", "gh"]) + rng.choice(["", "x", "yy"]) for _ in range(n))
    shared = [text(rng.randrange(8, 30)) for _ in range(6)]
    rows = [(i, text(rng.randrange(0, 20)) + "  " + rng.choice(shared) + "\n" + text(5) + " " + rng.choice(shared)[:40]) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "of " * 200), (63, rows[0][1]), (63, rows[1][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x["doc_id"], x["n_passage_words"]) for x in r.removed(docs, 4000, 10, passage_words=10).collect()), key=str)
    assert got == passages(rows, 10)


def test_short_passages_of_many_words(spark):
    """Over 50 words in fewer than 400 bytes: nothing is removed, but the passage is found; documents without one are left alone."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = text(55)
    rows = [(i, f"{text(60)} {shared} {text(60)}") for i in range(5)] + [(i, text(150)) for i in range(5, 10)]
    found = {x["doc_id"]: x for x in r.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x["n_removed"] == 0 for x in found.values())
    assert [found[i]["n_passage_words"] for i in range(10)] == [55] * 5 + [0] * 5


def test_long_collections_of_given_documents(spark, monkeypatch):
    """The way for collections above BLOCK, on a table that has many."""
    monkeypatch.setattr(r, "BLOCK", 3)
    rows = [(x["doc_id"], x["text"]) for x in read(spark, "/root/testdata/sf0.01", "documents").where("length(text) < 8000").collect()]
    got = sorted((tuple(x)[:5] for x in r.removed(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=0).collect()), key=str)
    assert got == plainly(rows, 400)
