"""Patterns against the plain regular expressions, gradients against differences, veiled spans, redaction."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from amberline.llm import pii
from amberline.llm.char_tagger import SYMBOLS, Tagger, symbols
from amberline.llm.common import read

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plainly(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "phone": 9 <= len(digits) <= 15,
                    "card": 12 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0}
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[1])))


@given(st.text(st.sampled_from("a1+@.- ()é2\n4"), max_size=40))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plainly(text)


def test_base_spans_of_given_documents(spark):
    for r in read(spark, "/root/testdata/sf0.01", "documents").collect():
        assert pii.base_spans(r["text"]) == plainly(r["text"])


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 500_000 + "@b " + "1" * 500_000 + "." * 10) == []
    assert len(pii.base_spans("x@y.z," * 50_000)) == 50_000


@pytest.mark.parametrize("text", ["at x" + " " * 1_000_000 + "y", "at" + " " * 1_000_000, ("at" + " " * 1000) * 1000, "at-" * 300_000, "at x" + "\n\t" * 500_000 + "(",
                                  "at a" + " dot a" * 150_000, "at " + "a" * 1_000_000, "(" * 1_000_000, " ( " * 300_000, "at (" * 250_000])
def test_spelled_out_addresses_take_linear_time(text):
    begin = time.process_time()
    list(pii.SPELLED.finditer(text)), pii.AT.split(text), pii.DOT.sub(".", text)
    assert time.process_time() - begin < 1


@pytest.mark.parametrize("text, spans", [("x at mail dot org", 1), ("x (at) mail . org", 1), ("x [at] a.b", 1), ("x AT a(dot)b  [dot]  c", 1), ("at home. Then", 1), ("that a.b", 0), ("at a", 0)])
def test_what_reads_as_a_spelled_out_domain(text, spans):
    assert len(list(pii.SPELLED.finditer(text))) == spans


def test_gradients_are_the_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger.fresh(5, 4, 1)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    x, y = rng.integers(0, SYMBOLS, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grads = tagger.gradients(x, y)
    for k, g in grads.items():
        w = tagger.weights[k]
        at = (int(x[0, 2]) if k.startswith("table") else 1, 2) if w.ndim == 2 else (1,)
        around = []
        for step in (1e-3, -2e-3, 1e-3):
            w[at] += step
            around.append(tagger.gradients(x, y)[0])
        assert abs((around[0] - around[1]) / 2e-3 - g[at]) < 1e-4


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train_tagger(read(spark, "/root/testdata/sf0.1", "documents"))


def test_veiled_spans_of_other_documents_are_found(spark, tagger):
    hits = total = added = 0
    for r in read(spark, "/root/testdata/sf0.01", "documents").collect():
        base, spans = next(pii.all_spans([r["text"]], tagger))
        added += len(spans) - len(base)
        for start, kind, end in base:
            text = r["text"][:start] + pii.veiled(kind, r["text"][start:end], start) + r["text"][end:]
            found = next(pii.all_spans([text], tagger))[1]
            hits += any(k == kind and s <= start + 3 and e > start for s, k, e in found)
            total += 1
    assert total > 50 and hits >= 0.85 * total and added <= 3


def test_windows_are_reconciled_over_a_long_text(tagger):
    span = "john.23 at mail7 dot example dot com"
    filler = "words and more of them " * 5
    text = "".join(f"{filler[:n]} {span} " for n in range(0, 110, 3))
    found = [text[s:e] for s, _, e in next(pii.all_spans([text], tagger))[1]]
    assert len(found) >= 0.8 * text.count(span) and sum(f == span for f in found) >= 0.5 * text.count(span)


def test_odd_rows_and_redaction(spark, tagger):
    rows = [(1, None, 5), (2, "", 0), (3, "mail a.b@c.example or +1 (551) 555-0826", 39), (3, "mail a.b@c.example or +1 (551) 555-0826", 39),
            (None, "é 10.0.0.1", 10), (5, "12 " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' AS spans", "1 AS n_email")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"], r["base_sha256"]) for r in pii.find(docs, tagger).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:5:18,phone:22:39"
    assert got[0] == (0, 0, 1, 0, 0, "ip:2:10", sha("ip:2:10"))
    assert got[3] == got[4] == (3, 1, 0, 0, 1, both, sha(both)) and got[1][5] == got[2][5] == ""
    clean = {(r["doc_id"], r["text"], r["n_chars"]) for r in pii.redact(docs, tagger).collect()}
    assert {(1, None, 5), (2, "", 0), (3, "mail <email> or <phone>", 23), (None, "é <ip>", 6)} <= clean
    assert pii.redact(docs, tagger).columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0 and pii.find(docs.where("doc_id = 2")).count() == 1


def test_decode_is_the_best_path():
    """Viterbi against every path, with the learned transitions' shape."""
    rng = np.random.default_rng(4)
    tagger = Tagger.fresh(4, 3, 2)
    tagger.weights = {k: rng.standard_normal(v.shape) for k, v in tagger.weights.items()}
    for n in (1, 2, 5):
        scores = rng.standard_normal((n, 4))
        path = tagger.decode(scores)
        cross = tagger.weights["cross"]
        worth = lambda p: sum(scores[t, k] for t, k in enumerate(p)) + sum(cross[a, b] for a, b in zip(p, p[1:]))
        assert abs(worth(path) - max(worth(p) for p in itertools.product(range(4), repeat=n))) < 1e-9


def test_symbols_of_any_text():
    assert symbols("aé1€\U0001f600").tolist() == [97, 128, 49, 129, 129]


def test_addresses_without_digits_are_found(spark, tagger):
    names, domains = ("john.smith", "anna", "maria.lopez", "office"), ("example.org", "mail.example.com", "company.net")
    spans = [form for n in names for d in domains for form in (
        f"{n} at {d.replace('.', ' dot ')}", f"{n}(at){d.replace('.', '(dot)')}", f"{n} [at] {d}")]
    assert all(pii.holds("email", s) for s in spans)
    found = 0
    for s in spans:
        text = f"words and more of them, please write to {s} for all the rest of it and more"
        found += any(k == "email" and b < 40 + len(s) and e > 40 for b, k, e in next(pii.all_spans([text], tagger))[1])
    text = "We met at home. Then we looked at that. And so on, at last. " * 5
    wrong = next(pii.all_spans([text], tagger))[1]
    assert found >= 0.8 * len(spans) and wrong == [], (found, wrong)
